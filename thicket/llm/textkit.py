"""Vectorised text helpers for the corpus operators: batches of documents as flat numpy arrays.

Everything here works on a *chunk*: the documents of one Arrow batch cut into pieces of bounded size,
so the memory of a Python worker depends on neither the batch size nor the corpus. A null text counts
as the empty text. A single document is never cut: a chunk may exceed its bound by one document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_CHARS = 1 << 19
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_powers = np.empty(0, np.uint64)


def powers(n: int) -> np.ndarray:
    """Random-looking odd multipliers for the positions 0..n-1 of a word."""
    global _powers
    if len(_powers) < n:
        _powers = mix64(np.arange(1, max(1024, 2 * n) + 1, dtype=np.uint64) * np.uint64(_STEP)) | np.uint64(1)
    return _powers[:n]


def hash_spans(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span [start, end) of ``symbols``; spans ascend, don't overlap and aren't empty."""
    return _hashed(symbols, starts, ends, False)[0]


def hash_and_check(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """hash_spans, and 32 bits more that tell apart spans of one hash."""
    return _hashed(symbols, starts, ends, True)


def _hashed(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, checked: bool) -> tuple[np.ndarray, np.ndarray]:
    check = np.empty(0, np.uint32)
    if not len(starts):
        return np.empty(0, np.uint64), check
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    within = np.arange(total) - np.repeat(first, lengths)
    picked = symbols if total == len(symbols) else symbols[within + np.repeat(starts, lengths)]
    terms = mix64((picked.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[within])
    hashes = mix64(np.add.reduceat(terms, first) + lengths.astype(np.uint64))
    if checked:
        check = (mix64(np.add.reduceat((terms ^ (terms >> np.uint64(29))) * _MIX1, first)) >> np.uint64(32)).astype(np.uint32)
    return hashes, check


class Chunk:
    """Some documents of a batch: rows [lo, hi), their code points, and where each document begins."""

    def __init__(self, lo: int, hi: int, text: str, lengths: np.ndarray):
        self.lo, self.hi, self.text = lo, hi, text
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.lengths = lengths

    @property
    def points(self) -> np.ndarray:
        return np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chunks(texts: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[Chunk]:
    """Cut a string array into chunks of about ``limit`` characters."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lo, n = 0, len(lengths)
    total = np.cumsum(lengths)
    while lo < n:
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + limit, "right")))
        yield Chunk(lo, hi, "".join(x or "" for x in texts.slice(lo, hi - lo).to_pylist()), lengths[lo:hi])
        lo = hi
    release()


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, beside the executor."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None  # another C library


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """For each code point whether it is a letter, number, white space or something else."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            lo, hi = ord(every[m.start()]), ord(every[m.end() - 1])
            out[lo : hi + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def pretokens(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of public_tokenizers.PATTERN; each ends where the next begins.

    The pattern is applied to each document by itself. Runs of one class are tokens; a run that a blank
    precedes takes it; of longer white space only the last character parts from the rest.
    """
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = classes()[points]
    head = np.zeros(n + 1, bool)
    head[doc_starts[doc_starts < n]] = True
    head[n] = True
    start = head.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    first, after = runs[:-1], runs[1:]
    space = (kind[first] == SPACE) & ~head[after]
    last = after[space] - 1
    start[last] = True
    start[after[space][points[last] == 32]] = False
    quote = first[(points[first] == 39) & (after - first == 1) & start[first] & ~head[after]]
    if len(quote):
        one = points[quote + 1]
        short = quote[np.isin(one, [ord(c) for c in "stmd"])]
        start[short + 1] = False
        start[short + 2] = True
        long = quote[np.isin(one, [ord(c) for c in "rvl"]) & (quote + 2 < n)]
        long = long[~head[long + 2]]
        a, b = points[long + 1], points[long + 2]
        long = long[((b == ord("e")) & (a != ord("l"))) | ((b == ord("l")) & (a == ord("l")))]
        start[long + 1] = False
        start[long + 3] = True
    return np.flatnonzero(start[:n])


@lru_cache(maxsize=1)
def word_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it belongs to words (letters, numbers, marks), and its lower case."""
    import regex

    word, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for m in regex.finditer(r"[\p{L}\p{N}\p{M}]+", every):
        word[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = True
    word[0xD800:0xE000] = False
    for m in regex.finditer(r"\p{Lu}|\p{Lt}", every):
        if len(low := m[0].lower()) == 1:
            lower[ord(m[0])] = ord(low)
    return word, lower


def words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's lower-cased code points, and start and end of each word in them."""
    word, lower = word_tables()
    points = lower[chunk.points]
    inside = word[points]
    edge = np.zeros(len(points) + 1, bool)
    edge[0], edge[-1] = True, True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[chunk.starts] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    if not len(starts):
        return points, starts, ends
    keep = inside[starts]
    return points, starts[keep], ends[keep]


class SlotCache:
    """A bounded map from spans, known by hash and check, to one integer each: direct-mapped, later entries
    replace earlier."""

    def __init__(self, bits: int = 20):
        self.shift = np.uint64(64 - bits)
        self.keys, self.checks = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint32)
        self.values = np.full(1 << bits, -1, np.int64)

    def find(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        slots = hashes >> self.shift
        return np.where((self.keys[slots] == hashes) & (self.checks[slots] == checks), self.values[slots], -1)

    def put(self, hashes: np.ndarray, checks: np.ndarray, values: np.ndarray) -> None:
        slots = hashes >> self.shift
        self.keys[slots] = hashes
        self.checks[slots] = checks
        self.values[slots] = values  # of equal slots numpy keeps the last in all arrays

    def clear(self) -> None:
        self.values[:] = -1


def distinct_spans(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of one span of each kind, and each span's kind. Spans of one hash and different checks are
    different."""
    kinds, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    odd = np.flatnonzero(checks != checks[first][back])
    if not len(odd):
        return first, back
    pairs = np.rec.fromarrays([hashes[odd], checks[odd]])
    _, more, again = np.unique(pairs, return_index=True, return_inverse=True)
    back[odd] = len(kinds) + again
    return np.concatenate([first, odd[more]]), back


def ragged(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges [first, first + length)."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(first - (ends - lengths), lengths)


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[start:end] for each pair, empty ranges included."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[starts]
