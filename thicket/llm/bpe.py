"""Byte-level BPE encoding and decoding in two tiers.

A minimal perfect hash (hash and displace) resolves pre-tokens that are vocabulary entries themselves;
the others are merged by a heap over a doubly linked list of bytes. Both run once for each distinct
pre-token that a worker's bounded cache doesn't hold; documents are then put together by array lookups.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from thicket.llm import textkit as K
from thicket.llm.shared import beside


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line holds a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: n keys to the slots 0..n-1.

    Keys fall into buckets; buckets, largest first, get the first displacement that sends all their keys
    to free places of a table a sixth larger than n, and the places from n on are renamed to the free ones
    below n.
    """

    def __init__(self, keys: np.ndarray):
        self.n = n = len(keys)
        self.buckets, self.places = max(1, n // 3), n + n // 6 + 1
        self.shift = np.zeros(self.buckets, np.uint64)
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        free = np.ones(self.places, bool)
        for b in np.argsort(-sizes, kind="stable")[: int((sizes > 0).sum())].tolist():
            own = keys[order[ends[b] - sizes[b] : ends[b]]]
            tried = 0
            while True:
                shifts = np.arange(tried, tried + 32, dtype=np.uint64)
                at = self._place(own[None, :], shifts[:, None])
                good = free[at].all(axis=1)
                if len(own) > 1:
                    good &= (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
                if good.any():
                    break
                tried += 32
            d = int(np.argmax(good))
            self.shift[b] = shifts[d]
            free[at[d]] = False
        self.slot = np.arange(self.places)
        beyond = np.flatnonzero(~free[n:]) + n
        self.slot[beyond] = np.flatnonzero(free[:n])
        self.keys = np.zeros(n + 1, np.uint64)
        self.keys[self.slot[self._place(keys, self.shift[bucket])]] = keys

    def _place(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (K.mix64(keys + (shift + np.uint64(1)) * np.uint64(K._STEP)) % np.uint64(self.places)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, or -1 if it isn't one of the keys."""
        if not self.n:
            return np.full(len(keys), -1)
        slots = self.slot[self._place(keys, self.shift[(keys % np.uint64(self.buckets)).astype(np.int64)])]
        return np.where((slots < self.n) & (self.keys[np.minimum(slots, self.n)] == keys), slots, -1)


class Merges:
    """The heap tier. Ranks are ids; any two adjacent parts whose bytes together have a rank may merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = rank

    def encode(self, piece: bytes) -> list[int]:
        """Merge the pair of the lowest rank, the leftmost of equal ones, until none is left."""
        of = self.bytes
        ids = [of[b] for b in piece]
        n = len(ids)
        get = self.pairs.get
        pair = [get(a << 20 | b) for a, b in zip(ids, ids[1:])]  # the rank of each part with its right neighbour
        # An entry packs rank and position, so the order of the integers is that of the merges.
        bits = n.bit_length()
        heap = [rank << bits | i for i, rank in enumerate(pair) if rank is not None]
        if not heap:
            return ids
        pair.append(None)
        heapify(heap)
        mask = (1 << bits) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while heap:
            entry = heappop(heap)
            i, rank = entry & mask, entry >> bits
            if pair[i] != rank:
                continue
            j = after[i]
            ids[i], ids[j], pair[j] = rank, -1, None
            after[i] = k = after[j]
            before[k] = i
            pair[i] = None
            if k < n and (new := get(rank << 20 | ids[k])) is not None:
                pair[i] = new
                heappush(heap, new << bits | i)
            h = before[i]
            if h >= 0:
                pair[h] = new = get(ids[h] << 20 | rank)
                if new is not None:
                    heappush(heap, new << bits | h)
        return [x for x in ids if x >= 0]


class IdCache:
    """Ids of pre-tokens by hash: slots that point into one array, emptied when that has grown too long."""

    def __init__(self, bits: int = 20, most: int = 1 << 22):
        self.slots, self.most = K.SlotCache(bits), most
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def add(self, ids: np.ndarray) -> int:
        at = self.used
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def find(self, hashes: np.ndarray, checks: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Where each pre-token's ids begin in ``self.ids`` and how many there are; ``encode`` gets the
        indexes of one pre-token of each kind that is missing and returns all ids and the counts."""
        if self.used > self.most:
            self.slots.clear()
            self.used = 0
        found = self.slots.find(hashes, checks)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            first, back = K.distinct_spans(hashes[missing], checks[missing])
            one = missing[first]
            ids, counts = encode(one)
            places = (self.add(ids) + np.cumsum(counts) - counts) << 32 | counts
            found[missing] = places[back]
            self.slots.put(hashes[one], checks[one], places)
        return found >> 32, found & 0xFFFFFFFF


class Codec:
    """Encoder and decoder of one rank file, kept for the life of a Python worker."""

    kept: dict[str, Codec] = {}

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.merges, self.cache = Merges(ranks), IdCache()
        texts = {}
        for token in ranks:
            try:
                texts[token.decode()] = token
            except UnicodeDecodeError:
                continue  # no pre-token of a text equals part of a character
        joined, lengths = "".join(texts), np.array([len(t) for t in texts], np.int64)
        points, ends = np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.cumsum(lengths)
        keys = K.hash_spans(points, ends - lengths, ends)
        self.words = PerfectHash(keys)
        slots = self.words.find(keys)
        self.word_text, self.word_id = [""] * len(keys), np.zeros(len(keys), np.uint32)
        for slot, text in zip(slots.tolist(), texts, strict=True):
            self.word_text[slot] = text
        self.word_id[slots] = [ranks[t] for t in texts.values()]
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.decimal = [b"%d" % i for i in range(len(self.tokens))]

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def pieces(self, tokens: list[str], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, one after another, and the count of each."""
        slots = self.words.find(hashes)
        out = []
        for token, slot in zip(tokens, slots.tolist(), strict=True):
            if slot >= 0 and self.word_text[slot] == token:
                out.append((int(self.word_id[slot]),))
            else:
                out.append(self.merges.encode(token.encode()))
        counts = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter((i for ids in out for i in ids), np.uint32, int(counts.sum())), counts

    def encode(self, chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents of a chunk, and the count of each document."""
        points = chunk.points
        starts = K.pretokens(points, chunk.starts)
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        hashes, checks = K.hash_and_check(points, starts, ends)

        def encode(at: np.ndarray):
            return self.pieces([chunk.text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], hashes[at])

        first, counts = self.cache.find(hashes, checks, encode)
        n = K.sums(counts, np.searchsorted(starts, chunk.starts), np.searchsorted(starts, chunk.ends))
        return self.cache.ids[K.ragged(first, counts)], n

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns but the text, with ``ids`` (array of ints): tiktoken's ids for the rank file at ``path``.

    Null and empty texts give empty arrays, repeated rows repeated rows, an empty table an empty one. A
    column named ids is replaced.
    """
    rows, keep, schema = beside(docs, text, "string", ["ids"])

    def run(batches):
        codec = Codec.of(path)
        for batch in batches:
            for chunk in K.chunks(batch.column(len(keep))):
                ids, n = codec.encode(chunk)
                part = batch.slice(chunk.lo, chunk.hi - chunk.lo)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], lists], [*keep, "ids"])

    return rows.mapInArrow(run, schema + "ids array<int>")


def decode_documents(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns but ``ids``, with ``decoded`` (binary): the bytes of the ids; null ids decode to nothing."""
    rows, keep, schema = beside(docs, ids, "array<int>", ["decoded"])

    def run(batches):
        codec = Codec.of(path)
        for batch in batches:
            decoded = pa.array([codec.decode(x or ()) for x in batch.column(len(keep)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], decoded], [*keep, "decoded"])

    return rows.mapInArrow(run, schema + "decoded binary")


def round_trip(docs: DataFrame, path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """All columns but the text, with ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by a blank)
    and ``decoded_sha256`` (of the bytes that the ids decode to); ``ids`` too if asked for. Cases as in
    encode_documents."""
    out = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    rows, keep, schema = beside(docs, text, "string", out)

    def run(batches):
        codec = Codec.of(path)
        sha = hashlib.sha256
        for batch in batches:
            for chunk in K.chunks(batch.column(len(keep))):
                ids, n = codec.encode(chunk)
                ends = np.cumsum(n)
                said, back = [], []
                for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
                    own = ids[a:b].tolist()
                    said.append(sha(b" ".join(map(codec.decimal.__getitem__, own))).hexdigest())
                    back.append(sha(codec.decode(own)).hexdigest())
                part = batch.slice(chunk.lo, chunk.hi - chunk.lo)
                results = [pa.array(n.astype(np.int64)), pa.array(said, pa.string()), pa.array(back, pa.string())]
                if with_ids:
                    results.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *results], [*keep, *out])

    schema += "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)
