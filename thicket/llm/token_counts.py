"""Token counts: pieces once for each distinct pre-token, joined to documents' pre-token frequencies, and summed.

The join is made chunk by chunk, where the text is: a chunk's distinct pre-tokens and its (document, pre-token,
frequency) rows never leave the worker, and no ids are made of them. The pieces of pre-tokens met before come
from a bounded table that a worker keeps across chunks and tasks, so a pre-token is counted once for each worker,
and again when its slot was taken. One table of the whole corpus would need the frequencies shuffled; README has
the figures of both.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from thicket.llm import textkit as K
from thicket.llm.shared import beside


class PieceLibrary:
    """Byte-level BPE files of the tokenizers library: the ids of pre-tokens, and the special strings."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        split = rules.get("pre_tokenizer") or {}
        if rules.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path}: not a byte-level BPE whose pre-tokens are those of the usual pattern")
        self.plain = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.plain.get_added_tokens_decoder().items()}
        self.plain.encode_special_tokens = True

    def _batches(self, tokens: list[str], joined: int = 256):
        """What the library makes of all tokens: (indexes, encoding, number of ids of each). A blank and something
        visible begin most pre-tokens; such ones part again when joined, which spares the library's cost for
        each call."""
        easy = [i for i, t in enumerate(tokens) if len(t) > 1 and t[0] == " " and not t[1].isspace()]
        groups = [easy[i : i + joined] for i in range(0, len(easy), joined)]
        rest = sorted(set(range(len(tokens))).difference(easy))
        for group, got in zip(groups, self.plain.encode_batch(["".join(tokens[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
            words = np.array(got.word_ids, np.int64)
            if not len(words) or words[-1] + 1 != len(group):
                rest += group
                continue
            yield group, got, np.bincount(words, minlength=len(group))
        for i, got in zip(rest, self.plain.encode_batch([tokens[i] for i in rest], add_special_tokens=False), strict=True):
            yield [i], got, len(got)

    def counts(self, tokens: list[str]) -> np.ndarray:
        """How many ids each token has."""
        counts = np.zeros(len(tokens), np.int64)
        for at, _, n in self._batches(tokens):
            counts[at] = n
        return counts

    def encode(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each token has."""
        counts = np.zeros(len(tokens), np.int64)
        found, order = [], []  # ids as they come, and the tokens that they belong to
        for at, got, n in self._batches(tokens):
            counts[at] = n
            found += got.ids
            order += at
        first = np.zeros(len(tokens), np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        return np.array(found, np.uint32)[K.ragged(first, counts)], counts


def with_specials(chunk: K.Chunk, points: np.ndarray, special: dict[str, int]) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Starts and ends of a chunk's pre-tokens; special strings are tokens by themselves: {index: id}."""
    found: list[tuple[int, int, int]] = []
    for text, i in special.items():
        at = chunk.text.find(text)
        while at >= 0:
            doc = int(np.searchsorted(chunk.ends, at, "right"))
            if at + len(text) <= chunk.ends[doc]:
                found.append((at, at + len(text), i))
                at = chunk.text.find(text, at + len(text))
            else:
                at = chunk.text.find(text, at + 1)
    if not found:
        starts = K.pretokens(points, chunk.starts)
        return starts, np.append(starts[1:], len(points)) if len(starts) else starts, {}
    cuts = np.unique(np.concatenate([chunk.starts, *([a, b] for a, b, _ in found)]).astype(np.int64))
    starts = K.pretokens(points, cuts)
    keep = np.ones(len(starts), bool)
    for a, b, _ in found:
        keep[np.searchsorted(starts, a, "right") : np.searchsorted(starts, b)] = False
    starts = starts[keep]
    return starts, np.append(starts[1:], len(points)), {int(np.searchsorted(starts, a)): i for a, _, i in found}


class PieceCounter:
    """Counts of a path, kept for the life of a Python worker. Memory: 2**20 slots, whatever it reads."""

    kept: dict[str, PieceCounter] = {}

    def __init__(self, path: str):
        self.library = PieceLibrary(path)
        self.cache = K.SlotCache(20)

    @classmethod
    def of(cls, path: str) -> PieceCounter:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def count(self, chunk: K.Chunk) -> np.ndarray:
        """Each document's number of pieces: its pre-tokens' frequencies joined to the pieces of the chunk's
        distinct pre-tokens, and summed."""
        points = chunk.points
        starts, ends, special = with_specials(chunk, points, self.library.special)
        docs = chunk.hi - chunk.lo
        doc = np.repeat(np.arange(docs), np.searchsorted(starts, chunk.ends) - np.searchsorted(starts, chunk.starts))
        total = np.zeros(docs, np.int64)
        hashes, checks = K.hash_and_check(points, starts, ends)
        if special:
            own = np.array(list(special))
            total += np.bincount(doc[own], minlength=docs)
            plain = np.delete(np.arange(len(starts)), own)
            starts, ends, doc, hashes, checks = starts[plain], ends[plain], doc[plain], hashes[plain], checks[plain]
        if not len(starts):
            return total
        one, kind = K.distinct_spans(hashes, checks)
        pieces = self.cache.find(hashes[one], checks[one])
        if len(new := np.flatnonzero(pieces < 0)):
            at = one[new]
            pieces[new] = self.library.counts([chunk.text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            self.cache.put(hashes[at], checks[at], pieces[new])
        pair, frequency = np.unique(doc * len(one) + kind, return_counts=True)
        np.add.at(total, pair // len(one), frequency * pieces[pair % len(one)])
        return total


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """All columns but the text, with ``n_bytes``, ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    Counts are those of the library for the file at ``path`` (byte-level BPE in .json) without added
    tokens; special strings inside texts are one token, as is its default. Null and empty texts have 0
    bytes and 0 tokens; repeated rows give repeated rows; an empty table gives an empty one. Columns
    named like the three results are replaced.
    """
    out = ["n_bytes", "n_tokens", "over_limit"]
    rows, keep, schema = beside(docs, text, "string", out)

    def count(batches):
        counter = PieceCounter.of(path)
        for batch in batches:
            texts = batch.column(len(keep))
            n = np.zeros(batch.num_rows, np.int64)
            for chunk in K.chunks(texts):
                n[chunk.lo : chunk.hi] = counter.count(chunk)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], size, pa.array(n), pa.array(n > limit)], [*keep, *out])

    return rows.mapInArrow(count, schema + "n_bytes long, n_tokens long, over_limit boolean")
