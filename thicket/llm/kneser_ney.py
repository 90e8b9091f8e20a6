"""Interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark and memory-mapped for scoring.

Words are 64-bit hashes. Map tasks count a batch's distinct hashes; their counts go, as compressed sorted
arrays, to the ranges of hashes that a reduce task merges and writes: the vocabulary is then a row of
sorted hash files, and a word's id is its rank. Pairs of ids are counted and stored the same way, in
ranges of about equal mass that also cut a frequent word's pairs; so no key, however frequent, decides a
task's size. A pair's rank among all pairs is its id as a context: triples are (pair's rank, word's id), counted
the same way and stored by context. Below triples a pair counts as often as distinct words precede it, but
for pairs at a document's beginning, which nothing precedes; they keep their counts, and a document's first
token is scored by its pair. Workers map the files they need and look up whole chunks of sorted distinct keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm import textkit as K
from thicket.llm.shared import beside, folder, make_dirs
from thicket.llm.store import Store

#: Distinct keys that a map task holds before it hands them on.
HELD = 1 << 21
END = 0
MOST32 = 0xFFFFFFFF
#: Followers from which a context's sums are stored, and points at which a range of pairs tells its mass.
MANY, POINTS = 64, 16


def words(chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a chunk's words (what blanks and U+0009 to U+000D part, A-Z lower-cased), and each
    document's first and end index in them."""
    points = chunk.points
    points = points + np.uint32(32) * ((points >= 65) & (points <= 90)).astype(np.uint32)
    inside = (points != 32) & ((points < 9) | (points > 13))
    edge = np.zeros(len(points) + 1, bool)
    edge[0], edge[-1] = True, True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[chunk.starts] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    if len(starts):
        keep = inside[starts]
        starts, ends = starts[keep], ends[keep]
    return K.hash_spans(points, starts, ends), np.searchsorted(starts, chunk.starts), np.searchsorted(starts, chunk.ends)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys and their counts, compressed: differences, each byte of them apart. Counts take 4 bytes, or
    8 where one of them needs more."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    width = 8 if len(counts) and int(counts.max()) > MOST32 else 4
    values = np.ascontiguousarray(counts.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return len(keys).to_bytes(8, "little") + bytes([width]) + zstandard.compress(planes.tobytes() + values.tobytes(), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    width = data[8]
    raw = np.frombuffer(zstandard.decompress(data[9:]), np.uint8)
    steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(raw[8 * n :].reshape(width, n).T).view(f"<u{width}").ravel().astype(np.int64)


def put_counts(store: Store, name: str, counts: np.ndarray) -> None:
    """Counts in 32 bits each; those that need more are in a table of their own."""
    large = np.flatnonzero(counts >= MOST32)
    store.write(f"{name}.large", np.concatenate([large, counts[large]]).astype(np.int64))
    store.write(name, np.minimum(counts, MOST32).astype(np.uint32))


def get_counts(store: Store, name: str, at: np.ndarray) -> np.ndarray:
    out = store.read(name, np.uint32)[at].astype(np.int64)
    if len(big := np.flatnonzero(out == MOST32)):
        places, counts = store.read(f"{name}.large", np.int64).reshape(2, -1)
        out[big] = counts[np.searchsorted(places, at[big])]
    return out


def merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


class Tally:
    """Counts of keys in a map task; handed on as (range, packed keys) whenever HELD are held."""

    def __init__(self, bounds: np.ndarray):
        self.bounds = bounds  # the first key of each range but the first
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> bool:
        distinct, counts = np.unique(keys, return_counts=True)
        self.parts.append((distinct, counts))
        self.held += len(distinct)
        if self.held > HELD:
            self.fold()
        return self.held > HELD // 2

    def fold(self) -> None:
        if self.parts:
            self.parts = [merge(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))]
            self.held = len(self.parts[0][0])

    def flush(self) -> pa.RecordBatch:
        self.fold()
        keys, counts = self.parts[0] if self.parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
        cuts = [0, *np.searchsorted(keys, self.bounds).tolist(), len(keys)]
        full = [i for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        self.parts, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([pack(keys[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]]) for i in full], pa.binary())], ["part", "data"])


class Triples:
    """The triples of one range: for each pair in it where its followers begin, their ids and counts, and the
    sums of pairs with many. A count is a byte; those from 255 are in a table of their own."""

    def __init__(self, raw: np.ndarray):
        sizes = raw[:32].view(np.int64).tolist()
        at, parts = 32, []
        for n, kind in zip((sizes[0] * 5, sizes[1] * 2, sizes[2], sizes[3], sizes[3]), (np.int64, np.int64, np.uint32, np.uint32, np.uint8), strict=True):
            end = at + n * np.dtype(kind).itemsize
            parts.append(raw[at:end].view(kind))
            at = end
        self.many, self.large = parts[0].reshape(5, -1), parts[1].reshape(2, -1)
        self.starts, self.words, self.bytes = parts[2:]

    @staticmethod
    def packed(keys: np.ndarray, counts: np.ndarray, low: int, high: int) -> np.ndarray:
        """Of ascending keys with contexts from ``low`` to before ``high``."""
        starts = np.searchsorted(keys, np.arange(low, high + 1, dtype=np.uint64) << np.uint64(32))
        large = np.flatnonzero(counts >= 255)
        many = np.flatnonzero(np.diff(starts) >= MANY)
        sums = [np.add.reduceat(x.astype(np.int64), np.stack([starts[many], starts[many + 1]], 1).ravel())[::2] if len(many) else many for x in (np.append(c, 0) for c in (counts, counts == 1, counts == 2, counts > 2))]
        arrays = [np.array([len(many), len(large), len(starts), len(keys)], np.int64), many, *sums, large, counts[large]]
        arrays = [a.astype(np.int64) for a in arrays] + [starts.astype(np.uint32), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(counts, 255).astype(np.uint8)]
        return np.concatenate([a.view(np.uint8) for a in arrays])

    def _counts(self, places: np.ndarray) -> np.ndarray:
        out = self.bytes[places].astype(np.int64)
        big = np.flatnonzero(out == 255)
        out[big] = self.large[1][np.searchsorted(self.large[0], places[big])]
        return out

    def counts(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Of words after contexts (places in the range); all binary searches advance together."""
        low, end = self.starts[contexts].astype(np.int64), self.starts[contexts + 1].astype(np.int64)
        high, last = end, len(self.words) - 1
        if last < 0:
            return np.zeros(len(words), np.int64)
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            less = self.words[np.minimum(middle, last)] < words
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        found = np.flatnonzero((low < end) & (self.words[np.minimum(low, last)] == words))
        out = np.zeros(len(words), np.int64)
        out[found] = self._counts(low[found])
        return out

    def sums(self, contexts: np.ndarray) -> np.ndarray:
        """For distinct contexts: the sum of their followers' counts, and how many have 1, 2 and more."""
        out = np.zeros((4, len(contexts)), np.int64)
        start = self.starts[contexts].astype(np.int64)
        n = self.starts[contexts + 1].astype(np.int64) - start
        many = np.flatnonzero(n >= MANY)
        out[:, many] = self.many[1:, np.searchsorted(self.many[0], contexts[many])]
        few = np.flatnonzero(n < MANY)
        count, owner = self._counts(K.ragged(start[few], n[few])), np.repeat(np.arange(len(few)), n[few])
        for row, x in enumerate((count, count == 1, count == 2, count > 2)):
            out[row, few] = np.bincount(owner, x, len(few)).astype(np.int64)
        return out


@dataclass
class Model:
    """What workers need to find their way in the files; a few numbers for each range."""

    store: Store
    word_bounds: np.ndarray  # first hash of each range but the first
    word_base: np.ndarray  # id of each range's first word
    words: int  # distinct words, without the end
    tokens: int  # with the ends
    ends: int
    pair_bounds: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    ranges: int = 1  # of ids
    pairs: int = 0  # distinct
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    low_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    low_spare: float = 1.0
    order: int = 2
    pair_base: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # rank of each range's first pair
    triple_bounds: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    triples: int = 0  # distinct
    high_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @property
    def vocabulary(self) -> int:
        return self.words + (self.ends > 0)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids 1.. of sorted distinct hashes; words + 1 where the word is unknown."""
        out = np.full(len(hashes), self.words + 1, np.int64)
        cuts = [0, *np.searchsorted(hashes, self.word_bounds).tolist(), len(hashes)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a and len(known := self.store.read(f"word-{i}.hash", np.uint64)):
                at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
                out[a:b] = np.where(known[at] == hashes[a:b], at + self.word_base[i] + 1, self.words + 1)
        return out

    def _by_id(self, name: str, kind: type, ids: np.ndarray) -> np.ndarray:
        """Values at sorted ids, 0 for the unknown word."""
        out = np.zeros(len(ids), np.float64)
        size = self.words + 1
        bounds = -(-np.arange(1, self.ranges) * size // self.ranges)
        cuts = [0, *np.searchsorted(ids, bounds).tolist(), int(np.searchsorted(ids, size))]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                low = -(-i * size // self.ranges)
                out[a:b] = self.store.read(f"id-{i}.{name}", kind)[ids[a:b] - low]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of sorted ids."""
        out = np.zeros(len(ids), np.int64)
        cuts = [*np.searchsorted(ids, self.word_base + 1).tolist(), int(np.searchsorted(ids, self.words + 1))]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                out[a:b] = self.store.read(f"word-{i}.count", np.int64)[ids[a:b] - self.word_base[i] - 1]
        out[ids == END] = self.ends
        return out

    def find(self, keys: np.ndarray, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Counts and, of a model of order 3, ranks (-1: unknown) of sorted distinct pairs."""
        count, rank = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        cuts = [0, *np.searchsorted(keys, self.pair_bounds).tolist(), len(keys)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if self.pairs and b > a and len(known := self.store.read(f"pair-{i}.key", np.uint64)):
                at = np.minimum(np.searchsorted(known, keys[a:b]), len(known) - 1)
                here = known[at] == keys[a:b]
                if counted:
                    count[a:b] = np.where(here, get_counts(self.store, f"pair-{i}.count", at), 0)
                if self.order > 2:
                    rank[a:b] = np.where(here, at + self.pair_base[i], -1)
        return count, rank

    def contexts(self, i: int) -> tuple[int, int]:
        """The first pair of a range of triples and the one after its last."""
        b = [0, *self.triple_bounds.tolist()]
        return b[i] >> 32, ((b[i + 1] - 1) >> 32) + 1 if i + 1 < len(b) else self.pairs

    def after_pairs(self, keys: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Of sorted distinct triples (pair's rank << 32 | id): the word's probability, given the one after
        the pair's second word alone."""
        if not self.triples:
            return low
        count = np.zeros(len(keys), np.int64)
        context, back = np.unique((keys >> np.uint64(32)).astype(np.int64), return_inverse=True)
        sums = np.zeros((4, len(context)), np.int64)
        cuts = [0, *np.searchsorted(keys, self.triple_bounds).tolist(), len(keys)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            first, end = self.contexts(i)
            c, d = np.searchsorted(context, [first, end]).tolist()
            if b > a or d > c:
                part = Triples(self.store.read(f"triple-{i}", np.uint8))
                count[a:b] = part.counts((keys[a:b] >> np.uint64(32)).astype(np.int64) - first, (keys[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                sums[:, c:d] += part.sums(context[c:d] - first)
        total = np.maximum(sums[0], 1)
        spare = np.where(sums[0] > 0, np.array(self.high_discounts) @ sums[1:] / total, 1.0)
        return np.maximum(count - _discount(count, self.high_discounts), 0) / total[back] + spare[back] * low

    def probabilities(self, keys: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of sorted distinct pairs (first id << 32 | second id) and their counts: the second word's after the first."""
        first, back = np.unique((keys >> np.uint64(32)).astype(np.int64), return_inverse=True)
        second, back2 = np.unique((keys & np.uint64(0xFFFFFFFF)).astype(np.int64), return_inverse=True)
        # The lower order: in how many distinct pairs a word is second.
        low = np.full(len(second), self.low_spare / (self.vocabulary + 1))
        if self.pairs:
            seen = self._by_id("before", np.uint32, second)
            low += np.maximum(seen - _discount(seen, self.low_discounts), 0) / self.pairs
        if not self.pairs:
            return low[back2]
        total = self._by_id("total", np.int64, first)
        spare = sum(d * self._by_id(f"n{i}", np.uint32, first) for i, d in enumerate(self.discounts, 1))
        some = total > 0
        total = np.where(some, total, 1)
        spare = np.where(some, spare / total, 1.0)
        return np.maximum(count - _discount(count, self.discounts), 0) / total[back] + spare[back] * low[back2]


def _discount(count: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *discounts])[np.minimum(count, 3).astype(np.int64)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts of 1, 2 and more, from the numbers n of keys with counts 1 to 4; 0.5, 1 and 1.5 (as far as
    the count allows) where a number is 0 and the estimate doesn't exist."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
    found = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5 * k for k in (1, 2, 3)]
    return tuple(float(min(max(d, 0.05), k - 0.05)) for k, d in zip((1, 2, 3), found, strict=True))


def sequence(model: Model, chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a chunk's tokens, an end after each document's words; and each document's end index."""
    hashes, first, end = words(chunk)
    distinct, back = np.unique(hashes, return_inverse=True)
    ids = model.ids(distinct)[back] if len(hashes) else np.empty(0, np.int64)
    n = end - first
    stop = np.cumsum(n + 1)
    out = np.full(int(stop[-1]), END, np.int64)
    out[K.ragged(stop - n - 1, n)] = ids
    return out, stop


def pairs_of(ids: np.ndarray) -> np.ndarray:
    """Each token's pair with the one before; documents follow an end."""
    before = np.concatenate([[END], ids[:-1]])
    return before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)


def triples_of(ids: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of tokens that two of their document, a known pair, or its beginning and one precede, and their
    triples, from the rank of each token's pair with the one before."""
    before = np.concatenate([[-1], rank[:-1]])
    before[np.concatenate([[END], ids[:-1]]) == END] = -1
    has = np.flatnonzero(before >= 0)
    return has, before[has].astype(np.uint64) << np.uint64(32) | ids[has].astype(np.uint64)


def train(docs: DataFrame, text: str = "text", order: int = 2) -> Model:
    """Count ``docs`` and store the model, of order 2 or 3, in the shared folder. A null text counts as empty:
    one end."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    # What one count has shuffled needn't stay on disk during the next.
    spark.conf.set(cleanup, "true")
    try:
        return _train(docs, text, order)
    finally:
        spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)


def _train(docs: DataFrame, text: str, order: int) -> Model:
    spark = docs.sparkSession
    address = folder(spark, "kneser-ney")
    make_dirs(spark, address)
    store = Store(address)
    texts = docs.select(F.col(text).cast("string").alias("text"))
    splits = max(1, texts.rdd.getNumPartitions())
    parts = max(8, splits)
    bounds = (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64)

    def count_words(batches):
        tally = Tally(bounds)
        ends = 0
        for batch in batches:
            for chunk in K.chunks(batch.column(0)):
                ends += chunk.hi - chunk.lo
                if tally.add(words(chunk)[0]):
                    yield tally.flush()
        yield tally.flush()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([ends.to_bytes(8, "little")], pa.binary())], ["part", "data"])

    def store_words(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        data = table.column("data").to_pylist()
        if part < 0:
            n, tokens = 0, sum(int.from_bytes(x, "little") for x in data)
        else:
            read = [unpack(x) for x in data]
            keys, counts = merge(np.concatenate([k for k, _ in read]), np.concatenate([c for _, c in read]))
            store.write(f"word-{part}.hash", keys)
            store.write(f"word-{part}.count", counts.astype(np.int64))
            n, tokens = len(keys), int(counts.sum())
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([n], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    found = {r["part"]: r for r in texts.mapInArrow(count_words, "part int, data binary").groupBy("part").applyInArrow(store_words, "part int, n long, tokens long").collect()}
    for p in range(parts):
        if p not in found:
            store.write(f"word-{p}.hash", np.empty(0, np.uint64))
            store.write(f"word-{p}.count", np.empty(0, np.int64))
    sizes = [found[p]["n"] if p in found else 0 for p in range(parts)]
    mass = [found[p]["tokens"] if p in found else 0 for p in range(parts)]
    ends = found[-1]["tokens"] if -1 in found else 0
    if sum(sizes) >= (1 << 32) - 2:
        raise ValueError("more distinct words than ids of 32 bits")
    model = Model(store, bounds, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sum(sizes), sum(mass) + ends, ends, order=order)
    if not model.tokens:
        return model
    model.pair_bounds = _pair_bounds(model, np.array(mass), 4 * parts)
    model.ranges = parts

    def count_pairs(batches):
        tally = Tally(model.pair_bounds)
        for batch in batches:
            for chunk in K.chunks(batch.column(0)):
                if tally.add(pairs_of(sequence(model, chunk)[0])):
                    yield tally.flush()
        yield tally.flush()

    size = model.words + 1
    id_bounds = (-(-np.arange(1, parts) * size // parts)).astype(np.uint64)

    def store_pairs(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        read = [unpack(x) for x in table.column("data").to_pylist()]
        keys, counts = merge(np.concatenate([k for k, _ in read]), np.concatenate([c for _, c in read]))
        store.write(f"pair-{part}.key", keys)
        put_counts(store, f"pair-{part}.count", counts)
        if order == 2:
            return sums_by_word(keys, counts)
        mass = np.cumsum(np.where(keys & np.uint64(0xFFFFFFFF) == END, 0, counts))
        points = mass[-1] * np.arange(POINTS) / POINTS
        at = np.minimum(np.searchsorted(mass, points, "right"), len(keys) - 1)
        share = (points - np.where(at > 0, mass[at - 1], 0)) / np.maximum(np.where(at > 0, mass[at] - mass[at - 1], mass[0]), 1)
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "mass": pa.array([int(mass[-1])], pa.int64()), "at": pa.array([at.tolist()], pa.list_(pa.int64())), "share": pa.array([share.tolist()], pa.list_(pa.float64()))})

    def sums_by_word(keys: np.ndarray, counts: np.ndarray) -> pa.Table:
        out = [(-1, "counts", np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(np.int64).tobytes())]
        first = keys >> np.uint64(32)
        second, before = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        for name, k, c in [("before", second, before), ("total", *merge(first, counts)), *((f"n{i}", *np.unique(first[(counts == i) if i < 3 else (counts > 2)], return_counts=True)) for i in (1, 2, 3))]:
            cuts = [0, *np.searchsorted(k, id_bounds).tolist(), len(k)]
            out += [(i, name, pack(k[a:b], c[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        return pa.table({"range": pa.array([x[0] for x in out], pa.int32()), "name": [x[1] for x in out], "data": pa.array([x[2] for x in out], pa.binary())})

    def store_ids(table: pa.Table) -> pa.Table:
        at = table.column("range")[0].as_py()
        names, data = table.column("name").to_pylist(), table.column("data").to_pylist()
        if at < 0:
            n = sum(np.frombuffer(x, np.int64) for x in data)
            return pa.table({"kind": ["pairs" if at == -1 else "triples"], "n": pa.array([n.tolist()], pa.list_(pa.int64()))})
        low, high = -(-at * size // parts), -(-(at + 1) * size // parts)
        for name, kind in (("before", np.uint32), ("total", np.int64), ("n1", np.uint32), ("n2", np.uint32), ("n3", np.uint32)):
            values = np.zeros(high - low, np.int64)
            for x in (d for m, d in zip(names, data, strict=True) if m == name):
                k, c = unpack(x)
                values[k.astype(np.int64) - low] += c
            store.write(f"id-{at}.{name}", values.astype(kind))
            if name == "before":
                n = np.bincount(np.minimum(values, 5), minlength=6)
                n = [*n[1:5].tolist(), int(values.sum()), int((values > 2).sum())]
        return pa.table({"kind": ["words"], "n": pa.array([n], pa.list_(pa.int64()))})

    def count_triples(batches):
        tally = Tally(model.triple_bounds)
        for batch in batches:
            for chunk in K.chunks(batch.column(0)):
                ids = sequence(model, chunk)[0]
                keys, at = np.unique(pairs_of(ids), return_inverse=True)
                if tally.add(triples_of(ids, model.find(keys, False)[1][at])[1]):
                    yield tally.flush()
        yield tally.flush()

    def store_triples(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        read = [unpack(x) for x in table.column("data").to_pylist()]
        keys, counts = merge(np.concatenate([k for k, _ in read]), np.concatenate([c for _, c in read]))
        first, end = model.contexts(part)
        store.write(f"triple-{part}", Triples.packed(keys, counts, first, end))
        number = np.append(np.bincount(np.minimum(counts, 5), minlength=6)[1:5], len(keys))
        # Each triple's last two words: one more that precedes them.
        context, back = np.unique((keys >> np.uint64(32)).astype(np.int64), return_inverse=True)
        middle = np.zeros(len(context), np.uint64)
        cuts = np.append(np.searchsorted(context, model.pair_base), len(context)).tolist()
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                middle[a:b] = store.read(f"pair-{i}.key", np.uint64)[context[a:b] - model.pair_base[i]] & np.uint64(0xFFFFFFFF)
        tally = Tally(model.pair_bounds)
        tally.add(middle[back] << np.uint64(32) | keys & np.uint64(0xFFFFFFFF))
        out = tally.flush()
        return pa.Table.from_batches([out, pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([number.astype(np.int64).tobytes()], pa.binary())], ["part", "data"])])

    def adjust_pairs(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        data = [x for x in table.column("data").to_pylist() if x]
        if part < 0:
            return pa.table({"range": pa.array([-2] * len(data), pa.int32()), "name": ["counts"] * len(data), "data": pa.array(data, pa.binary())})
        keys = store.read(f"pair-{part}.key", np.uint64)
        # Only pairs at a beginning keep what is stored, so the task may run again.
        counts = np.where(keys >> np.uint64(32) == END, get_counts(store, f"pair-{part}.count", np.arange(len(keys))), 0)
        for x in data:
            k, c = unpack(x)
            counts[np.searchsorted(keys, k)] += c
        put_counts(store, f"pair-{part}.count", counts)
        return sums_by_word(keys, counts)

    def fill_pairs() -> None:
        for p in range(len(model.pair_bounds) + 1):
            if not _exists(store, f"pair-{p}.key"):
                store.write(f"pair-{p}.key", np.empty(0, np.uint64))
                store.write(f"pair-{p}.count", np.empty(0, np.uint32))

    paired = texts.mapInArrow(count_pairs, "part int, data binary").groupBy("part")
    if order == 2:
        counted = paired.applyInArrow(store_pairs, "range int, name string, data binary")
    else:
        held = {r["part"]: r for r in paired.applyInArrow(store_pairs, "part int, n long, mass long, at array<long>, share array<double>").collect()}
        fill_pairs()
        ranges = len(model.pair_bounds) + 1
        sizes = [held[p]["n"] if p in held else 0 for p in range(ranges)]
        model.pairs = sum(sizes)
        if model.pairs >= 1 << 32:
            raise ValueError("more distinct pairs than contexts of 32 bits")
        model.pair_base = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        model.triple_bounds = _triple_bounds(model, np.array(mass), held, 4 * parts)
        triples = texts.mapInArrow(count_triples, "part int, data binary").groupBy("part").applyInArrow(store_triples, "part int, data binary")
        every = spark.createDataFrame([(p, b"") for p in range(ranges)], "part int, data binary")
        counted = triples.unionAll(every).groupBy("part").applyInArrow(adjust_pairs, "range int, name string, data binary")
    stats = counted.groupBy("range").applyInArrow(store_ids, "kind string, n array<long>").groupBy("kind").agg(F.collect_list("n").alias("n")).collect()
    stats = {r["kind"]: np.array(r["n"]).sum(axis=0) for r in stats}
    if order == 2:
        fill_pairs()
    else:
        number = stats.get("triples", np.zeros(5, np.int64)).tolist()
        model.high_discounts, model.triples = discounts(number[:4]), number[4]
        for i in range(len(model.triple_bounds) + 1):
            if not _exists(store, f"triple-{i}"):
                store.write(f"triple-{i}", Triples.packed(np.empty(0, np.uint64), np.empty(0, np.int64), *model.contexts(i)))
    for r in range(parts):
        low, high = -(-r * size // parts), -(-(r + 1) * size // parts)
        if high > low and not _exists(store, f"id-{r}.before"):
            for name, kind in (("before", np.uint32), ("total", np.int64), ("n1", np.uint32), ("n2", np.uint32), ("n3", np.uint32)):
                store.write(f"id-{r}.{name}", np.zeros(high - low, kind))
    n = stats["words"]
    model.pairs = int(n[4])
    model.discounts = discounts([int(x) for x in stats["pairs"]])
    model.low_discounts = discounts([int(x) for x in n[:4]])
    model.low_spare = float(sum(d * int(m) for d, m in zip(model.low_discounts, (n[0], n[1], n[5]), strict=True)) / model.pairs)
    return model


def _exists(store: Store, name: str) -> bool:
    try:
        store.read(name, np.uint8)
    except (FileNotFoundError, OSError):
        return False
    store._maps.pop(name)
    return True


def _pair_bounds(model: Model, mass: np.ndarray, parts: int) -> np.ndarray:
    """First keys of ranges of pairs that hold about equal numbers of tokens, if a word's successors were
    distributed as all words are: a range ends inside a frequent word's pairs where need be."""
    total, word = model.tokens, _word_at(model, mass)
    out = []
    for q in range(1, parts):
        first, share = word(total * q / parts)
        out.append(first << 32 | word(total * share)[0])
    return np.array(sorted(out), np.uint64)


def _triple_bounds(model: Model, mass: np.ndarray, held: dict, parts: int) -> np.ndarray:
    """First keys of ranges of triples that hold about equal numbers of tokens, from what the ranges of pairs
    tell of their mass; a range ends inside a frequent pair's triples, as in _pair_bounds."""
    of = sorted(held)
    upto = np.concatenate([[0], np.cumsum([held[p]["mass"] for p in of])])
    word, out = _word_at(model, mass), []
    for q in range(1, parts):
        i = int(np.clip(np.searchsorted(upto, rank := int(upto[-1]) * q / parts, "right") - 1, 0, len(of) - 1))
        at, share = held[of[i]]["at"], held[of[i]]["share"]
        j = min(POINTS - 1, int(POINTS * (rank - upto[i]) / max(1, held[of[i]]["mass"])))
        frequent = at[j] in at[:j] + at[j + 1 :]
        out.append(int(model.pair_base[of[i]] + at[j]) << 32 | (word(model.tokens * share[j])[0] if frequent else 0))
    return np.array(sorted({k for k in out if k}), np.uint64)


def _word_at(model: Model, mass: np.ndarray):
    upto = model.ends + np.concatenate([[0], np.cumsum(mass)])

    def word(rank: float) -> tuple[int, float]:
        """The id at whose tokens the rank-th of all tokens lies, and the share of its tokens before."""
        if rank < model.ends:
            return END, rank / model.ends
        i = int(np.clip(np.searchsorted(upto, rank, "right") - 1, 0, len(mass) - 1))
        sums = np.cumsum(model.store.read(f"word-{i}.count", np.int64)) + upto[i]
        if not len(sums):
            return int(model.word_base[i]), 0.0
        k = min(int(np.searchsorted(sums, rank, "right")), len(sums) - 1)
        before = sums[k - 1] if k else upto[i]
        return int(model.word_base[i] + k + 1), float((rank - before) / max(1, sums[k] - before))

    return word


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that the model doesn't learn from: crc32 of the id as text leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns but the text, with n_tokens and n_known (tokens seen in training, ends included),
    train_tokens, base_score (add-one unigrams) and score: log10 probabilities of the whole text.

    Null and empty texts are one end. Repeated rows stand each for itself; an empty table gives no rows; a
    model of no documents gives each token all of the base's probability. Result names replace columns.
    """
    out = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows, keep, schema = beside(docs, text, "string", out)

    def run(batches):
        for batch in batches:
            for chunk in K.chunks(batch.column(len(keep))):
                ids, stop = sequence(model, chunk)
                distinct, back = np.unique(ids, return_inverse=True)
                counts = model.counts(distinct)
                begin = np.concatenate([[0], stop[:-1]])
                base = np.log10((counts + 1) / (model.tokens + model.vocabulary + 1))[back]
                known = (counts > 0).astype(np.int64)[back]
                keys, at = np.unique(pairs_of(ids), return_inverse=True)
                count, rank = model.find(keys)
                own = model.probabilities(keys, count)[at]
                if model.order > 2:
                    has, triple = triples_of(ids, rank[at])
                    triple, one, of = np.unique(triple, return_index=True, return_inverse=True)
                    own[has] = model.after_pairs(triple, own[has][one])[of]
                own = np.log10(own)
                part = batch.slice(chunk.lo, chunk.hi - chunk.lo)
                n = len(stop)
                results = [pa.array(stop - begin), pa.array(np.add.reduceat(known, begin)), pa.array(np.full(n, model.tokens, np.int64)), pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(own, begin))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *results], [*keep, *out])

    return rows.mapInArrow(run, schema + "n_tokens long, n_known long, train_tokens long, base_score double, score double")
