"""Token ids in binary files: an adaptive context-mixing range coder over independent blocks.

Three predictions are mixed for each id. Order 2 and order 1 name the id that last followed the two ids, or
the one id, before; order 0 is the distribution of the file's ids, which its head holds. The mixture is one
distribution, k * order 0 + m1 * [order 1's id] + m2 * [order 2's id], by which the id is coded in one step.
The weights depend on how often each named id has been right in a row; they move towards the share that each
prediction had in the probability of the id that came. A block starts from empty contexts and fixed weights
and carries a checksum of its bytes and one of its ids, so beside the head any block can be read, checked or
lost alone. All values are whole numbers, or quotients that IEEE arithmetic rounds alike on any machine.
Blocks are coded side by side, one id of each a step, so that numpy works on whole vectors.

A file: MAGIC, lengths and checksums, the vocabulary and its frequencies, the directory (documents and their
numbers of ids), the table of blocks and the blocks' bytes; see ``pack_file``.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm import textkit as K
from thicket.llm.bpe import IdCache
from thicket.llm.shared import folder, make_dirs
from thicket.llm.store import Store
from thicket.llm.token_counts import PieceLibrary, with_specials

MAGIC = b"THKTIDS2"
#: Ids of a block at most, and at least where a file has enough; blocks side by side; slots of a context table.
BLOCK, SHORT, LANES, SLOTS = 2048, 512, 3072, 1024
#: Ids after which a file is closed; its last document is whole.
FILE_IDS = 1 << 22
#: Bits of the order-0 distribution at most, of the weights, of a word; the interval's sizes.
MOST_BITS, WEIGHT_BITS, WORD = 22, 8, 32
LEAST_SIZE, FULL_SIZE = 1 << 30, (1 << 62) - 1
WORD_MASK, KEEP = (1 << WORD) - 1, LEAST_SIZE - 1
#: What the weights of orders 1 and 2 add up to at most (of 65536), and how slowly they move.
MOST_WEIGHT, SLOWNESS = 63500, 5

_right1, _right2 = np.arange(64) & 7, np.arange(64) >> 3
#: Weights to begin with by the runs of right predictions (order 2, order 1): order 2's above bit 16.
BEGIN = (_right2 * 4500 << 16 | _right1 * 3200).astype(np.int64)


class Prior:
    """Order 0: cumulative frequencies of the ids 0..n-1 that sum to 2**bits, none of them 0; id n stands for none."""

    def __init__(self, frequency: np.ndarray):
        self.n, self.bits = len(frequency), int(frequency.sum()).bit_length() - 1
        self.upto = np.zeros(self.n + 2, np.int64)
        np.cumsum(frequency, out=self.upto[1:-1])
        self.upto[-1] = self.upto[-2]
        self.find = np.repeat(np.arange(self.n, dtype=np.int32), frequency)

    @staticmethod
    def of(counts: np.ndarray) -> np.ndarray:
        """Frequencies near the shares of ``counts``, all of them positive."""
        n = len(counts)
        if n > 1 << (MOST_BITS - 1):
            raise ValueError(f"a file holds at most {1 << (MOST_BITS - 1)} different ids")
        total = 1 << min(MOST_BITS, max(14, n.bit_length() + 3))
        frequency = 1 + counts.astype(np.int64) * (total - n) // int(counts.sum())
        frequency[np.argmax(counts)] += total - int(frequency.sum())
        return frequency


def _slots(x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the context x, and of the contexts before, x."""
    return (x * 40503 >> 2) & (SLOTS - 1), ((x * 69621 + before * 48271) >> 3) & (SLOTS - 1)


def _run(lengths: np.ndarray, prior: Prior, ids: np.ndarray | None, words: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Encode ``ids`` (lane, step) or decode ``words`` (lane, 32-bit word). Lanes descend in length, and
    lengths differ by one at most.

    The interval is [low, low + size) with sizes from 2**30 to 2**62; an id costs 30 bits at most, so one
    shift by a word restores the size. A carry waits in the word last written and is settled at the end.
    """
    n, steps = len(lengths), int(lengths.max())
    encode, bits, upto = ids is not None, prior.bits, prior.upto
    shift = bits + WEIGHT_BITS
    lane = np.arange(n)
    size = np.full(n, FULL_SIZE, np.int64)
    if encode:
        out = np.zeros((n, steps + 4), np.int64)
        flat, at, low = out.reshape(-1), lane * out.shape[1], np.zeros(n, np.int64)
        ids = np.ascontiguousarray(ids.T, np.int32)
    else:
        out = np.zeros((steps, n), np.int32)
        words = np.pad(words, ((0, 0), (0, 4)))
        code = words[:, 0] << 30 | words[:, 1] >> 2
        later = (words[:, 1:-1] & 3) << 30 | words[:, 2:] >> 2
        flat, at = later.reshape(-1), lane * later.shape[1]
    every_low, every_at = (low, at) if encode else (None, at)
    slots = np.full(2 * n * SLOTS, prior.n << 3, np.int32)  # id << 3 | times right in a row
    rows = np.stack([lane * SLOTS, (lane + n) * SLOTS])
    weights, own = np.tile(BEGIN, n), lane * 64
    x = before = np.zeros(n, np.int32)
    for step in range(steps):
        if step == steps - 1 and (a := int(np.searchsorted(-lengths, -step, "left"))) < n:
            size, at, rows, own, x, before = size[:a], at[:a], rows[:, :a], own[:a], x[:a], before[:a]
            if encode:
                low = low[:a]
            else:
                code = code[:a]
            n = a
        s = rows + _slots(x, before)
        entry = slots.take(s)
        named, right = entry >> 3, entry & 7
        w_at = (right[1] << 3) + right[0] + own
        w = weights.take(w_at)
        w1, w2 = w & 0xFFFF, w >> 16
        m1, m2 = w1 >> 8, w2 >> 8
        k = 256 - m1 - m2
        unit = size >> shift
        before = x
        if encode:
            x = ids[step, :n]
        else:
            # The two named ids cut the scaled order 0 in three; what lies beyond each moves down by its weight.
            value = np.minimum(code // unit, (1 << shift) - 1)
            swap = named[0] > named[1]
            lower, upper = np.where(swap, named[1], named[0]), np.where(swap, named[0], named[1])
            m_lower = np.where(swap, m2, m1) << bits
            m_upper = ((m1 + m2) << bits) - m_lower
            beyond = value >= k * upto.take(lower + 1) + m_lower
            value -= m_lower * beyond
            far = (value >= k * upto.take(upper + 1) + m_upper) & beyond
            value -= m_upper * far
            x = prior.find.take(np.minimum((value / k).astype(np.int64), len(prior.find) - 1))
            x = np.where(beyond, np.where(far, x, np.minimum(x, upper)), np.minimum(x, lower))
        hit, over = x == named, x > named
        h1, h2 = m1 * hit[0], m2 * hit[1]
        first = upto.take(x)
        begin = (k * first + ((m1 * over[0] + m2 * over[1]) << bits)) * unit
        share = k * (upto.take(x + 1) - first) + ((h1 + h2) << bits)
        size = unit * share
        small = np.flatnonzero(size < LEAST_SIZE)
        place = at[small]
        if encode:
            low += begin
            left = low[small]
            flat[place] = left >> 30
            low[small] = (left & KEEP) << WORD
        else:
            code -= begin
            out[step, :n] = x
            code[small] = code[small] << WORD | flat[place]
        size[small] <<= WORD
        at[small] = place + 1
        part = (MOST_WEIGHT << bits) / share
        moved1, moved2 = ((h1 * part).astype(np.int64) - w1) >> SLOWNESS, ((h2 * part).astype(np.int64) - w2) >> SLOWNESS
        weights[w_at] = w + moved1 + (moved2 << 16)
        right *= hit
        right += 1
        slots[s] = x << 3 | np.minimum(right, 7)
    if not encode:
        return out.T, every_at
    written = every_at - lane * out.shape[1]
    for _ in range(2):  # the whole of low
        flat[every_at] = every_low >> 30
        every_low[:] = (every_low & KEEP) << WORD
        every_at += 1
    while (carry := out >> WORD).any():
        out &= WORD_MASK
        out[:, :-1] += carry[:, 1:]
    return out, written + 2


def block_lengths(n: int) -> np.ndarray:
    """Lengths of n ids' blocks: of BLOCK at most, but more and shorter ones (not below SHORT) for a file of few."""
    if not n:
        return np.empty(0, np.int64)
    blocks = max(-(-n // BLOCK), min(LANES // 6, -(-n // SHORT)))
    return np.where(np.arange(blocks) < n % blocks, n // blocks + 1, n // blocks)


def encode_blocks(ids: np.ndarray, prior: Prior) -> tuple[list[bytes], np.ndarray]:
    """The bytes of each block of ``ids`` (below prior.n), and the blocks' numbers of ids."""
    lengths = block_lengths(len(ids))
    ends = np.cumsum(lengths)
    blocks: list[bytes] = []
    for part in np.array_split(np.arange(len(lengths)), -(-len(lengths) // LANES)) if len(lengths) else ():
        own = lengths[part]
        lanes = np.zeros((len(own), int(own.max())), np.int32)
        lanes[np.arange(lanes.shape[1])[None, :] < own[:, None]] = ids[ends[part[0]] - own[0] : ends[part[-1]]]
        words, written = _run(own, prior, lanes, None)
        blocks += [words[i, :n].astype("<u4").tobytes() for i, n in enumerate(written.tolist())]
    return blocks, lengths


def decode_blocks(blocks: list[bytes], lengths: np.ndarray, prior: Prior) -> np.ndarray:
    out = []
    for part in np.array_split(np.arange(len(blocks)), -(-len(blocks) // LANES)) if blocks else ():
        own = lengths[part]
        data = [np.frombuffer(blocks[i], "<u4") for i in part.tolist()]
        words = np.zeros((len(data), max(map(len, data))), np.int64)
        for i, row in enumerate(data):
            words[i, : len(row)] = row
        ids, _ = _run(own, prior, None, words)
        out.append(ids[np.arange(ids.shape[1])[None, :] < own[:, None]])
    return np.concatenate(out) if out else np.empty(0, np.int32)


def _stream(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return zstandard.compress(sink.getvalue(), 3)


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in ascending order, and each id's place among them."""
    if not len(ids) or int(ids.max()) >= 1 << 22:
        vocabulary, dense = np.unique(ids, return_inverse=True)
        return vocabulary, dense.astype(np.int32)
    vocabulary = np.flatnonzero(np.bincount(ids))
    number = np.zeros(int(vocabulary[-1]) + 1, np.int32)
    number[vocabulary] = np.arange(len(vocabulary))
    return vocabulary, number[ids]


def pack_file(ids: np.ndarray, directory: pa.Table) -> bytes:
    """A file of unsigned 32-bit ids and of a directory whose column n_tokens tells documents apart."""
    vocabulary, dense = _numbered(ids)
    frequency = Prior.of(np.bincount(dense)) if len(ids) else np.zeros(0, np.int64)
    blocks, lengths = encode_blocks(dense, Prior(frequency)) if len(ids) else ([], np.empty(0, np.int64))
    listing = _stream(directory)
    known = _stream(pa.table({"id": pa.array(vocabulary.astype(np.uint32)), "frequency": pa.array(frequency)}))
    ends = np.cumsum(lengths)
    plain = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    table = b"".join(struct.pack("<IIII", n, len(b), zlib.crc32(b), zlib.crc32(plain[4 * (e - n) : 4 * e])) for b, n, e in zip(blocks, lengths.tolist(), ends.tolist(), strict=True))
    head = struct.pack("<QQQIII", len(blocks), len(listing), len(known), zlib.crc32(listing), zlib.crc32(known), zlib.crc32(table))
    return b"".join([MAGIC, head, known, listing, table, *blocks])


def unpack_file(data: memoryview | bytes) -> tuple[pa.Table, np.ndarray]:
    """Directory and ids; ValueError names what doesn't match its checksum."""
    if bytes(data[:8]) != MAGIC:
        raise ValueError("not a file of ids")
    n, size, known_size, listing_crc, known_crc, table_crc = struct.unpack("<QQQIII", data[8:44])
    cuts = np.cumsum([44, known_size, size, 16 * n]).tolist()
    known, listing, table = (bytes(data[a:b]) for a, b in zip(cuts, cuts[1:]))
    if zlib.crc32(listing) != listing_crc or zlib.crc32(table) != table_crc or zlib.crc32(known) != known_crc:
        raise ValueError("vocabulary, directory or block table damaged")
    rows = list(struct.iter_unpack("<IIII", table))
    at, blocks = cuts[-1], []
    for i, (_, length, crc, _) in enumerate(rows):
        blocks.append(bytes(data[at : at + length]))
        at += length
        if zlib.crc32(blocks[-1]) != crc:
            raise ValueError(f"block {i} damaged")
    words = pa.ipc.open_stream(zstandard.decompress(known)).read_all()
    vocabulary, frequency = words.column("id").to_numpy(), words.column("frequency").to_numpy()
    ids = vocabulary[decode_blocks(blocks, np.array([r[0] for r in rows], np.int64), Prior(frequency))] if n else np.empty(0, np.uint32)
    plain, upto = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), 0
    for i, (count, _, _, crc) in enumerate(rows):
        if zlib.crc32(plain[4 * upto : 4 * (upto + count)]) != crc:
            raise ValueError(f"block {i} decodes to other ids")
        upto += count
    return pa.ipc.open_stream(zstandard.decompress(listing)).read_all(), ids


class Tokens:
    """Ids of whole texts by the tokenizers library, each distinct pre-token once for a bounded cache."""

    kept: dict[str, Tokens] = {}

    def __init__(self, path: str):
        self.library, self.cache = PieceLibrary(path), IdCache(21, 1 << 23)

    @classmethod
    def of(cls, path: str) -> Tokens:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def encode(self, chunk: K.Chunk, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents, each closed by ``end``, and their numbers."""
        points = chunk.points
        starts, ends, special = with_specials(chunk, points, self.library.special)
        hashes, checks = K.hash_and_check(points, starts, ends)

        def encode(at: np.ndarray):
            return self.library.encode([chunk.text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])

        first, counts = self.cache.find(hashes, checks, encode)
        for index, i in special.items():
            first[index], counts[index] = self.cache.add(np.array([i], np.uint32)), 1
        n = K.sums(counts, np.searchsorted(starts, chunk.starts), np.searchsorted(starts, chunk.ends))
        ids = self.cache.ids[K.ragged(first, counts)]
        stop = np.cumsum(n + 1)
        out = np.full(int(stop[-1]), end, np.uint32)
        out[K.ragged(stop - n - 1, n)] = ids
        return out, n + 1


def write_ids(docs: DataFrame, path: str, address: str, doc_id: str = "doc_id", text: str = "text", end: int = 2, file_ids: int = FILE_IDS) -> list[tuple[int, list[int]]]:
    """Tokenize whole texts, close each with ``end``, and write files in ascending order of ids (nulls first,
    equal ids by their texts' hash, then text). Returns each range's number and its files' counts of ids.

    A range's file is closed after ``file_ids`` ids, so a task holds one file's ids at most, beside one chunk of documents.
    Null and empty texts hold the end alone; an empty table gives no files. Run again, a task replaces its
    files by the same ones.
    """
    store = Store(address)
    make_dirs(docs.sparkSession, address)

    def run(batches):
        from pyspark import TaskContext

        tokens, part, counts = Tokens.of(path), TaskContext.get().partitionId(), []
        found, listing, held = [], [], 0

        def close():
            ids = np.concatenate(found)
            store.write(f"{part:06d}-{len(counts):06d}.ids", np.frombuffer(pack_file(ids, pa.concat_tables(listing)), np.uint8))
            counts.append(len(ids))
            found.clear()
            listing.clear()

        for batch in batches:
            for chunk in K.chunks(batch.column(1)):
                ids, n = tokens.encode(chunk, end)
                found.append(ids.astype(np.uint16) if int(ids.max()) < 1 << 16 else ids)
                listing.append(pa.table({"doc_id": batch.column(0).slice(chunk.lo, chunk.hi - chunk.lo), "n_tokens": pa.array(n)}))
                held += len(ids)
                if held >= file_ids:
                    close()
                    held = 0
        if found:
            close()
        K.release()
        if counts:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([counts], pa.list_(pa.int64()))})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("turn", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "turn").sortWithinPartitions("doc_id", "turn", "text").select("doc_id", "text")
    return sorted((r["part"], r["n"]) for r in ordered.mapInArrow(run, "part int, n array<long>").collect())


def read_ids(spark, address: str, files: list[tuple[int, list[int]]], kind: str) -> DataFrame:
    """One row for each document in the files: doc_id, start (ids before it in all files), n_tokens and
    ids_crc32, the checksum of its ids as little-endian unsigned 32-bit numbers."""
    store = Store(address)
    starts = np.concatenate([[0], np.cumsum([sum(n) for _, n in files])]).tolist()

    def run(batches):
        for batch in batches:
            for part, base, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for number, count in enumerate(counts):
                    name = f"{part:06d}-{number:06d}.ids"
                    listing, ids = unpack_file(memoryview(store.read(name, np.uint8)))
                    store._maps.pop(name)
                    n = listing.column("n_tokens").to_numpy()
                    data, stop = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), np.cumsum(n)
                    crc = [zlib.crc32(data[4 * (e - k) : 4 * e]) for e, k in zip(stop.tolist(), n.tolist(), strict=True)]
                    yield from pa.table({"doc_id": listing.column("doc_id"), "start": pa.array(base + stop - n), "n_tokens": listing.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64())}).to_batches()
                    base += count
        K.release()

    if not files:
        return spark.createDataFrame([], f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
    rows = spark.createDataFrame([(p, s, n) for (p, n), s in zip(files, starts)], "part int, base long, n array<long>").repartitionByRange(len(files), "part")
    return rows.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def stored_documents(docs: DataFrame, path: str) -> tuple[DataFrame, str]:
    """Write ``docs`` (doc_id, text) as id files in the shared folder and read them back."""
    address = folder(docs.sparkSession, "ids")
    files = write_ids(docs, path, address)
    return read_ids(docs.sparkSession, address, files, docs.schema["doc_id"].dataType.simpleString()), address
