"""Token counts, BPE, id files, decontamination: against the libraries, SQL and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from thicket.llm import bpe, decontaminate, idcoder, textkit as K, token_counts

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "a", "don't  stop\n\n  we'll 've 's", "日本語 ééé x 12²", "x" * 5000 + " " * 300 + "y", "<|endoftext|>a <|endoftext|>", "Same text.", "Same text.", "'" * 9 + "s 'st"]


def table(spark, texts, **more):
    rows = [(i, t, f"clash{i}", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, _text string, n_tokens int")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="'stmdrvel aé日1２²\n\t 　\x1c_.", max_size=12), max_size=4))
def test_pretokens_are_those_of_the_pattern(docs):
    chunk = next(K.chunks(pa.array(docs, pa.string()), 1 << 30), None)
    got = []
    if chunk:
        starts = K.pretokens(chunk.points, chunk.starts).tolist()
        got = [chunk.text[a:b] for a, b in zip(starts, [*starts[1:], len(chunk.text)])]
    assert got == [m for d in docs for m in regex.findall(P.PATTERN, d)]


def test_chunks_cover_all_rows():
    texts = pa.array([None, "", "abc", "d" * 50, "", "e"])
    parts = list(K.chunks(texts, 4))
    assert [(c.lo, c.hi) for c in parts][0][0] == 0 and parts[-1].hi == 6
    assert "".join(c.text for c in parts) == "abc" + "d" * 50 + "e"


def test_token_counts(spark):
    tokenizer = Tokenizer.from_file(JSON)
    rows = token_counts.count_tokens(table(spark, TEXTS), JSON).collect()
    assert {"doc_id", "_text", "n_tokens", "n_bytes", "over_limit"} == set(rows[0].asDict())
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit, r._text) == (n, len(text.encode()), n > 512, f"clash{r.doc_id}")
    assert token_counts.count_tokens(table(spark, []), JSON).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.PieceLibrary(P.path("word_bpe_49k.json"))


def test_perfect_hash():
    keys = K.mix64(np.arange(5000, dtype=np.uint64))
    slots = bpe.PerfectHash(keys).find(keys)
    assert sorted(slots.tolist()) == list(range(5000))
    assert (bpe.PerfectHash(keys).find(K.mix64(np.arange(5000, 6000, dtype=np.uint64))) == -1).all()
    assert (bpe.PerfectHash(keys[:0]).find(keys[:3]) == -1).all()


def test_bpe_round_trip(spark):
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    docs = table(spark, TEXTS)
    for r in bpe.round_trip(docs, RANKS, with_ids=True).collect():
        text = TEXTS[r.doc_id] or ""
        ids = encoding.encode_ordinary(text)
        assert (r.ids, r.n_tokens) == (ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(docs, RANKS), RANKS).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in back} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.round_trip(table(spark, []), RANKS).collect() == []


def test_heap_merges_any_bytes():
    ranks = bpe.read_ranks(RANKS)
    merges = bpe.Merges(ranks)
    encoding = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abcdefthe iné日") for _ in range(rng.randint(1, 40)))
        want = encoding.encode_ordinary(text)
        assert want == ([ranks[text.encode()]] if text.encode() in ranks else merges.encode(text.encode()))


@pytest.mark.parametrize("n", [0, 1, 7, idcoder.BLOCK, idcoder.BLOCK + 1])
@pytest.mark.parametrize("kind", ["random", "few", "same", "steps"])
def test_id_files(n, kind):
    rng = np.random.default_rng(n)
    ids = {"random": rng.integers(0, 65536, n), "few": rng.integers(0, 5, n), "same": np.full(n, 65535), "steps": np.arange(n) // 3}[kind].astype(np.uint32)
    data = idcoder.pack_file(ids, pa.table({"doc_id": ["x"], "n_tokens": [n]}))
    listing, back = idcoder.unpack_file(data)
    assert np.array_equal(back, ids) and listing.column("n_tokens").to_pylist() == [n]
    if n > 100:
        broken = bytearray(data)
        broken[-5] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            idcoder.unpack_file(bytes(broken))
    if kind == "few" and n > 1000:
        assert len(data) < n


def test_hashes_do_not_depend_on_what_was_hashed_before(monkeypatch):
    one = np.array([ord("a")], np.uint32)
    spans = np.array([0]), np.array([1])
    later = K.hash_spans(one, *spans)
    monkeypatch.setattr(K, "_powers", type(K._powers)((0,), K._powers.dtype))
    assert K.hash_spans(one, *spans) == later
    fresh = subprocess.run([sys.executable, "-c", "import numpy as np\nfrom thicket.llm import textkit as K\nprint(K.hash_spans(np.array([97], np.uint32), np.array([0]), np.array([1]))[0])"], capture_output=True, text=True, check=True)
    assert int(fresh.stdout) == int(later[0])


def test_ids_of_all_sizes_and_uneven_blocks():
    rng = np.random.default_rng(3)
    for n in (idcoder.SHORT * 3 + 1, idcoder.BLOCK * 7 - 3):
        ids = np.concatenate([rng.integers(0, 1 << 32, n // 2), np.arange(n - n // 2) % 11]).astype(np.uint32)
        assert np.array_equal(idcoder.unpack_file(idcoder.pack_file(ids, pa.table({"n_tokens": [n]})))[1], ids)
    lengths = idcoder.block_lengths(idcoder.BLOCK * idcoder.LANES + 5)
    assert lengths.sum() == idcoder.BLOCK * idcoder.LANES + 5 and lengths.max() - lengths.min() <= 1 and lengths.max() <= idcoder.BLOCK


def test_each_block_stands_alone():
    ids = np.random.default_rng(4).integers(0, 300, 5000).astype(np.int32)
    prior = idcoder.Prior(idcoder.Prior.of(np.bincount(ids)))
    blocks, lengths = idcoder.encode_blocks(ids, prior)
    ends = np.cumsum(lengths)
    for i in (0, 2, len(blocks) - 1):
        assert np.array_equal(idcoder.decode_blocks(blocks[i : i + 1], lengths[i : i + 1], prior), ids[ends[i] - lengths[i] : ends[i]])


def sequential_cost(ids, prior):
    """Bits of a block by the mixture, an id at a time in exact arithmetic."""
    from fractions import Fraction

    slots, weights = {}, idcoder.BEGIN.tolist()
    x = before = 0
    bits = 0.0
    for new in ids:
        own = [(o, int(v)) for o, v in enumerate(np.concatenate(idcoder._slots(np.array([x], np.int32), np.array([before], np.int32))))]
        entry = [slots.get(k, (prior.n, 0)) for k in own]
        at = entry[1][1] * 8 + entry[0][1]
        w = [weights[at] & 0xFFFF, weights[at] >> 16]
        m = [v >> 8 for v in w]
        low, high = int(prior.upto[new]), int(prior.upto[new + 1])
        hits = [m[o] * (entry[o][0] == new) for o in (0, 1)]
        share = (256 - sum(m)) * (high - low) + (sum(hits) << prior.bits)
        bits -= np.log2(share / 2 ** (prior.bits + 8))
        for o in (0, 1):
            target = Fraction(hits[o] * (idcoder.MOST_WEIGHT << prior.bits), share)
            w[o] += (int(target) - w[o]) >> idcoder.SLOWNESS
            slots[own[o]] = (new, min(7, entry[o][1] + 1 if entry[o][0] == new else 1))
        weights[at] = w[1] << 16 | w[0]
        before, x = x, new
    return bits


def test_a_block_costs_what_the_mixture_says():
    rng = np.random.default_rng(5)
    ids = np.concatenate([rng.integers(0, 60, 400), np.tile(rng.integers(0, 60, 25), 8)]).astype(np.int32)
    prior = idcoder.Prior(idcoder.Prior.of(np.bincount(ids, minlength=60)))
    blocks, lengths = idcoder.encode_blocks(ids, prior)
    ends = np.cumsum(lengths)
    for data, n, e in zip(blocks, lengths.tolist(), ends.tolist()):
        assert 0 <= len(data) * 8 - sequential_cost(ids[e - n : e].tolist(), prior) < 80


def test_stored_documents(spark):
    tokenizer = Tokenizer.from_file(JSON)
    docs = table(spark, TEXTS).repartition(3)
    rows = sorted(idcoder.stored_documents(docs, JSON)[0].collect())
    at = 0
    for r, (i, text) in zip(rows, enumerate(TEXTS), strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert idcoder.stored_documents(table(spark, []), JSON)[0].collect() == []


def test_a_range_in_several_files(spark, tmp_path):
    docs = table(spark, [*TEXTS, *["one two three four"] * 40]).withColumn("doc_id", F.expr("if(doc_id % 5 = 0, null, doc_id div 3)"))
    files = idcoder.write_ids(docs, JSON, str(tmp_path), file_ids=1)
    whole = idcoder.write_ids(docs, JSON, str(tmp_path / "whole"))
    assert [sum(n) for _, n in files] == [sum(n) for _, n in whole]
    kind = "long"
    one, two = (sorted(map(str, idcoder.read_ids(spark, str(at), f, kind).collect())) for at, f in ((tmp_path, files), (tmp_path / "whole", whole)))
    assert one == two and len(one) == docs.count()


def brute_contamination(docs, items, width=10):
    lower = str.maketrans(decontaminate.UPPER, decontaminate.LOWER)

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))

    out = {}
    for i, text in enumerate(docs):
        w, hit, ids = words(text), set(), set()
        for item_id, item in items:
            x = words(item)
            size = min(width, len(x))
            for s in range(len(x) - size + 1) if x else ():
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == x[s : s + size]:
                        hit.update(range(p, p + size))
                        ids.add("null" if item_id is None else str(item_id))
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def test_contamination(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "the", "É", "é", "Ⅷ", "zz", "q1"]
    texts = [None, "", "...", *(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(40))]
    items = [(1, "a b"), (2, None), (3, " "), (10, "A-b the"), (None, "zz q1 é"), (4, texts[5]), (4, texts[6]), (5, "a b the a b the a b the a b the a b"), (6, texts[7].upper())]
    texts += [texts[5], "x " + (texts[7] or "") + " y", "THE a B the A b the A b THE a b nothing", "\x00a\x00b\x00"]
    docs = table(spark, texts).withColumnRenamed("_text", "row")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(docs, bench)[0].collect()
    want = brute_contamination(texts, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == want
    left = decontaminate.uncontaminated(docs.withColumnRenamed("row", "_hit"), bench).collect()
    assert {r.doc_id for r in left} == {i for i, x in want.items() if not x[-1]}
    assert decontaminate.contamination(docs.limit(0), bench)[0].collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0))[0].collect())


def test_rows_with_one_id_stay_apart(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "c"), (1, "a b c"), (None, "a b")], "doc_id long, text string")
    rows = decontaminate.contamination(docs, spark.createDataFrame([(7, "a b")], "item_id long, text string"))[0].collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in rows) == [(0, 2, 2), (1, 1, 0), (1, 3, 2), (1, 3, 2)]


def test_rows_go_for_their_own_text_alone(spark):
    rows = [(1, "a b c"), (1, "c"), (None, "a b"), (None, "clean"), (None, None), (2, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = decontaminate.uncontaminated(docs, spark.createDataFrame([(7, "a b")], "item_id long, text string"))
    assert Counter(map(tuple, left.collect())) == Counter([rows[1], *rows[3:]])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x blue x green"), (2, "red " + "x " * 30 + "blue green"), (3, "green blue red"), (4, "red blue")], "doc_id long, text string")
    tests = decontaminate.TestSet(spark.createDataFrame([(1, "red blue green")], "item_id long, text string"), "item_id", "text")
    index, _ = decontaminate.build_index(docs, "doc_id", "text", tests.vocabulary, tests.n_words)
    assert {r.doc for r in decontaminate.proximity_matches(index, tests, 6).collect()} == {1, 3}


def test_proximity_by_windows(spark):
    rng = random.Random(4)
    item = [f"t{i}" for i in range(40)]
    short = ["p", "q", "p", "r"]
    shuffled = rng.sample(item[:10], 10)
    texts = [" ".join(x) for x in (["x"] * 9 + item, item[15:25], ["x", *shuffled, "x"], item[:9], ["q", "x", "r", "p"], *(rng.choices(item[:12] + short, k=rng.randint(1, 80)) for _ in range(30)))]
    tests = decontaminate.TestSet(spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string"), "item_id", "text")
    index, _ = decontaminate.build_index(table(spark, texts), "doc_id", "text", tests.vocabulary, tests.n_words)
    name = {r.item: int(r.item_id) for r in tests.items.collect()}
    term = {r.word: r.term for r in tests.vocabulary.collect()}
    n = Counter(w for t in texts for w in t.split())
    got = {(r.doc, name[r.item], r.start, r["at"]) for r in decontaminate.proximity_matches(index, tests).collect()}
    want = set()
    for doc, text in enumerate(texts):
        words = text.split()
        for item_id, own in ((1, item), (2, short)):
            for start in range(max(1, len(own) - 9)):
                window = set(own[start : start + 10])
                rarest = min(window, key=lambda w: (n[w], term[w]))
                want |= {(doc, item_id, start, at) for at, w in enumerate(words) if w == rarest and window <= set(words[max(0, at - 20) : at + 21])}
    assert got == want
    assert {(0, 1, start) for start in range(31)} | {(1, 1, 15), (2, 1, 0)} <= {x[:3] for x in got}

