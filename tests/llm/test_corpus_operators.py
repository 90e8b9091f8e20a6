"""Fixity, language model, toxicity, embeddings, sharding, near duplicates: against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from thicket.llm import embeddings, kneser_ney, minhash, shared, sharding, textkit as K, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, ["en", "de", None][i % 3], "s" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)], DOCS)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2200)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long"))[0].collect()}
    assert got == {x: find(x) for x in linked}
    assert shared.components(spark.createDataFrame([], "a long, b long"))[0].collect() == []


def test_ranked(spark):
    rows = [(i % 7, i, None if i % 11 == 0 else i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, i long, size long").repartition(5)
    got = sorted((r.ordinal, r.i, r.before_size) for r in shared.ranked(df, ["k", "i"], "t", ["size"])[0].collect())
    at = 0
    for (ordinal, i, before), (_, j, size) in zip(got, sorted(rows, key=lambda r: r[:2]), strict=True):
        assert (i, before) == (j, at)
        at += size or 0
    assert [g[0] for g in got] == list(range(500))


def test_merkle_audit_finds_what_differs(spark):
    rng = random.Random(2)
    one, two, want = [], [], {}
    for archive in range(3):
        at = 0
        for i in range(400):
            length = rng.choice([10, 3000, 70000])
            row = (archive, at, length, f"d{archive}-{i}", archive * 1000 + i)
            one.append(row)
            lot = rng.random()
            if lot < 0.02:
                want[row[4]] = "missing"
            elif lot < 0.04:
                two.append((*row[:3], "other", row[4]))
                want[row[4]] = "altered"
            elif lot < 0.05:
                two.append((row[0], row[1], length + 1, *row[3:]))
                want[row[4]] = "altered"
            else:
                two.append(row)
            at += length
        two.append((archive, at + 5, 9, "new", -archive - 1))
        want[-archive - 1] = "extra"
    schema = "archive long, offset long, length long, digest string, record long"
    a, b = spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)
    assert {r.record: r.status for r in warc.audit(a, b)[0].collect()} == want
    assert warc.audit(a, a)[0].collect() == []
    assert warc.audit(a.limit(0), a.limit(0))[0].collect() == []


def brute_replicas(rows, archive_bytes):
    """{page_id: status} of audit_pages, by walking over the records."""
    def record(url, html):
        body = (html or "").encode()
        return b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: " + (url or "").encode() + b"\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"

    archives, place = {}, 0
    for i, url, html in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        data = record(url, html)
        archives.setdefault(place // archive_bytes, []).append((i, data))
        place += len(data)
    want = {}
    for archive, members in archives.items():
        whole, at = sum(len(d) for _, d in members), 0
        for i, data in members:
            at += len(data)
            if archive % 2 == 0 and at * 128 > whole * 127:
                want[i] = "missing"
            elif (i or 0) % 101 == 1 and len(data) > len(data.decode()[:40].encode()) or (i or 0) % 97 == 0 and data[:1] != b"w":
                want[i] = "altered"
    return want


@pytest.mark.parametrize("archive", [warc.ARCHIVE, 9000])
def test_audit_of_pages(spark, monkeypatch, archive):
    monkeypatch.setattr(warc, "ARCHIVE", archive)
    rows = [(i, None if i % 50 == 3 else f"http://x/{i}", None if i % 40 == 7 else "é" * (i % 9) + str(i)) for i in range(600)] + [(None, "u", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r.record: r.status for r in warc.audit_pages(pages)[0].collect()}
    assert found == brute_replicas(rows, archive) and {"missing", "altered"} == set(found.values())
    assert warc.audit_pages(pages.limit(0))[0].collect() == []


def test_audit_at_equal_offsets_and_of_nulls(spark):
    kind = "archive long, offset long, length long, digest string, record long"
    one = [(0, 0, 5, "a", 1), (0, 0, 5, "b", 2), (0, 0, 5, "c", 3), (0, 9, 5, None, 4), (0, 20, 5, None, 5), (0, 30, None, "x", 6), (0, 40, 1, "y", 7), (0, 40, 1, "y", 8)]
    two = [(0, 0, 5, "a", 1), (0, 0, 5, "Z", 2), (0, 0, 5, "c", 3), (0, 9, 5, "", 4), (0, 20, 5, None, 5), (0, 30, None, "x", 6), (0, 40, 1, "y", 7)]
    found = warc.audit(spark.createDataFrame(one, kind), spark.createDataFrame(two, kind))[0].collect()
    assert sorted((r.record, r.status, r.expected, r.found) for r in found) == [(2, "altered", "b", "Z"), (4, "altered", None, ""), (8, "missing", "y", None)]
    shifted = [(a, o + 1, n, d, r) for a, o, n, d, r in one]
    assert Counter(r.status for r in warc.audit(spark.createDataFrame(one, kind), spark.createDataFrame(shifted, kind))[0].collect()) == {"missing": 8, "extra": 8}


def brute_model(texts, held):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower)), None] for t in texts]
    train = [t for t, h in zip(tokens, held) if not h]
    c = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([None, *t[:-1]], t))
    n, v = sum(c.values()), len(c)
    of = lambda values: [Counter(values)[i] for i in (1, 2, 3, 4)]
    before = Counter(b for _, b in pairs)
    high, low = kneser_ney.discounts(of(pairs.values())), kneser_ney.discounts(of(before.values()))
    off = lambda k, d: d[min(k, 3) - 1] if k else 0
    total, spare = Counter(), Counter()
    for (a, _), k in pairs.items():
        total[a] += k
        spare[a] += off(k, high)

    def probability(a, b):
        p = 1 / (v + 1) if not pairs else (before[b] - off(before[b], low) + sum(off(k, low) for k in before.values()) / (v + 1)) / len(pairs)
        return p if not total[a] else (pairs[a, b] - off(pairs[a, b], high) + spare[a] * p) / total[a]

    return [(len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(probability(a, b)) for a, b in zip([None, *t[:-1]], t))) for t in tokens]


@pytest.mark.parametrize("count", [0, 1, 60])
def test_kneser_ney(spark, count):
    rng = random.Random(count)
    texts = [None, "", " \t", "One one ONE é É", "x" * 3000][:count] + [" ".join(rng.choice("a b c d e The the zz é".split()) for _ in range(rng.randint(0, 40))) for _ in range(count)]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    docs = documents(spark, texts).withColumn("held_out", kneser_ney.held_out())
    model = kneser_ney.train(docs.where("not held_out"))
    rows = sorted(kneser_ney.score(docs.select("doc_id", "held_out", "text"), model).collect())
    for r, want, h in zip(rows, brute_model(texts, held), held, strict=True):
        assert r.held_out == h
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert (r.base_score, r.score) == pytest.approx(want[3:], rel=1e-9, abs=1e-9)
    if count > 5:
        assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def brute_trigrams(texts, held):
    """The score of each text by a model of order 3 of those not held out."""
    tokens = [["", *(t or "").split(), ""] for t in texts]
    train = [t for t, h in zip(tokens, held) if not h]
    triples = Counter(x for t in train for x in zip(t, t[1:], t[2:]))
    raw = Counter(x for t in train for x in zip(t, t[1:]))
    preceded = Counter((b, c) for _, b, c in triples)
    pairs = {p: k if p[0] == "" else preceded[p] for p, k in raw.items()}
    before = Counter(b for _, b in raw)
    d1, d2, d3 = (kneser_ney.discounts([list(x.values()).count(i) for i in (1, 2, 3, 4)]) for x in (before, pairs, triples))
    v = len({w for t in train for w in t[1:]})
    off = lambda k, d: d[min(k, 3) - 1] if k else 0

    def level(count, of, d, low):
        total = sum(of)
        return low if not total else (count - off(count, d) + sum(off(k, d) for k in of) * low) / total

    def probability(a, b, c):
        p = level(before[c], before.values(), d1, 1 / (v + 1))
        p = level(pairs.get((b, c), 0), [k for x, k in pairs.items() if x[0] == b], d2, p)
        return p if a is None else level(triples[a, b, c], [k for x, k in triples.items() if x[:2] == (a, b)], d3, p)

    return [sum(math.log10(probability(*x)) for x in zip([None, *t], t, t[1:])) for t in tokens]


def test_triples_of_a_range():
    rng = np.random.default_rng(3)
    low, high = 7, 60
    pairs = np.concatenate([np.full(500, 7), np.full(64, 9), np.full(63, 10), rng.integers(11, 59, 400)]).astype(np.uint64)
    words = np.concatenate([np.arange(500) * 3, np.arange(64), np.arange(63), rng.integers(0, 40, 400)]).astype(np.uint64)
    keys = np.unique(pairs << np.uint64(32) | words)
    counts = rng.choice([1, 2, 3, 4, 254, 255, 256, 70000], len(keys))
    part = kneser_ney.Triples(kneser_ney.Triples.packed(keys, counts, low, high))
    want = dict(zip(keys.tolist(), counts.tolist(), strict=True))
    asked = [(c, w) for c in range(low, high) for w in range(0, 1600, 1 if c < 11 else 7)]
    got = part.counts(np.array([c - low for c, _ in asked]), np.array([w for _, w in asked], np.uint32))
    assert got.tolist() == [want.get(c << 32 | w, 0) for c, w in asked]
    of = [[k for x, k in want.items() if x >> 32 == c] for c in range(low, high)]
    assert part.sums(np.arange(high - low)).T.tolist() == [[sum(x), x.count(1), x.count(2), sum(k > 2 for k in x)] for x in of]


def test_kneser_ney_of_order_3(spark):
    rng = random.Random(5)
    texts = [None, "", "a", "z z", "a b " * 300, *(" ".join(rng.choice("a a a b c d e f g h".split()) for _ in range(rng.randint(0, 40))) for _ in range(60)), "unseen a unseen b a"]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 or "unseen" in (t or "") for i, t in enumerate(texts)]
    docs = documents(spark, texts)
    model = kneser_ney.train(docs.where(~docs.doc_id.isin([i for i, h in enumerate(held) if h])), order=3)
    rows = sorted(kneser_ney.score(docs.select("doc_id", "text"), model).collect())
    assert [r.score for r in rows] == pytest.approx(brute_trigrams(texts, held), rel=1e-9, abs=1e-9)


def test_model_of_order_3_of_little(spark):
    for texts in ([], [""], ["a"]):
        model = kneser_ney.train(documents(spark, texts), order=3)
        got = [r.score for r in sorted(kneser_ney.score(documents(spark, ["a b", ""]).select("doc_id", "text"), model).collect())]
        assert got == pytest.approx(brute_trigrams([*texts, "a b", ""], [*(False for _ in texts), True, True])[len(texts) :] if texts else [0, 0], abs=1e-9)


def test_model_of_nothing(spark):
    model = kneser_ney.train(documents(spark, []))
    assert [(r.n_tokens, r.n_known, r.score) for r in kneser_ney.score(documents(spark, ["a b"]).select("doc_id", "text"), model).collect()] == [(3, 0, 0.0)]


def test_toxicity_learns_and_scores(spark):
    rng = random.Random(4)
    syllables = ["ka", "lo", "mi", "ter", "on", "ü"]

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    texts, toxic = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randint(5, 80))]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = "grmpf" + rng.choice(syllables)
        texts.append(" ".join(words))
        toxic.append(int(bad))
    texts += [None, "", "!!"]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([*enumerate(toxic), (5, None), (None, 1), (7, toxic[7])], "doc_id long, toxic long")
    model = toxicity.train(docs, labels)
    rows = sorted(toxicity.score_documents(docs.select("doc_id", toxicity.fold().alias("held_out"), "text", docs.lang.alias("_text")), model).collect())
    held = [(r.score >= toxicity.THRESHOLD, toxic[r.doc_id]) for r in rows if r.doc_id < 600 and r.held_out]
    assert [r.held_out for r in rows] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(603)]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert [r.score for r in rows[-3:]] == pytest.approx([rows[-1].score] * 3, abs=1e-6)
    again = toxicity.score_documents(docs.repartition(7), model).collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({r.doc_id: r.score for r in rows}, abs=1e-6)


def loop_score(model, text):
    """A score word by word and window by window."""
    import regex

    def buckets(word):
        code = lambda w: int(K.hash_spans(np.array([ord(c) for c in w], np.uint32), np.array([0]), np.array([len(w)]))[0])
        return [code(word) % toxicity.BUCKETS] + [int(K.mix64(np.array([code(word[:k])], np.uint64) + np.uint64(k))[0]) % toxicity.BUCKETS for k in toxicity.BEGINNINGS]

    words = [sum(model.embedding[b].astype(float) for b in buckets(w)) for w in regex.findall(r"[\p{L}\p{N}\p{M}]+", (text or "").lower())]
    words += [np.zeros(toxicity.DIM)] * toxicity.PAD
    total = model.offset
    for n, (width, kernel) in enumerate(model.filters.items()):
        for f in range(toxicity.FILTERS):
            best = max(sum(float(words[at + j] @ kernel[j, :, f]) for j in range(width)) for at in range(len(words) - width + 1))
            total += max(best + float(model.bias[n * toxicity.FILTERS + f]), 0) * float(model.weight[n * toxicity.FILTERS + f])
    return 1 / (1 + math.exp(-max(-30, min(30, model.scale[0] * total + model.scale[1]))))


def test_toxicity_scores_equal_a_loop(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Bad", "good", "née", "x1", "longerword", "longerwords"]) for _ in range(rng.randint(1, 30))) for _ in range(80)]
    labels = np.array([int("Bad x1" in t) for t in texts])
    model = toxicity.fit(texts, labels, ["en"] * 80, 0.3)
    texts += [None, "", "!", "bad" * 2000, "one two"]
    rows = sorted(toxicity.score_documents(documents(spark, texts).select("doc_id", "text"), model).collect())
    assert [r.score for r in rows] == pytest.approx([loop_score(model, t) for t in texts], abs=1e-4)


def test_the_sample_is_bounded_by_texts(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, *rest: sent.append((texts, labels.tolist())))
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, f"text {i}", "en", "s", 0) for i in range(200)] + [(ids[0], f"again {j}", "de", "s", 0) for j in range(500)] + [(ids[1], "z" * (toxicity.SAMPLE_CHARS + 1), "en", "s", 0)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic long")
    for n in (1, 6):
        toxicity.train(spark.createDataFrame(rows, DOCS).repartition(n), labels, rows=10)
    assert sent[0] == sent[1] and len(sent[0][0]) == 20 and sum(sent[0][1]) == 10


def test_toxicity_without_labels(spark):
    docs = documents(spark, ["a b", None])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic long"))
    assert all(r.score < toxicity.THRESHOLD for r in toxicity.score_documents(docs, model).collect())


def test_embedding_links(spark):
    rng = np.random.default_rng(6)
    rows, i = [], 0
    for group in range(60):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 8)) if group else 150):
            v = centre + rng.normal(size=16) * rng.choice([0, 0.03, 0.06, 0.12])
            rows.append((i, [float(x) for x in v.astype(np.float32)], group % 3))
            i += 1
    extra = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] * 16, [1.0, 2.0]]
    for v in extra:
        rows.append((i, v, 0))
        i += 1
    rows.append((i, rows[0][1], None))
    rows.append((i + 1, rows[3][1], rows[3][2]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    sound = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    links = {r[0]: [] for r in rows}
    for a in sound:
        for b in sound:
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[a[0]].append(b[0])
    component = {}
    for k in sorted(links):
        if k not in component:
            stack = [k]
            while stack:
                x = stack.pop()
                if x not in component:
                    component[x] = k
                    stack += links[x]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df)[0].collect()}
    assert got == {k: (len(links[k]), component[k], component[k] == k) for k in links}
    assert embeddings.near_duplicates(df.limit(0))[0].collect() == []


def test_recall_over_ten_thousand_vectors(spark):
    # Planted pairs between the threshold and 0.995, half of the strangers in one label: against all pairs.
    rng = np.random.default_rng(17)
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    x = unit(rng.normal(size=(10_000, 64)))
    label = np.where(np.arange(10_000) % 2 == 0, 0, np.arange(10_000) % 40)
    noise = rng.normal(size=(1500, 64))
    noise = unit(noise - (noise * x[:1500]).sum(axis=1, keepdims=True) * x[:1500])
    cosine = rng.uniform(0.9801, 0.995, 1500)[:, None]
    x, label = np.concatenate([x, cosine * x[:1500] + np.sqrt(1 - cosine**2) * noise]), np.concatenate([label, label[:1500]])
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int")
    linked = (unit(x) @ unit(x).T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df)[0].collect()}
    found, wanted = sum(got.values()), int(linked.sum())
    assert wanted >= 3000 and all(got[i] <= n for i, n in enumerate(linked.sum(axis=1)))
    assert found >= 0.999 * wanted


@pytest.mark.parametrize("tile", [4096, 300])
def test_links_in_a_concentrated_label(spark, monkeypatch, tile):
    # All vectors lie at a cosine of about 0.95 with each other: strangers fill the windows.
    monkeypatch.setattr(embeddings, "RUN_TILE", tile)
    rng = np.random.default_rng(12)
    centre = rng.normal(size=64)
    unit = lambda z: z / np.linalg.norm(z, axis=-1, keepdims=True)

    def around(z, cosine):
        """4000 unit vectors at that cosine with the vector, or each with its own."""
        z, y = unit(z), rng.normal(size=(4000, 64))
        return cosine * z + np.sqrt(1 - cosine**2) * unit(y - (y * z).sum(axis=-1, keepdims=True) * z)

    x = around(centre, np.sqrt(0.95))
    x = np.concatenate([x, around(x, 0.981)[:300]])
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").selectExpr("*", "1 as label")
    linked = (unit(x) @ unit(x).T >= 0.98) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df)[0].collect()}
    assert [got[i][0] for i in range(len(x))] == linked.sum(axis=1).tolist()
    assert linked[np.arange(300), 4000 + np.arange(300)].all()
    assert all(got[4000 + i][1] == got[i][1] for i in range(300))


def test_runs_find_pairs_in_every_pass_that_they_need(spark, monkeypatch):
    # Rows that cost nothing make short runs the cheapest.
    monkeypatch.setattr(embeddings, "ROW", 0)
    rng = np.random.default_rng(13)
    x = rng.normal(size=(2000, 64))
    y = x[:200] + rng.normal(size=(200, 64)) * 0.195
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    near = np.flatnonzero((unit(x[:200]) * unit(y)).sum(axis=1) >= 0.98)
    rows = list(enumerate(np.concatenate([x, y]).tolist()))
    vectors = spark.createDataFrame(rows, "id long, vector array<double>").selectExpr("id", "1L as group", "64 as dimension", "vector", "id as component")
    [plan] = embeddings.run_bits(vectors, 0.98).collect()
    assert plan.bits > 0 and plan.turns == embeddings.turns(plan.bits)
    found = {tuple(sorted(r)) for r in embeddings.run_links(vectors, 0.98)[0].collect()}
    assert len(near) > 50 and found == {(int(i), 2000 + int(i)) for i in near}


def test_large_components_are_counted_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    rng = np.random.default_rng(8)
    x = rng.normal(size=8) + rng.normal(size=(90, 8)) * 0.08
    members = spark.createDataFrame([(0, i, v.tolist(), 1 + i % 3) for i, v in enumerate(x)], "component long, id long, vector array<double>, copies long")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & ~np.eye(90, dtype=bool)
    got = {r.id: r.n for r in embeddings.component_links(members, 0.98).collect()}
    assert got == {i: int(n) for i, n in enumerate(linked @ (1 + np.arange(90) % 3))}


def test_hilbert_neighbours_touch():
    bits, n = 3, 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij")).reshape(n, -1)
    index = sharding.hilbert(list(cells), bits)
    assert sorted(index.tolist()) == list(range(1 << bits * n))
    path = cells[:, np.argsort(index)]
    assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
@pytest.mark.parametrize("count", [0, 5, 333])
def test_sharding(spark, law, count):
    texts = [None if i % 50 == 1 else "é" * (i * 7919 % 300) for i in range(count)]
    rows = sharding.shard_documents(documents(spark, texts), law=law)[0].collect()
    assert sorted(r.doc_id for r in rows) == list(range(count))
    by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(16)}
    assert all(x == list(range(len(x))) for x in by.values()) and {r.shard for r in rows} <= set(range(16))
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), law, None)
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    elif count > 100:
        sums = [sum(r.size for r in rows if r.shard == s) for s in range(16)]
        assert max(sums) - min(sums) <= 2 * max(r.size for r in rows)
    order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_sharding_by_brute_force_and_groups(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, "", "same text", "x" * 50, f"own {i}"]), rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    langs, sources = {None: 0, "de": 21, "en": 42}, {None: 0, "a": 21, "b": 42}
    cell = {r.doc_id: (langs[r.lang], sources[r.source], r.c, r.h) for r in docs.selectExpr("doc_id", "lang", "source", "cast(least(floor(log2(octet_length(coalesce(text, '')) + 2) * 3), 63) as int) c", "xxhash64(coalesce(text, '')) h").collect()}
    first = {}
    for i, text, *_ in rows:
        first[text or ""] = min(first.get(text or "", i), i)
    cells = [(*cell[first[t or ""]][:2], cell[i][2], cell[i][3] % 64) for i, t, *_ in rows]
    curve = sharding.hilbert([np.array(c) for c in zip(*cells)])
    order = sorted(range(300), key=lambda i: (int(curve[i]), cell[i][3], i))
    got = sharding.shard_documents(docs)[0].collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] == order
    shards = {}
    for r in got:
        shards.setdefault(rows[r.doc_id][1] or "", set()).add(r.shard)
    size = Counter(t or "" for _, t, *_ in rows)
    assert all(len(s) <= -(-size[t] // 18) + 1 for t, s in shards.items())


def test_shards_as_files_can_be_skipped(spark, tmp_path):
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, f"{i:04d}" + "y" * rng.choice([3, 60, 900, 9000]), rng.choice(["en", "de", "fr", "es"]), rng.choice("abcd"), 0) for i in range(800)], DOCS)
    placed, _ = sharding.shard_documents(docs)
    sharding.write_shards(docs, placed.drop("size"), "doc_id", f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == 800 and {r.shard for r in back.select("shard").distinct().collect()} == set(range(16))
    with_size = back.selectExpr("shard", "length(text) as size", "lang")
    ranges = {r.shard: (r.least, r.most) for r in sharding.pruned(with_size, "size").collect()}
    assert sum(a <= 9004 <= b for a, b in ranges.values()) <= 9  # a filter on size skips the others
    languages = {}
    for r in with_size.select("shard", "lang").distinct().collect():
        languages.setdefault(r.shard, set()).add(r.lang)
    assert sum("fr" in x for x in languages.values()) <= 10  # and one on language others again
    slots = {}
    for r in back.select("doc_id", "shard", "slot").collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def brute_groups(texts, size=5, threshold=0.8):
    import regex

    words = [regex.findall(r"[\p{L}\p{N}\p{M}]+", (t or "").lower()) for t in texts]
    weights = [Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter() for w in words]

    def similarity(x, y):
        return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())

    component = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if weights[i] and weights[j] and weights[i].keys() & weights[j].keys() and similarity(weights[i], weights[j]) >= threshold:
                a, b = sorted((component[i], component[j]))
                component = [a if c == b else c for c in component]
    return component


def near_texts(seed):
    rng = random.Random(seed)
    texts = [None, "", "...", "one two", "One, two!", "a b c d", "x " * 400, "x " * 500]
    for _ in range(12):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(6, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = f"v{rng.randint(0, 500)}"
            texts.append(" ".join(copy).upper() + rng.choice(["", "!", " tail"]))
    rng.shuffle(texts)
    return texts


def test_near_duplicates(spark):
    texts = near_texts(1)
    docs = documents(spark, texts).withColumnRenamed("source", "_gone").withColumnRenamed("lang", "bands").repartition(3)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs)[0].collect()}
    want = brute_groups(texts)
    assert got == dict(enumerate(want))
    left = minhash.deduplicated(docs.unionAll(docs.where("doc_id < 3"))).collect()
    assert sorted(r.doc_id for r in left) == sorted(set(want))
    assert set(left[0].asDict()) == set(docs.columns)
    assert minhash.near_duplicates(docs.limit(0))[0].collect() == []


def test_near_duplicates_in_small_tiles_and_blocks(spark, monkeypatch):
    for name, value in (("TILE", 4), ("TILE_BYTES", 300), ("BLOCK", 2), ("STAR_ROUNDS", 1)):
        monkeypatch.setattr(minhash, name, value)
    texts = near_texts(3) + [" ".join(f"q{j}" for j in range(40)) + f" {i}" for i in range(30)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, texts).repartition(5))[0].collect()}
    assert got == dict(enumerate(brute_groups(texts)))


def test_rows_left_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    texts = near_texts(5)
    rows = [(rng.choice([None, i % 40]), t, "en", "s", i) for i, t in enumerate(texts + texts[:20])]
    docs = spark.createDataFrame(rows, DOCS)
    left = [Counter(map(tuple, minhash.deduplicated(docs.repartition(n)).drop("n_chars").collect())) for n in (1, 7)]
    assert left[0] == left[1]


def test_near_duplicates_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    third = " ".join(f"u{i}" for i in range(60))
    gone = [(None, text, 1), (None, text + " end", 2), (5, third + " end", 3), (None, other, 4)]
    stay = [(9, text, 5), (9, "another text of this id", 6), (4, third, 7), (5, "one more of that", 8), (None, None, 9), (None, None, 10), (None, "!", 11)]
    docs = spark.createDataFrame([*gone, *stay, (None, other, 4)], "doc_id long, text string, _key long")
    left = Counter(map(tuple, minhash.deduplicated(docs).collect()))
    assert left == Counter([*stay, gone[3]])


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(9)
    shingle = np.sort(rng.integers(1, 1 << 62, 60).astype(np.uint64))
    x, y = rng.integers(1, 5, 60), rng.integers(1, 5, 60)
    x[:10], y[-10:] = 0, 0
    doc = np.repeat([0, 1], [50, 50])
    signature = minhash.signatures(doc, np.concatenate([shingle[10:], shingle[:-10]]), np.concatenate([x[10:], y[:-10]]), 2, 8000)
    exact = minhash.similarity((shingle[10:], x[10:]), (shingle[:-10], y[:-10]))
    assert (signature[0] == signature[1]).mean() == pytest.approx(exact, abs=0.03)


def stage_tables(spark, at, rows, labels, items):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic long").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return spark.read.parquet(f"{at}/documents.parquet")


def test_each_stage_by_brute_force(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    from thicket.llm.bpe import read_ranks

    rng = random.Random(21)
    bench = [f"bench{i}" for i in range(15)]
    base = [" ".join(f"k{rng.randint(0, 200)}" for _ in range(30)) for _ in range(60)]
    texts = base + [f"{t} tail" for t in base[:10]] + [f"{base[20]} {' '.join(bench[2:13])} end", f"{base[21]} {' '.join(bench[2:11])} end", None, "", "!", "grmpfel " * 3 + base[30]]
    rows = [(rng.choice([None, i % 50]), t, "en", "s", i) for i, t in enumerate(texts)] + [(3, base[40], "en", "s", 0), (3, base[40], "en", "s", 0)]
    labels = [(i, int(i % 3 == 0)) for i in range(50)]
    docs = stage_tables(spark, tmp_path, rows, labels, [(1, " ".join(bench)), (2, None), (3, "")])
    docs = docs.withColumns({"score": docs.n_chars, "_key": docs.n_chars, "ids": docs.lang, "row": docs.lang, "hit": docs.lang})
    stages = dict(corpus_pipeline.STAGES)
    plain = lambda frame: sorted(map(str, frame.collect()))

    for name in ("toxicity", "near_duplicates", "decontamination"):
        runs = [stages[name](spark, docs.repartition(n), str(tmp_path)) for n in (1, 7)]
        assert runs[0].columns == docs.columns and plain(runs[0]) == plain(runs[1]), name
        assert stages[name](spark, docs.limit(0), str(tmp_path)).collect() == []

    # Toxicity: by the score and its language's threshold, row by row.
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = Counter(r.text for r in stages["toxicity"](spark, docs, str(tmp_path)).collect())
    assert left == Counter(t for _, t, *_ in rows if loop_score(model, t) < model.thresholds.get("en", toxicity.THRESHOLD))
    # Near duplicates: of each group the smallest id, null last; other texts of that id stay.
    group = brute_groups([t for _, t, *_ in rows])
    best = {}
    for g, (i, t, *_) in zip(group, rows):
        best[g] = min(best.get(g, (True, 0)), (i is None, i or 0)) if g in best else (i is None, i or 0)
    left = [(r.doc_id, r.text) for r in stages["near_duplicates"](spark, docs, str(tmp_path)).collect()]
    worded = {g for g, (_, t, *_) in zip(group, rows) if any(c.isalnum() for c in t or "")}
    of = {t: g for g, (_, t, *_) in zip(group, rows)}
    assert Counter(of[t] for _, t in left if of[t] in worded) == Counter(dict.fromkeys(worded, 1))
    assert all((i is None, i or 0) == best[of[t]] for i, t in left if of[t] in worded)
    # Benchmark: ten words of the item in a row, not nine.
    left = Counter(r.text for r in stages["decontamination"](spark, docs, str(tmp_path)).collect())
    assert left == Counter(t for _, t, *_ in rows if " ".join(bench[2:12]) not in (t or ""))
    # Encoding: whole texts, as the library.
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = Counter((r.doc_id, tuple(r.ids)) for r in stages["byte_level_bpe"](spark, docs, str(tmp_path)).collect())
    assert got == Counter((i, tuple(encoding.encode_ordinary(t or ""))) for i, t, *_ in rows)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "byte_level_bpe"]
    rng = random.Random(11)
    texts = [" ".join(f"k{rng.randint(0, 300)}" for _ in range(40)) for _ in range(200)]
    toxic = [int(i % 5 == 0) for i in range(200)]
    texts = [t + " grmpfel" * 3 if x else t for t, x in zip(texts, toxic)]
    copies = {200: 1, 201: 2, 202: 3}
    texts += [texts[i] + " more" for i in copies.values()]
    item = " ".join(f"bench{i}" for i in range(14))
    texts += [f"{texts[6]} x {item}", None, ""]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(rows) == set(range(len(texts))) - {i for i in range(200) if toxic[i]} - set(copies) - {203}
    assert rows[204].n_tokens == 0 and rows[204].ids == []
