"""Documents through the whole engine, against the sequential model and case by case."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from thicket import cli
from thicket.functions.text import canonical_url, u64
from thicket.operators import groups as grouping, nodes as N, order, scc, validate
from thicket.operators.groups import join_groups, numbered
from thicket.plans.normalize import normalize
from thicket.sources import documents as D

from . import model


def docs_of(spark, docs):
    return spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in docs.items()], "doc_id string, text string")


def folder(name, *children, **more):
    return {"type": "folder", "name": name, "children": list(children), **more}


def url(address, **more):
    return {"type": "url", "name": address, "url": address, **more}


def bar(*children, **roots):
    return {"version": 1, "checksum": "c", "roots": {"bar": {"type": "folder", "children": list(children)}, **{k: {"type": "folder", "children": v} for k, v in roots.items()}}}


def trees(result, docs, spark):
    return {r.doc_id: json.loads(r.text) for r in D.nest(docs, result.nodes).collect()}


def random_forest(rng):
    names = ["Work", " work", "WORK ", "caf\u00e9", "cafe\u0301", "a", "b", "", None, "\u00a0b"]

    def node(depth):
        kind = rng.random()
        given = {}
        for k, values in (("date_added", ["5", "05", "x", "+7", "18446744073709551616", None]), ("id", ["7", "007", "10", "z", None]), ("guid", ["g", "h", None]), ("date_modified", ["3", "4", "q", None]), ("date_last_used", ["1", "2", None])):
            v = rng.choice(values)
            if v is not None:
                given[k] = v
        if rng.random() < 0.5:
            given["visit_count"] = rng.randint(0, 2)
        if kind < 0.45 and depth < 5:
            name = rng.choice(names)
            return {"type": "folder", **({} if name is None else {"name": name}), "children": [node(depth + 1) for _ in range(rng.randint(0, 4))], **given}
        if kind < 0.95:
            return {"type": "url", "name": rng.choice("xyz"), "url": rng.choice([" HTTP://A.com/X#f", "http://a.com/X", "http://a.com/x", "b", "b#c", "http://Q?Z"]), **given}
        return {"type": "separator", "name": "s"}

    return {"roots": {k: {"type": "folder", "children": [node(1) for _ in range(rng.randint(0, 5))]} for k in rng.sample(["bar", "other", "Z", "é"], rng.randint(1, 3))}}


def test_random_forests_equal_the_sequential_model(spark):
    rng = random.Random(12)
    docs = {f"d{i}": random_forest(rng) for i in range(80)}
    frame = docs_of(spark, docs)
    nodes = D.flatten(frame)
    places: dict = {}
    for r in N.arena_order(nodes).collect():
        places.setdefault(r.doc_id, {})[r.path] = r.position
    result = normalize(nodes)
    got: dict = {k: {} for k in docs}
    for r in result.nodes.collect():
        got[r.doc_id][r.path] = (r.new_parent, r.position, r.visit_count, r.date_modified)
    stats = {r.doc_id: {k: v for k, v in r.asDict().items() if k != "doc_id"} for r in result.stats.collect()}
    logs: dict = {k: [] for k in docs}
    for r in result.events.orderBy("doc_id", "seq").collect():
        assert r.seq == 1 + len(logs[r.doc_id]) and json.loads(r.payload)["type"] == r.type
        logs[r.doc_id].append(json.loads(r.payload))
    for k, doc in docs.items():
        tree, counts, arena, log = model.normalize(doc)
        assert [e for e in logs[k] if e["type"] != "scc_computed"] == log, k
        assert places[k] == {p: i + 1 for i, p in enumerate(arena)}
        assert got[k] == tree, k
        assert stats[k] == counts
    again = normalize(D.flatten(D.nest(frame, result.nodes)))
    changed = again.stats.where("folders_merged + urls_deduped + folders_pruned > 0")
    assert changed.count() == 0
    left = {(r.doc_id, r.rule) for r in result.violations.collect()}
    assert all(rule == "folder_name_not_unique" for _, rule in left)


def test_cases(spark):
    docs = {
        "nfc": bar(folder("caf\u00e9", url("http://a")), folder("cafe\u0301", url("http://b"))),
        "outermost": bar(folder("J", folder("Z", url("http://a"))), folder("Z", url("http://b"))),
        "visits": bar(folder("F", url("http://EX.com/p#x", id="2", visit_count=1), url("http://ex.com/p", id="1", visit_count=10))),
        "empty": bar(folder("E"), url("http://a")),
        "siblings": bar(url("http://b.com"), folder("q"), {"type": "separator"}, folder("p"), url("http://a.com")),
        "extra": {**bar(url("http://a", zeta=[1, {"k": None}], alpha="x")), "other": {"y": 1}, "x_merge_meta": 5},
        "cross": bar(folder("  Work ", url("http://a")), other=[folder("work", url("http://b"))]),
        "tie": bar(folder("T", url("http://a", id="10"), url("http://a", id="5"))),
    }
    frame = docs_of(spark, docs)
    result = normalize(D.flatten(frame))
    stats = {r.doc_id: (r.folders_merged, r.urls_deduped, r.folders_pruned) for r in result.stats.collect()}
    assert stats == {"nfc": (1, 0, 0), "outermost": (1, 0, 1), "visits": (0, 1, 0), "empty": (0, 0, 1), "siblings": (0, 0, 2), "extra": (0, 0, 0), "cross": (1, 0, 0), "tie": (0, 1, 0)}
    tree = trees(result, frame, spark)
    top = lambda k: tree[k]["roots"]["bar"].get("children", [])
    assert len(top("nfc")) == 1 and len(top("nfc")[0]["children"]) == 2
    assert [c["name"] for c in top("outermost")] == ["Z"] and len(top("outermost")[0]["children"]) == 2
    assert [c["id"] for c in top("visits")[0]["children"]] == ["1"] and [c["id"] for c in top("tie")[0]["children"]] == ["5"]
    assert [c.get("url") or c["type"] for c in top("siblings")] == ["http://a.com", "http://b.com", "separator"]
    assert tree["extra"] == {"checksum": "c", "roots": {"bar": {"type": "folder", "children": [{"type": "url", "name": "http://a", "url": "http://a", "alpha": "x", "zeta": [1, {"k": None}]}]}}, "version": 1, "other": {"y": 1}}
    assert list(top("extra")[0]) == ["type", "name", "url", "alpha", "zeta"]
    assert "children" not in tree["cross"]["roots"]["other"]
    assert {(r.merged_from, r.merged_into) for r in result.merged_from.where("doc_id = 'cross'").collect()} == {("other/0", "bar/0")}
    log = [json.loads(r.payload) for r in result.events.where("doc_id = 'visits'").orderBy("seq").collect()]
    assert [e["type"] for e in log][0] == "phase_started" and log[-1]["type"] == "finished" and log[-1]["stats"]["urls_deduped"] == 1
    assert {"type": "url_deduped", "folder_path": "bar/0", "canonical_url": "http://ex.com/p", "removed": 1} in log


def test_names_shared_with_roots_are_reported(spark):
    doc = {"roots": {"a": {"type": "folder", "name": "Work", "children": [folder("work", url("http://a"))]}}}
    result = normalize(D.flatten(docs_of(spark, {"d": doc})))
    assert [(r.rule, r.detail) for r in result.violations.collect()] == [("folder_name_not_unique", "work")]


def test_children_of_other_types_are_quarantined(spark):
    odd = bar({"type": "url", "url": "http://a", "children": [folder("x")]})
    result = normalize(D.flatten(docs_of(spark, {"odd": odd, "fine": bar(url("http://a"))})))
    assert {r.doc_id for r in result.nodes.select("doc_id").distinct().collect()} == {"fine"}
    assert [(r.doc_id, r.rule) for r in result.violations.collect()] == [("odd", "children_of_other_type")]


def test_cycles_of_identities(spark):
    doc = bar(folder("A", folder("B", folder("A", guid="g1"), guid="g2"), guid="g1"))
    nodes = D.flatten(docs_of(spark, {"d": doc}))
    v, e = N.identity_vertices(nodes), N.identity_edges(nodes)
    assert [tuple(r) for r in scc.summary(v, e, scc.strongly_connected(v, e)).collect()] == [("d", 3, 3, 2, 1)]


@pytest.mark.parametrize("edges,want", [([(1, 1)], {1: (1, 1, True)}), ([(1, 2), (2, 1)], {1: (1, 2, True), 2: (1, 2, True)}), ([(1, 2), (2, 3)], {i: (i, 1, False) for i in (1, 2, 3)})])
def test_small_graphs(spark, edges, want):
    e = spark.createDataFrame([("d", *x) for x in edges], "doc_id string, src long, dst long")
    v = e.selectExpr("doc_id", "src key").union(e.selectExpr("doc_id", "dst key")).distinct()
    assert {r.key: (r.component, r.component_size, r.is_cyclic) for r in scc.strongly_connected(v, e).collect()} == want


@pytest.mark.parametrize("local_edges", [scc.LOCAL_EDGES, 0])
def test_random_graphs(spark, local_edges):
    rng = random.Random(7)
    rows, keys = [], []
    for d in range(12):
        n = rng.randint(1, 14)
        keys += [(f"g{d}", k) for k in range(n)]
        rows += [(f"g{d}", rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 2 * n))]
    reach = {}
    for d, k in keys:
        seen, todo = set(), [k]
        while todo:
            x = todo.pop()
            for dd, a, b in rows:
                if dd == d and a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[d, k] = seen
    want = {(d, k): min([k, *(j for j in reach[d, k] if k in reach[d, j])]) for d, k in keys}
    got = scc.strongly_connected(spark.createDataFrame(keys, "doc_id string, key int"), spark.createDataFrame(rows, "doc_id string, src int, dst int"), local_edges).collect()
    assert {(r.doc_id, r.key): r.component for r in got} == want
    assert all(r.is_cyclic == (r.key in reach[r.doc_id, r.key]) for r in got)


def test_a_long_chain_ends_in_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(scc, "staged", lambda df, name, staged=scc.staged: rounds.append(name) or staged(df, name))
    n = 400
    key = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 40))
    edges = spark.range(n).select(F.lit("d").alias("doc_id"), key(F.col("id")).alias("src"), key(F.col("id") + 1).alias("dst"))
    back = spark.createDataFrame([(n, n - 5)], "a long, b long").select(F.lit("d").alias("doc_id"), key(F.col("a")).alias("src"), key(F.col("b")).alias("dst"))
    vertices = spark.range(n + 1).select(F.lit("d").alias("doc_id"), key(F.col("id")).alias("key"))
    sizes = sorted(r.component_size for r in scc.strongly_connected(vertices, edges.unionAll(back), 0).collect())
    assert sizes == [1] * (n - 5) + [6] * 6
    assert rounds.count("scc-bridge") <= 20


def test_places_and_joins_in_large_groups(spark, monkeypatch):
    rng = random.Random(2)
    data = [(rng.choice([None, "a", "a", "a", "b"]), rng.choice([None, 1, 2, 3]), i) for i in range(400)]
    rows = spark.createDataFrame(data, "g string, o int, i int").repartition(7)
    place = {}
    for kind, most in (("window", 10_000), ("ranges", 5)):
        place[kind] = {r.i: r.n for r in numbered(rows, ["g"], [F.col("o"), F.col("i")], "n", 1, most).collect()}
    assert place["window"] == place["ranges"] and len(place["window"]) == 400
    known = rows.where("g is not null")
    groups = known.groupBy("g", "o").agg(F.count("*").alias("n"), F.sum("i").alias("s")).where("o is not null")
    want = sorted(tuple(r) for r in known.select("g", "o", "i").join(groups, ["g", "o"]).collect())
    for few, share in ((100, 1000), (0, 3), (0, 1000), (0, 1)):
        monkeypatch.setattr(grouping, "FEW", few)
        monkeypatch.setattr(grouping, "SHARE", share)
        assert sorted(tuple(r) for r in join_groups(known.select("g", "o", "i"), groups, ["g", "o"], "n").collect()) == want


@pytest.mark.parametrize("n", [3, 300])
def test_documents_written_one_a_file(spark, tmp_path, n):
    names = {f"a {i}/ä+%41={i}" if i % 2 else f"{i}": json.dumps(bar(url(f"http://{i}")), indent=2) for i in range(n)}
    D.write_documents(spark.createDataFrame(list(names.items()), "doc_id string, text string"), str(tmp_path / "out"))
    files = [f for f in (tmp_path / "out").rglob("part-*")]
    assert len(files) == n and all(json.loads(f.read_text()) for f in files)
    back = D.read_documents(spark, str(tmp_path / "out"))
    assert {r.doc_id: json.loads(r.text) for r in back.collect()} == {k: json.loads(v) for k, v in names.items()}
    assert D.schema_violations(back).count() == 0


def test_only_subtrees_of_folders_count(spark):
    odd = {"type": "other", "children": [folder("x"), folder("x", folder("y", url("b"), url("b")))]}
    doc = {"roots": {"r": {"type": "folder", "children": [odd, folder("X", url("c"))]}}}
    nodes = D.flatten(docs_of(spark, {"d": doc})).withColumn("new_parent", F.col("parent_id"))
    assert validate.violations(nodes).collect() == []
    doc["roots"]["r"]["children"][0]["type"] = "folder"
    nodes = D.flatten(docs_of(spark, {"d": doc})).withColumn("new_parent", F.col("parent_id"))
    assert sorted(r.rule for r in validate.violations(nodes).collect()) == ["duplicate_child_folder", "duplicate_url", "empty_folder", "folder_name_not_unique"]


def test_schema_violations(spark):
    docs = {
        "good": bar(folder("a", url("http://a", date_added="1", visit_count=0, show_icon=True, source="sync"))),
        "bad": {"version": 2, "checksum": 1, "roots": {"r": {"type": "folder", "name": 3, "children": [url("not one", date_added="x", visit_count=-1, show_icon=1, source="?"), {"type": "odd", "children": [{"type": "folder", "name": 1}]}, {"name": "no type"}]}}},
    }
    frame = docs_of(spark, docs).unionAll(spark.createDataFrame([("text", "{"), ("none", None), ("list", "[]")], "doc_id string, text string"))
    found = {}
    for r in D.schema_violations(frame).collect():
        found.setdefault(r.doc_id, []).append((r.place, r.path, r.error.split(":")[0]))
    assert set(found) == {"bad", "text", "none", "list"}
    assert sorted(found["bad"]) == [(0, "", "checksum"), (0, "", "version"), (1, "r", "name"), (2, "r/0", "date_added"), (2, "r/0", "show_icon"), (2, "r/0", "source"), (2, "r/0", "url"), (2, "r/0", "visit_count"), (4, "r/2", "type")]
    assert {r.doc_id for r in D.flatten(frame).select("doc_id").distinct().collect()} == {"good", "bad"}


def test_first_violation(spark):
    docs = {
        "name": bar(folder("x", url("http://a")), other=[folder("X ", url("http://a"))]),
        "empty": bar(folder("x")),
        "child": bar(folder("x", folder("y", url("b")), folder("Y", url("b")))),
        "url": bar(folder("x", url("http://A/"), url("http://a/#b"))),
        "fine": bar(folder("x", url("http://a"))),
    }
    nodes = D.flatten(docs_of(spark, docs))
    given = nodes.withColumns({"new_parent": nodes.parent_id, "position": nodes.child_pos})
    got = {r.doc_id: (r.rule, r.label) for r in validate.first_violation(given).collect()}
    assert got == {"name": ("folder_name_not_unique", "/bar/x"), "empty": ("empty_folder", "/bar/x"), "child": ("duplicate_child_folder", "/bar/x"), "url": ("duplicate_url", "/bar/x")}


def test_column_rules(spark):
    texts = ["5", "+05", "", "+", "-1", " 5", "5\n", "1e3", "18446744073709551615", "18446744073709551616", "0000000000000000000000007", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.n for r in rows.orderBy("i").select(u64(rows.t).alias("n")).collect()] == [model.u64(t) for t in texts]
    urls = [" HTTP://ExAmple.COM/Path#section ", "example.com/x#frag", "A://B?C/D", "", "#", "\t x://Y \n", "http://a b#c"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(urls)], "i int, t string")
    assert [r.c for r in rows.orderBy("i").select(canonical_url(rows.t).alias("c")).collect()] == [model.canonical(t) for t in urls]


def test_registry(spark):
    nodes = D.flatten(docs_of(spark, {"d": bar(folder("a"), folder("a"), folder("A"))}))
    registry = order.folder_registry(nodes)
    assert {(r.name, r.n) for r in registry.collect()} == {("a", 2), ("A", 1)}
    assert [r.all_unique for r in order.all_unique(registry).collect()] == [False]
    assert [r.line for r in order.registry_report(registry).orderBy("place").collect()] == ["A            | 1", "a            | 2", "all unique: false"]


def test_commands(spark, tmp_path, capsys):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "one.json").write_text(json.dumps(bar(folder("x", url("http://a"), url("http://A")), folder("X", url("http://b")))))
    with pytest.raises(SystemExit, match="duplicate|not_unique"):
        cli.run(spark, ["validate", "--in", str(source)])
    assert cli.run(spark, ["normalize", "--in", str(source), "--dry-run", "--emit-events", str(tmp_path / "log")]) == 0
    assert not target.exists() and "folders_pruned" not in capsys.readouterr().out
    lines = [json.loads(x) for f in sorted((tmp_path / "log").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[0] == {"type": "phase_started", "name": "parse_and_index"} and lines[-1]["type"] == "finished"
    assert cli.run(spark, ["normalize", "--in", str(source), "--out", str(target)]) == 0
    first = sorted(f.read_text() for f in target.glob("document=one.json/part-*"))
    assert len(first) == 1
    assert cli.run(spark, ["validate", "--in", str(target)]) == 0
    with pytest.raises(SystemExit, match="backup"):
        cli.run(spark, ["normalize", "--in", str(source), "--out", str(source)])
    assert cli.run(spark, ["normalize", "--in", str(source), "--out", str(source), "--backup"]) == 0
    assert sorted(f.read_text() for f in source.glob("document=one.json/part-*")) == first
    assert len(list(tmp_path.glob("in.bak.*"))) == 1
    for bad in ([], ["what"], ["normalize"], ["normalize", "--in", str(source)]):
        with pytest.raises(SystemExit):
            cli.run(spark, bad)


def test_stream(spark, tmp_path):
    from thicket.streaming.ingest import normalize_stream

    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.json").write_text(json.dumps(bar(folder("x", url("http://a")), folder("X", url(f"http://{i}")))))
    query = normalize_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(240)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 3 and all(len(json.loads(r.text)["roots"]["bar"]["children"]) == 1 for r in rows)
