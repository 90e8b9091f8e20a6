"""Near duplicates among embeddings by sorted projection passes.

In each pass every vector gets a key of concatenated random hyperplane signs; vectors are ordered by label
and key, and each is compared, exactly, with a bounded window of its neighbours. Links found in any pass
are united. The order is cut into blocks of fixed size that overlap by a window, so no task depends on how
many vectors a label or key holds. Windows join dense groups cheaply, but strangers can fill them.

So what is still apart is then compared in whole runs: all vectors of a label that share the first signs of
a key, tile against tile, however many they are. How many signs each label's runs share follows from its
crowding, measured on one pass; the number of passes follows from the signs, so that a pair right at the
threshold shares no run with probability MISS at most, wherever the label's other vectors lie. Where runs
would cost more than all pairs of the label do, its only run is the whole label and no pair is missed.

Neither finds all links of a dense group, so links are then counted over all pairs inside each component,
block against block, without a row for any pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.shared import components, drop, ranked, written

THRESHOLD, WINDOW, MISS, PASSES = 0.98, 32, 1e-5, 8
BITS, BLOCK, TILE = 60, 2048, 1024
#: Signs that runs may share, a side of their tiles, and a row's cost in compared pairs.
SHARED_BITS, RUN_TILE, ROW = range(0, 44, 4), 4096, 1000


def turns(bits: int, threshold: float = THRESHOLD, miss: float = MISS) -> int | None:
    """Passes after which a pair at the threshold has shared the first ``bits`` signs of a key in one of
    them, but for a probability of ``miss``; none if no number does."""
    found = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if found >= 1 else math.ceil(math.log(miss) / math.log1p(-found)) if found > 1e-4 else None


def planes(turn: int, dimension: int) -> np.ndarray:
    return np.random.default_rng([11, turn, dimension]).normal(size=(dimension, BITS))


def unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _links(ids: list, group: np.ndarray, x: np.ndarray, threshold: float, window: int) -> tuple[list, list]:
    """A spanning forest of the links between rows at most ``window`` apart and of one group."""
    parent = np.arange(len(ids))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a, b = [], []
    for d in range(1, min(window, len(ids) - 1) + 1):
        near = (group[:-d] == group[d:]) & (np.einsum("ij,ij->i", x[:-d], x[d:]) >= threshold)
        for i in np.flatnonzero(near).tolist():
            if (p := root(i)) != (q := root(i + d)):
                parent[max(p, q)] = min(p, q)
                a.append(ids[i])
                b.append(ids[i + d])
    return a, b


def projected(vectors: DataFrame, others: list[str] = ()) -> DataFrame:
    """(turn, group, dimension, key, id and ``others``): the keys of (id, group, dimension, vector, turns),
    in as many passes as each row's ``turns``."""
    of = {f.name: f.dataType.simpleString() for f in vectors.schema}
    rest = ["id", *others]

    def keys(batches):
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            sizes, passes = np.asarray(batch.column("dimension")), np.asarray(batch.column("turns"))
            for size in np.unique(sizes).tolist():
                part, times = batch.filter(pa.array(sizes == size)), passes[sizes == size]
                x = unit(part.column("vector"))
                for turn in range(int(times.max())):
                    has = np.flatnonzero(times > turn)
                    own = part if len(has) == len(x) else part.take(pa.array(has))
                    key = (x[has] @ planes(turn, size) > 0).astype(np.int64) @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), turn, np.int32)), own.column("group"), pa.array(np.full(len(has), size, np.int32)), pa.array(key), *(own.column(c) for c in rest)], ["turn", "group", "dimension", "key", *rest])

    schema = "turn int, group long, dimension int, key long, " + ", ".join(f"{c} {of[c]}" for c in rest)
    return vectors.select("group", "dimension", "vector", "turns", *rest).mapInArrow(keys, schema)


def window_links(vectors: DataFrame, passes: int, threshold: float, window: int) -> tuple[DataFrame, list[str]]:
    """Links (a, b) among (id, group, dimension, vector) that the passes find, enough to connect what they join."""
    kind = vectors.schema["id"].dataType.simpleString()
    keyed = projected(vectors.withColumn("turns", F.lit(passes)))
    order, at = ranked(keyed, ["turn", "group", "dimension", "key", "id"], "passes")
    block = F.expr(f"ordinal div {BLOCK}")
    early = (F.expr(f"ordinal % {BLOCK}") < window) & (block > 0)
    dealt = order.withColumn("block", F.explode(F.when(early, F.array(block - 1, block)).otherwise(F.array(block))))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("ordinal")
        turn, group, size = (table.column(c).to_numpy() for c in ("turn", "group", "dimension"))
        cuts = [0, *(np.flatnonzero((turn[1:] != turn[:-1]) | (group[1:] != group[:-1]) | (size[1:] != size[:-1])) + 1).tolist(), len(turn)]
        a, b = [], []
        for i, j in zip(cuts, cuts[1:]):
            part = table.slice(i, j - i)
            found = _links(part.column("id").to_pylist(), np.zeros(j - i), unit(part.column("vector")), threshold, window)
            a += found[0]
            b += found[1]
        ids = table.schema.field("id").type
        return pa.table([pa.array(a, ids), pa.array(b, ids)], names=["a", "b"])

    with_vectors = dealt.select("block", "ordinal", "turn", "group", "dimension", "id").join(vectors.select("id", "vector"), "id")
    links, at2 = written(with_vectors.groupBy("block").applyInArrow(compare, f"a {kind}, b {kind}"), "window-links")
    drop(vectors.sparkSession, at)
    return links, [at2]


def run_bits(vectors: DataFrame, threshold: float) -> DataFrame:
    """(group, dimension, bits, turns): how many first signs the runs of each group share, and in how many
    passes. Of those that find a pair at the threshold, the cheapest by the runs of one pass."""
    possible = [(k, n) for k in SHARED_BITS if (n := turns(k, threshold)) is not None]
    choices = F.array(*(F.struct(F.lit(k).alias("bits"), F.lit(n).alias("turns")) for k, n in possible))
    one = projected(vectors.withColumn("turns", F.lit(1))).withColumn("of", F.explode(choices))
    runs = one.groupBy("group", "dimension", "of", F.expr(f"shiftright(key, {BITS} - of.bits)").alias("run")).agg(F.count("*").cast("double").alias("n"))
    cost = F.sum(F.col("of.turns") * F.col("n") * (ROW * F.ceil(F.col("n") / RUN_TILE) + F.col("n") / 2))
    return runs.groupBy("group", "dimension", "of").agg(cost.alias("cost")).groupBy("group", "dimension").agg(F.min(F.struct("cost", "of.bits", "of.turns")).alias("best")).select("group", "dimension", "best.bits", "best.turns")


def run_links(vectors: DataFrame, threshold: float) -> tuple[DataFrame, list[str]]:
    """Links (a, b) that join what is still apart of (id, group, dimension, vector, component).

    All vectors of a run in different components are compared. A run over RUN_TILE is dealt into tiles, each
    pair of which is compared as a whole in one place; small runs share tasks. No row is made for a pair but
    a link that joins.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    run = ["turn", "group", "dimension", "run"]
    plan, at_plan = written(run_bits(vectors, threshold), "run-bits")
    keyed = projected(vectors.join(plan, ["group", "dimension"]), ["component", "bits"])
    rows, at_rows = written(keyed.withColumn("run", F.expr(f"shiftright(key, {BITS} - bits)")).select(*run, "id", "component"), "runs")
    sizes = rows.groupBy(*run).agg(F.count("*").alias("n"), F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low <> _high")
    sizes, at_sizes = written(sizes.select(*run, "n", F.ceil(F.col("n") / RUN_TILE).cast("int").alias("tiles")), "run-sizes")
    total = sizes.agg(F.sum(F.col("n") * F.col("tiles")).alias("n")).first()["n"] or 0
    placed = rows.join(sizes, run).withColumn("tile", F.expr("cast(pmod(xxhash64(id), tiles) as int)"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(*run, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "component")
    dealt = dealt.withColumn("task", F.expr(f"pmod(xxhash64({', '.join(run)}, i, j), {max(1, total // (2 * RUN_TILE))})"))
    dealt = dealt.join(vectors.select("id", "group", "dimension", "vector"), ["id", "group", "dimension"])

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in (*run, "i", "j", "tile")]).combine_chunks()
        parts = [table.column(c).to_numpy() for c in (*run, "i", "j")]
        i, j, tile = (table.column(c).to_numpy() for c in ("i", "j", "tile"))
        new = np.logical_or.reduce([p[1:] != p[:-1] for p in parts])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(i)]
        a, b = [], []
        for lo, hi in zip(cuts, cuts[1:]):
            x, ids = unit(table.column("vector").slice(lo, hi - lo)), table.column("id").slice(lo, hi - lo).to_pylist()
            own = table.column("component").slice(lo, hi - lo).combine_chunks().dictionary_encode()
            own = (own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own).indices.to_numpy()
            parent = np.arange(int(own.max()) + 1)

            def root(k: int) -> int:
                while parent[k] != k:  # noqa: B023
                    parent[k] = parent[parent[k]]  # noqa: B023
                    k = parent[k]  # noqa: B023
                return k

            cut = int(np.searchsorted(tile[lo:hi], j[lo])) if i[lo] < j[lo] else 0
            for at in range(0, cut or hi - lo, TILE):
                to = min(cut or hi - lo, at + TILE)
                first = cut or at
                p, q = np.nonzero(x[at:to] @ x[first:].T >= threshold)
                p, q = p + at, q + first
                apart = own[p] != own[q]
                p, q = p[apart], q[apart]
                _, one = np.unique(own[p].astype(np.int64) << 32 | own[q], return_index=True)
                for m, n in zip(p[one].tolist(), q[one].tolist()):
                    if (r := root(own[m])) != (t := root(own[n])):
                        parent[max(r, t)] = min(r, t)
                        a.append(ids[m])
                        b.append(ids[n])
        of = table.schema.field("id").type
        return pa.table([pa.array(a, of), pa.array(b, of)], names=["a", "b"])

    links, at = written(dealt.groupBy("task").applyInArrow(compare, f"a {kind}, b {kind}"), "run-links")
    drop(vectors.sparkSession, at_plan, at_rows, at_sizes)
    return links, [at]


def component_links(members: DataFrame, threshold: float) -> DataFrame:
    """(id, n): how many copies of other members' vectors each of (component, id, vector, copies) links with,
    over all pairs of a component. A component over TILE is dealt into tiles, each pair of which is a task's
    work; small ones share tasks."""
    kind = members.schema["id"].dataType.simpleString()
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("n")).first()["n"] or 0
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    placed = members.join(sizes, "component").withColumn("tiles", tiles).withColumn("tile", F.expr("cast(pmod(xxhash64(id), tiles) as int)"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = placed.withColumn("other", other).select("component", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "vector", "copies")
    tasks = max(1, total // (2 * TILE))
    dealt = dealt.withColumn("task", F.expr(f"pmod(xxhash64(component, i, j), {tasks})"))

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("i", "ascending"), ("j", "ascending"), ("tile", "ascending")])
        component = table.column("component").to_numpy()
        i, j, tile, copies = (table.column(c).to_numpy() for c in ("i", "j", "tile", "copies"))
        new = (component[1:] != component[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(i)]
        n = np.zeros(len(i), np.int64)
        for lo, hi in zip(cuts, cuts[1:]):
            x = unit(table.column("vector").slice(lo, hi - lo))
            cut = int(np.searchsorted(tile[lo:hi], j[lo])) if i[lo] < j[lo] else 0
            for a, b, c, d in [(0, hi - lo, 0, hi - lo)] if i[lo] == j[lo] else [(0, cut, cut, hi - lo), (cut, hi - lo, 0, cut)]:
                for at in range(a, b, TILE):
                    to = min(b, at + TILE)
                    linked = x[at:to] @ x[c:d].T >= threshold
                    if i[lo] == j[lo]:
                        linked[np.arange(to - at), np.arange(at, to)] = False
                    n[lo + at : lo + to] += linked @ copies[lo + c : lo + d]
        return pa.table([table.column("id"), pa.array(n)], names=["id", "n"])

    return dealt.groupBy("task").applyInArrow(count, f"id {kind}, n long").groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, window: int = WINDOW) -> tuple[DataFrame, str]:
    """One row for each row: key, n_links (other rows linked directly), component_id (smallest key reachable)
    and kept (key = component_id); and the folder that it reads.

    Rows link if their labels are equal and not null and their vectors' cosine in double precision reaches
    ``threshold``. A vector that is null, empty, zero or holds a null or non-finite number links with
    nothing, nor does a row with a null key; vectors of different lengths don't link. Equal vectors of a
    label are compared once. Rows that repeat a key are vectors of their own with that key's component.
    """
    spark = rows.sparkSession
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    # Two 64-bit hashes together stand for the label and the vector.
    table = rows.select(F.col(key).alias("id"), F.coalesce(sound, F.lit(False)).alias("sound"), F.xxhash64(F.lit(1), F.col(label), F.col(vector)).alias("h1"), F.xxhash64(F.lit(2), F.col(label), F.col(vector)).alias("h2"), F.xxhash64(F.col(label)).alias("group"), F.col(vector).alias("vector"))
    classes, at_classes = written(
        table.where("sound").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("group").alias("group"), F.first("vector").alias("vector")).withColumn("dimension", F.size("vector")), "vectors"
    )
    links, at_links = window_links(classes, PASSES, threshold, window)
    root, at_root = components(links, "vectors")
    apart = classes.select("id", "group", "dimension", "vector").join(root.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    more, at_more = run_links(apart, threshold)
    drop(spark, *at_root)
    root, at_root = components(links.unionAll(more), "vectors")
    inside = classes.join(root.withColumnRenamed("node", "id"), "id").select("id", "component", "vector", "copies")
    counted = component_links(inside, threshold)
    placed = classes.select("h1", "h2", "id", "copies").join(root.withColumnRenamed("node", "id"), "id", "left").join(counted, "id", "left")
    placed, at = written(placed.select("h1", "h2", F.coalesce("component", "id").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")), "placed")
    drop(spark, at_classes, *at_links, *at_more, *at_root)
    sound_rows = table.select("id", "sound", F.when(F.col("sound"), F.col("h1")).alias("h1"), F.when(F.col("sound"), F.col("h2")).alias("h2"))
    out = sound_rows.join(placed, ["h1", "h2"], "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id"))), at
