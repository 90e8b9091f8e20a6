"""The cluster's shared folder, tables written there, and a few distributed building blocks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.plans.staging import shared_root

#: Bytes of a batch for Python workers: texts can be long, and a batch is in memory on both sides.
BATCH_BYTES = 8 << 20
_shipped: set[str] = set()
_own: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once an application (theirs may lack its path), and
    bound the batches that they get to BATCH_BYTES: a setting of the session, which stays."""
    context = spark.sparkContext
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if (now := spark.conf.get(setting, None)) is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent.parent
    at = tempfile.mkdtemp(prefix="modules-")
    atexit.register(shutil.rmtree, at, True)
    file = Path(at) / f"{package.name}-modules.zip"
    with zipfile.ZipFile(file, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent))
    context.addPyFile(str(file))


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one; it goes when the Python driver ends, or by drop()."""
    path = f"{shared_root(spark).rstrip('/')}/thicket/{name}-{uuid.uuid4().hex}"
    if not _own:
        atexit.register(_drop_all)
    _own.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_all() -> None:
    for spark, path in _own:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any more."""
    for path in paths:
        _delete(spark, path)
        _own[:] = [x for x in _own if x[1] != path]


def make_dirs(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def beside(df: DataFrame, column: str, kind: str, replaced: list[str]) -> tuple[DataFrame, list[str], str]:
    """For a Python operator over one column: ``df`` with that column last, as ``kind``, and all others but
    those ``replaced``; the others' names; and the beginning of the result's schema."""
    keep = [c for c in df.columns if c != column and c not in replaced]
    rows = df.select(*keep)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema)
    return df.select(*keep, F.col(column).cast(kind).alias(fresh(rows, column))), keep, schema


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder, which cuts the lineage; and the folder."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def ranked(df: DataFrame, order: list[Column | str], name: str, totals: list[str] = ()) -> tuple[DataFrame, str]:
    """Rows in a global order with ``ordinal`` (0, 1, ...) and, for each column c of ``totals``, ``before_c``:
    the sum of c over all rows before, without sending all rows to one task.

    Range-partitioned, sorted, written; each partition's size and sums then shift its own numbers. Only
    one row for each partition is broadcast. Returns the DataFrame and the folder it reads.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def running(batches):
        sums, n = dict.fromkeys(totals, 0), 0
        for batch in batches:
            columns = batch.columns
            ordinal = pa.array(range(n, n + batch.num_rows), pa.int64())
            n += batch.num_rows
            more = []
            for c in totals:
                values = pc.fill_null(batch.column(c).cast(pa.int64()), 0)
                upto = pc.cumulative_sum(values, start=sums[c])
                more.append(pc.subtract(upto, values))
                sums[c] = upto[-1].as_py() if len(upto) else sums[c]
            yield pa.RecordBatch.from_arrays([*columns, ordinal, *more], [*batch.schema.names, "ordinal", *(f"before_{c}" for c in totals)])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    schema = ", ".join([fields, "ordinal long", *(f"before_{c} long" for c in totals)])
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(running, schema).withColumn("_part", F.spark_partition_id())
    rows, path = written(dealt, name)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"_{c}") for c in totals))
    counts = sorted(sizes.collect())  # one row for each partition
    shift, upto = [], [0] * (1 + len(totals))
    for part, *of in counts:
        shift.append((part, *upto))
        upto = [a + int(b) for a, b in zip(upto, of, strict=True)]
    names = ["ordinal", *(f"before_{c}" for c in totals)]
    shifts = df.sparkSession.createDataFrame(shift, ", ".join(["_part int", *(f"_by{i} long" for i in range(len(names)))]))
    out = rows.join(F.broadcast(shifts), "_part").withColumns({c: F.col(c) + F.col(f"_by{i}") for i, c in enumerate(names)})
    return out.drop("_part", *(f"_by{i}" for i in range(len(names)))), path


def components(edges: DataFrame, name: str = "components") -> tuple[DataFrame, list[str]]:
    """Connected components of the links (a, b): one row (node, component) for each node with a link to
    another, the component being its smallest node. Self links and repeats do no harm.

    Each round every node points to its smallest neighbour, pointers are doubled until they reach roots,
    and the links are contracted to their roots; so links at least halve. All of it stays in tables: no
    node or link reaches the driver. Also returns the folders in use.
    """
    spark = edges.sparkSession
    links, at = written(edges.select("a", "b").where("a <> b").distinct(), f"{name}-links")
    root: DataFrame | None = None
    root_at = ""
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionAll(links.select(F.col("b").alias("node"), F.col("a").alias("to")))
        points = both.groupBy("node").agg(F.min("to").alias("_to")).select("node", F.least("node", "_to").alias("to"))
        point, point_at = written(points, f"{name}-point")
        while True:
            next_ = point.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
            jumped, jumped_at = written(point.join(next_, F.col("to") == F.col("_n")).select("node", F.col("_t").alias("to"), (F.col("_t") != F.col("to")).alias("moved")), f"{name}-jump")
            drop(spark, point_at)
            moved = not jumped.where("moved").isEmpty()
            point, point_at = jumped.select("node", "to"), jumped_at
            if not moved:
                break
        of = lambda c: point.select(F.col("node").alias(f"_{c}"), F.col("to").alias(f"_{c}_to"))
        fewer = links.join(of("a"), F.col("a") == F.col("_a")).join(of("b"), F.col("b") == F.col("_b")).select(F.col("_a_to").alias("a"), F.col("_b_to").alias("b")).where("a <> b").distinct()
        fewer, fewer_at = written(fewer, f"{name}-links")
        if root is None:
            root, root_at, old = point.select("node", F.col("to").alias("component")), point_at, []
        else:
            new, new_at = written(root.join(of("c"), F.col("component") == F.col("_c"), "left").select("node", F.coalesce("_c_to", "component").alias("component")), f"{name}-root")
            old, root, root_at = [root_at, point_at], new, new_at
        drop(spark, at, *old)
        links, at = fewer, fewer_at
    if root is None:
        kind = edges.schema["a"].dataType.simpleString()
        return spark.createDataFrame([], f"node {kind}, component {kind}"), [at]
    return root, [at, root_at]
