"""Shards along a Hilbert curve through several quantised metadata dimensions.

Rows near on the curve are near in all dimensions, so a shard's ranges of them are narrow and a reader
with a filter on any dimension skips most shards' files. Only keys and metadata are sorted, no text.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.shared import drop, ranked, written
from thicket.operators.groups import join_groups

BITS = 6
#: Groups up to which their cells are broadcast.
MOST_BROADCAST = 200_000


def category(c: Column | str, bits: int = BITS) -> Column:
    """Any value's cell by its hash; a null's is 0."""
    return F.coalesce(F.pmod(F.xxhash64(F.col(c) if isinstance(c, str) else c), F.lit(1 << bits)), F.lit(0)).cast("int")


def spread(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """A value's cell by its rank among the column's values, evenly over all cells, so that shards can part them;
    by its hash where there are more values than cells. A null is a value."""
    values = [r[0] for r in df.select(column).distinct().limit((1 << bits) + 1).collect()]
    if len(values) > 1 << bits:
        return category(column, bits)
    ranked_ = sorted(values, key=lambda v: (v is not None, v))
    cell = F.lit(0)
    for i, v in enumerate(ranked_):
        cell = F.when(F.col(column).eqNullSafe(F.lit(v)), (i << bits) // len(ranked_)).otherwise(cell)
    return cell.cast("int")


def magnitude(c: Column, bits: int = BITS) -> Column:
    """A non-negative number's cell: three for each doubling, the last for all that is larger; a null's is 0."""
    cell = F.floor(F.log2(F.coalesce(c, F.lit(0)).cast("double") + 1) * 3)
    return F.least(cell, F.lit((1 << bits) - 1)).cast("int")


def hilbert(cells: Sequence[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of points in a cube of 2**bits cells a side, by Gray-code rotations."""
    axes = [np.asarray(c, np.int64).copy() for c in cells]
    n = len(axes)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            upper = (axes[i] & bit) != 0
            swap = np.where(upper, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(upper, low, swap)
            axes[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    flip = np.zeros_like(axes[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((axes[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    index = np.zeros_like(axes[0])
    for b in range(bits - 1, -1, -1):
        for a in axes:
            index = index << 1 | ((a ^ flip) >> b & 1)
    return index


def with_curve(df: DataFrame, cells: dict[str, Column], bits: int = BITS) -> DataFrame:
    """``df`` with its ``curve`` index (long); ``cells`` are whole numbers from 0 to 2**bits - 1."""
    if len(cells) * bits > 62:
        raise ValueError("more bits than a curve index has")
    names = [f"_cell{i}" for i in range(len(cells))]

    def run(batches):
        for batch in batches:
            k = batch.num_columns - len(names)
            index = hilbert([np.asarray(c) for c in batch.columns[k:]], bits)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(index, pa.int64())], [*batch.schema.names[:k], "curve"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "curve long"])
    return df.select("*", *(F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in zip(names, cells.values(), strict=True))).mapInArrow(run, schema)


def curve_shards(df: DataFrame, cells: dict[str, Column], tie: list[str], shards: int = 16, law: str = "rows", size: str = "size") -> tuple[DataFrame, str]:
    """Cut the rows, sorted by curve index and then ``tie``, into runs: ``shard`` and gapless ``slot``.

    law "rows": the shards' counts differ by one at most. law "bytes": a row goes where the sizes before
    it, as a share of all, fall, so shards' sums differ from the mean by less than the largest row. Fewer
    rows than shards leave some empty. Also returns the folder that the result reads.
    """
    rows, at = ranked(with_curve(df, cells), ["curve", *tie], "curve", [size] if law == "bytes" else [])
    total = rows.agg(F.count("*").alias("n"), F.sum(size).alias("s")).first()
    if law == "rows":
        n = max(1, total["n"])
        shard = F.expr(f"cast(ordinal * {shards} div {n} as int)")
        # Shard k begins at the first ordinal whose product with the number of shards reaches k * n.
        first = F.expr(f"(cast(ordinal * {shards} div {n} as bigint) * {n} + {shards - 1}) div {shards}")
        return rows.withColumns({"shard": shard, "slot": F.col("ordinal") - first}).drop("ordinal"), at
    if law != "bytes":
        raise ValueError(f"no such law: {law}")
    rows = rows.withColumn("shard", F.expr(f"cast(least(before_{size} * cast({shards} as decimal(20,0)) div {max(1, total['s'] or 0)}, {shards - 1}) as int)"))
    firsts = rows.groupBy("shard").agg(F.min("ordinal").alias("_first"))  # one row for each shard
    return rows.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("ordinal") - F.col("_first")).drop("ordinal", "_first", f"before_{size}"), at


def shard_documents(docs: DataFrame, shards: int = 16, law: str = "rows") -> tuple[DataFrame, str]:
    """One row for each row of ``docs`` (doc_id, text, lang, source): its shard along the curve through
    language, source, size and content.

    Columns: doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard (null: of laws only
    "key" grows), curve. A null text has no bytes. Equal texts (by 64-bit hash and size) are a group: all have
    the cell of the group's row with the smallest doc_id, and follow one another on the curve, so only a cut
    between shards, which equal counts call for, can part them. Nulls in other columns are a value of their own;
    repeated rows are placed each by itself; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    metadata = F.struct(spread(docs, "lang").alias("lang"), spread(docs, "source").alias("source"))
    flat = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("same"), metadata.alias("metadata"))
    flat, at_flat = written(flat, "keys")
    # Groups whose rows differ in metadata take those of their first row; the others have them already.
    groups = flat.groupBy("same", "size").agg(F.min_by("metadata", F.struct(F.col("doc_id").isNull(), "doc_id", "metadata")).alias("first"), F.min("metadata").alias("least"), F.max("metadata").alias("most"), F.count("*").alias("n"))
    mixed, at_mixed = written(groups.where("least <> most").select("same", "size", "first", "n"), "mixed")
    keys = ["same", "size"]
    if mixed.count() <= MOST_BROADCAST:
        flat = flat.join(F.broadcast(mixed.drop("n")), keys, "left")
    else:
        flat = join_groups(flat, mixed, keys, "n").drop("n").unionByName(flat.join(mixed.select(keys), keys, "left_anti").withColumn("first", F.lit(None).cast(mixed.schema["first"].dataType)))
    own = F.coalesce("first", "metadata")
    flat = flat.select("doc_id", "size", "text_crc32", "same", own["lang"].alias("lang"), own["source"].alias("source"))
    cells = {"lang": F.col("lang"), "source": F.col("source"), "size": magnitude(F.col("size")), "content": F.pmod(F.col("same"), F.lit(1 << BITS))}
    placed, at = curve_shards(flat, cells, ["same", "doc_id"], shards, law)
    drop(spark, at_flat, at_mixed)
    return placed.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"), at


def write_shards(df: DataFrame, placed: DataFrame, key: str, path: str) -> None:
    """Write the whole rows of ``df`` as one folder of Parquet files for each shard, in slot order."""
    rows = df.join(placed.select(key, "shard", "slot"), key).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)


def pruned(placed: DataFrame, column: str) -> DataFrame:
    """For each shard the range of a column: a filter outside it skips the shard's files."""
    return placed.groupBy("shard").agg(F.min(column).alias("least"), F.max(column).alias("most"), F.approx_count_distinct(column).alias("values"))
