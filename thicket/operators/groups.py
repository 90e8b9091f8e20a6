"""Joins to groups, and places in groups, that no single group's size can slow down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.plans.staging import staged

#: Groups with more than one row in so many are joined by broadcast: there can't be more of them than this.
SHARE = 1000
#: Groups, of a few hundred bytes each, that are broadcast whatever their sizes.
FEW = 10_000
#: Rows of the largest group up to which one task numbers each group.
WINDOW_ROWS = 1_000_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` joined to their groups, one row of ``groups`` (a table) for each value of ``keys``, whose column
    ``size`` counts the rows of the group. Keys aren't null.

    Up to FEW groups are broadcast. Of more, those with more than 1/SHARE of all rows, SHARE at most, are broadcast
    and the others shuffled: none of these is more than 1/SHARE of what is shuffled.
    """
    n, total, most = groups.agg(F.count("*"), F.sum(size), F.max(size)).first()
    if n <= FEW:
        return rows.join(F.broadcast(groups), keys)
    if most * SHARE <= total:
        return rows.join(groups, keys)
    large = F.col(size) * SHARE > total
    hot = F.broadcast(groups.where(large))
    cold = rows.join(F.broadcast(groups.where(large).select(*keys)), keys, "left_anti").join(groups.where(~large), keys)
    return rows.join(hot, keys).unionByName(cold)


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str, start: int = 0, most: int = WINDOW_ROWS) -> DataFrame:
    """``df`` with the place of each row among those of its group, counted from ``start``. Nulls are values.

    If a group has more than ``most`` rows, no group is sorted in one task: the rows are sorted in ranges of
    (group, order), and numbers within a range are shifted by the rows before it.
    """
    sizes = df.groupBy(*group).agg(F.count("*").alias("_size"))
    if (sizes.agg(F.max("_size").alias("n")).first()["n"] or 0) <= most:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) + (start - 1))
    keys = [F.col(g) for g in group]
    rows = staged(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright("_row", 33), F.col("_row").bitwiseAND((1 << 33) - 1)
    shifts, upto = [], 0
    for r in sorted(rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):  # one row for each range
        shifts.append((r["p"], upto))
        upto += r["n"]
    shift = F.broadcast(rows.sparkSession.createDataFrame(shifts, "_part long, _shift long"))
    placed = rows.join(shift, part == F.col("_part")).withColumn("_at", within + F.col("_shift")).drop("_row", "_part", "_shift")
    packed = F.struct(*group)
    firsts = staged(placed.groupBy(packed.alias("_group")).agg(F.min("_at").alias("_first"), F.count("*").alias("_size")), "numbered-first")
    joined = join_groups(placed.withColumn("_group", packed), firsts, ["_group"], "_size")
    return joined.withColumn(name, (F.col("_at") - F.col("_first") + start).cast("int")).select(*df.columns, name)
