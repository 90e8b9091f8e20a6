"""Merkle fixity audit of replicated web archives.

A record's leaf is the digest of its bytes at an offset of its archive. Inner nodes digest the nodes of
an ordered offset range; ranges grow by a fixed factor up to one root an archive. Two replicas' roots are
compared, and only below roots that differ are child nodes looked at, down to the records at fault. A
node has a bounded number of children, and after the first pass digests travel, not records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.llm.shared import drop, ranked, written

#: Bytes of the smallest offset range; children of an inner node; bytes of an archive.
RANGE, FANOUT, ARCHIVE = 1 << 16, 16, 1 << 26


def record_text(url: Column, payload: Column) -> Column:
    """A resource record as WARC/1.0 has it; a null payload or address counts as empty."""
    payload, url = F.coalesce(payload.cast("string"), F.lit("")), F.coalesce(url.cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    return F.concat(head, F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))


def levels(most_offset: int) -> int:
    """Levels of ranges so that the top one covers every offset."""
    n, span = 1, RANGE
    while span <= most_offset:
        n, span = n + 1, span * FANOUT
    return n


def tree(records: DataFrame, depth: int, name: str) -> tuple[DataFrame, list[str]]:
    """Nodes (archive, level, node, digest) of records (archive, offset, length, digest), level 1 to depth.

    Equal offsets, which no sound archive has, are ordered by length and digest; equal records are counted first.
    A null is a value of its own.
    """
    out, folders = None, []
    own = [F.coalesce(F.col(c).cast("string"), F.lit("~")).alias(c) for c in ("length", "digest")]
    once = records.select("archive", "offset", *own).groupBy("archive", "offset", "length", "digest").agg(F.count("*").alias("n"))
    below = once.select("archive", F.expr(f"offset div {RANGE}").alias("node"), F.struct("offset", "length", "digest", "n").alias("child"))
    for level in range(1, depth + 1):
        fields = ("offset", "length", "digest", "n") if level == 1 else ("node", "digest")
        parts = F.transform(F.array_sort(F.collect_list("child")), lambda c: F.concat_ws(":", *(c[k].cast("string") for k in fields)))  # noqa: B023
        nodes, at = written(below.groupBy("archive", "node").agg(F.sha2(F.array_join(parts, ";"), 256).alias("digest")), f"{name}-{level}")
        folders.append(at)
        rows = nodes.select("archive", F.lit(level).alias("level"), "node", "digest")
        out = rows if out is None else out.unionAll(rows)
        below = nodes.select("archive", F.expr(f"node div {FANOUT}").alias("up"), F.struct("node", "digest").alias("child")).withColumnRenamed("up", "node")
    return out, folders


def _unmatched(own: DataFrame, other: DataFrame) -> DataFrame:
    """The records of ``own`` without an equal one in ``other``, each matched once; and their ``place`` at an offset."""
    same = ["archive", "offset", "length", "digest"]

    def told(df: DataFrame) -> DataFrame:
        return df.withColumn("copy", F.row_number().over(Window.partitionBy(*same).orderBy("record")))

    other = told(other).select(*(F.col(c).alias(f"_{c}") for c in (*same, "copy")))
    match = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*same, "copy")))
    left = told(own).join(other, match, "left_anti")
    return left.withColumn("place", F.row_number().over(Window.partitionBy("archive", "offset").orderBy("length", "digest", "record"))).drop("copy")


def audit(one: DataFrame, two: DataFrame, name: str = "audit") -> tuple[DataFrame, str]:
    """Records at fault between two replicas given as (archive, offset, length, digest, record): archive,
    offset, length, record, expected, found and status: altered, missing (only in ``one``) or extra.

    Records are told apart by their offsets: where a replica's record has another length, those after it in its
    archive stand elsewhere and are at fault too. Of several records at one offset equal ones match; the others
    are paired in order of length and digest. Nulls are values; replicas without records give no rows, or all
    of the other's.
    """
    most = one.select("offset").unionAll(two.select("offset")).agg(F.max("offset")).first()[0]
    depth = levels(most or 0)
    (a, at_a), (b, at_b) = tree(one, depth, f"{name}-a"), tree(two, depth, f"{name}-b")
    suspect, old = None, []
    for level in range(depth, 0, -1):
        x, y = (t.where(F.col("level") == level).select("archive", "node", F.col("digest").alias(d)) for t, d in ((a, "da"), (b, "db")))
        if suspect is not None:
            up = suspect.select("archive", F.col("node").alias("up"))
            x, y = (t.join(up, (t["archive"] == up["archive"]) & (F.expr(f"node div {FANOUT}") == up["up"]), "left_semi") for t in (x, y))
        differ = x.join(y, ["archive", "node"], "full").where(~F.col("da").eqNullSafe(F.col("db"))).select("archive", "node")
        suspect, at = written(differ, f"{name}-differ")
        old.append(at)
    own = suspect.select("archive", F.col("node").alias("range"))

    def below(df: DataFrame) -> DataFrame:
        near = df.join(own, (df["archive"] == own["archive"]) & (F.expr(f"offset div {RANGE}") == own["range"]), "left_semi")
        return near.select("archive", "offset", "length", "digest", "record")

    x, y = below(one), below(two)
    sides = [_unmatched(own_, other).select("archive", "offset", "place", F.col("length").alias(f"length_{t}"), F.col("digest").alias(f"digest_{t}"), F.col("record").alias(f"record_{t}"), F.lit(True).alias(f"in_{t}")) for own_, other, t in ((x, y, "a"), (y, x, "b"))]
    pairs = sides[0].join(sides[1], ["archive", "offset", "place"], "full")
    status = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").otherwise("altered")
    first = lambda c: F.when(F.col("in_a"), F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    out, at = written(pairs.select("archive", "offset", first("length").alias("length"), first("record").alias("record"), F.col("digest_a").alias("expected"), F.col("digest_b").alias("found"), status.alias("status")), name)
    drop(one.sparkSession, *at_a, *at_b, *old)
    return out, at


def laid_out(records: DataFrame, keys: list[str]) -> tuple[DataFrame, str]:
    """Records (keys, length, ...) in key order end to end, in archives that begin where ARCHIVE bytes are full: with
    ``archive`` and ``offset`` in it."""
    placed, at = ranked(records, keys, "layout", ["length"])
    placed = placed.withColumn("archive", F.expr(f"before_length div {ARCHIVE}"))
    begins = placed.groupBy("archive").agg(F.min("before_length").alias("_begin"))
    placed, at2 = written(placed.join(begins, "archive").withColumn("offset", F.col("before_length") - F.col("_begin")).drop("ordinal", "before_length", "_begin"), "archives")
    drop(records.sparkSession, at)
    return placed, at2


def read_back(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records (archive, keys, length, ...) as a reader of their archives meets them: ``offset`` counts the bytes of
    those before in the archive. An archive's records, of ARCHIVE bytes in all, are one group."""
    before = Window.partitionBy("archive").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def failing(record: Column, lot: Column) -> Column:
    """A fixed share of records as a failing store returns them, in their place: of one in 97 a byte is changed,
    one in 101 is zeros from its 41st byte on; ``lot`` is a whole number."""
    kept = F.substring(record, 1, 40)
    blank = F.concat(kept, F.repeat(F.lit("\0"), F.greatest(F.octet_length(record) - F.octet_length(kept), F.lit(0))))
    return F.when(lot % 101 == 1, blank).when(lot % 97 == 0, F.concat(F.lit("w"), F.substring(record, 2, 1 << 30))).otherwise(record)


def audit_pages(pages: DataFrame) -> tuple[DataFrame, list[str]]:
    """Store ``pages`` (page_id, url, html) as records laid out in archives, and audit a second replica of them.

    The replica is a stored copy of all records, read apart, with its own digests and offsets from its own records.
    It has planted damage: failing() records, and each even archive breaks off after 127/128 of its bytes. Rows
    are records each by itself, whatever page_id they repeat or lack.
    """
    spark = pages.sparkSession
    record = record_text(F.col("url"), F.col("html"))
    stored, at1 = written(pages.select(F.monotonically_increasing_id().alias("row"), "page_id", record.alias("data")), "replica-one")
    copy, at2 = written(stored.withColumn("data", failing(F.col("data"), F.coalesce(F.col("page_id"), F.lit(0)))), "replica-two")
    read = lambda r: r.select("row", "page_id", F.octet_length("data").cast("long").alias("length"), F.sha2("data", 256).alias("digest"))
    one, at3 = laid_out(read(stored), ["page_id", "row"])
    whole = one.groupBy("archive").agg((F.max(F.col("offset") + F.col("length"))).alias("whole"))
    kept = one.join(whole, "archive").where("archive % 2 = 1 or (offset + length) * 128 <= whole * 127").select("row", "archive")
    two, at4 = written(read_back(read(copy).join(kept, "row"), ["page_id", "row"]), "replica")
    drop(spark, at1, at2)
    out, at5 = audit(*(r.select("archive", "offset", "length", "digest", F.col("page_id").alias("record")) for r in (one, two)))
    drop(spark, at3, at4)
    return out, [at5]
