"""A forest over plain tables: regions hold nations, these hold customer segments, and pages hang below.

Built by one SQL text that Spark and DuckDB both read, so queries over it can be compared. Pages come in
variants of one address, in one folder and in others, and segment names in variants of one name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.operators.nodes import COLUMNS

#: p1, p2, p3: child indexes from the root, null beyond the node's depth.
FOREST_SQL = """
segment AS (SELECT s, dense_rank() OVER (ORDER BY s) - 1 AS si FROM (SELECT DISTINCT c_mktsegment AS s FROM customer) q),
nat AS (SELECT n_nationkey AS nk, n_name, r_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS p1
        FROM nation JOIN region ON n_regionkey = r_regionkey),
pair AS (SELECT nk, n_name, r_name, p1, s, si, least_key, n, last_key,
                row_number() OVER (PARTITION BY nk ORDER BY s) - 1 AS p2, row_number() OVER (ORDER BY nk, s) - 1 AS pair_no
         FROM (SELECT nat.nk, nat.n_name, nat.r_name, nat.p1, segment.s, segment.si, min(c_custkey) AS least_key, count(*) AS n, max(c_custkey) AS last_key
               FROM customer JOIN nat ON c_nationkey = nat.nk JOIN segment ON c_mktsegment = segment.s
               GROUP BY nat.nk, nat.n_name, nat.r_name, nat.p1, segment.s, segment.si) q),
pairs AS (SELECT count(*) AS k FROM pair),
scheme AS (SELECT page_id, url, instr(url, '://') AS cut FROM pages),
entry AS (SELECT page_id, 0 AS v, url, page_id % k AS pair_no FROM scheme CROSS JOIN pairs
          UNION ALL SELECT page_id, 1 AS v, upper(substr(url, 1, cut - 1)) || substr(url, cut) || '#dup' AS url, page_id % k AS pair_no FROM scheme CROSS JOIN pairs WHERE page_id % 2 = 0
          UNION ALL SELECT page_id, 2 AS v, url, (page_id + 5) % k AS pair_no FROM scheme CROSS JOIN pairs WHERE page_id % 3 = 0),
forest AS (
  SELECT r_name AS root_key, 0 AS depth, CAST(NULL AS INT) AS p1, CAST(NULL AS INT) AS p2, CAST(NULL AS INT) AS p3, 'folder' AS type, CAST(NULL AS STRING) AS name,
         CAST(NULL AS STRING) AS url, CAST(NULL AS STRING) AS id, CAST(NULL AS STRING) AS date_added, CAST(NULL AS STRING) AS date_modified,
         CAST(NULL AS STRING) AS date_last_used, CAST(NULL AS BIGINT) AS visit_count FROM region
  UNION ALL SELECT r_name, 1, CAST(p1 AS INT), NULL, NULL, 'folder', n_name, NULL, CAST(nk AS STRING), '100', NULL, NULL, NULL FROM nat
  UNION ALL SELECT r_name, 2, CAST(p1 AS INT), CAST(p2 AS INT), NULL, 'folder', CASE nk % 3 WHEN 0 THEN s WHEN 1 THEN lower(s) ELSE ' ' || s || ' ' END, NULL,
         CAST(1000 + 10 * nk + si AS STRING), CAST(500 + least_key % 17 AS STRING), CAST(last_key AS STRING), NULL, CAST(n AS BIGINT) FROM pair
  UNION ALL SELECT r_name, 3, CAST(p1 AS INT), CAST(p2 AS INT), CAST(row_number() OVER (PARTITION BY pair.pair_no ORDER BY page_id, v) - 1 AS INT), 'url', 'p' || CAST(page_id AS STRING), url,
         CAST(100000 + 3 * page_id + v AS STRING), CAST(1000 + page_id % 11 AS STRING), NULL, CAST(page_id % 3 AS STRING), CAST((7 * page_id + v) % 5 AS BIGINT)
         FROM entry JOIN pair ON entry.pair_no = pair.pair_no)
"""

TABLES = ("region", "nation", "customer", "pages")


def register(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table of the derived forest, one document."""
    register(spark, sf_dir)
    rows = spark.sql(f"WITH {FOREST_SQL} SELECT * FROM forest")
    idx = F.array_compact(F.array("p1", "p2", "p3"))
    path = F.concat_ws("/", "root_key", F.transform(idx, lambda i: i.cast("string")))
    rows = rows.withColumns({"doc_id": F.lit("forest"), "idx": idx, "path": path})
    up = F.when(F.col("depth") > 0, F.concat_ws("/", "root_key", F.transform(F.slice("idx", F.lit(1), F.col("depth") - 1), lambda i: i.cast("string"))))
    given = {"node_id": F.col("path"), "parent_id": up, "child_pos": F.coalesce(F.get("idx", F.size("idx") - 1), F.lit(0))}
    rows = rows.withColumns(given)
    for column in COLUMNS.split(", "):
        name, kind = column.split(" ", 1)
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows.select(*(c.split()[0] for c in COLUMNS.split(", ")))


def functional_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as vertices, each with an edge to the remainder of its square: trees that end in cycles."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = customers.count()
    doc = F.lit("squares").alias("doc_id")
    key = F.col("c_custkey")
    return customers.select(doc, key.alias("key")), customers.select(doc, key.alias("src"), (key * key % n).alias("dst"))


def json_documents(spark: SparkSession, sf_dir: str, copies: int = 3) -> DataFrame:
    """(doc_id, text): the derived forest as JSON, under ``copies`` ids, built without the node table's operators."""
    register(spark, sf_dir)
    rows = spark.sql(f"WITH {FOREST_SQL} SELECT * FROM forest")
    known = F.to_json(F.struct("type", "name", "url", "date_added", "date_modified", "date_last_used", "visit_count", "id"))
    opened = F.expr("substring(own, 1, length(own) - 1)")
    rows = rows.withColumn("own", known)
    below: DataFrame | None = None
    place = ["root_key", "p1", "p2", "p3"]
    for depth in (3, 2, 1, 0):
        level = rows.where(F.col("depth") == depth)
        text = F.col("own")
        if below is not None:
            level = level.join(below, place[: depth + 1], "left")
            text = F.when(F.col("inner").isNull(), text).otherwise(F.concat(opened, F.lit(',"children":['), F.col("inner"), F.lit("]}")))
        if depth:
            ordered = F.transform(F.array_sort(F.collect_list(F.struct(place[depth], text.alias("text")))), lambda x: x["text"])
            below = level.groupBy(*place[:depth]).agg(F.array_join(ordered, ",").alias("inner"))
    one = F.concat(F.lit('"'), F.col("root_key"), F.lit('":'), text)
    roots = level.agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("roots"))
    whole = F.concat(F.lit('{"checksum":"c","roots":{'), F.col("roots"), F.lit('},"version":1}'))
    return roots.select(F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("n"), whole.alias("text")).select(F.concat(F.lit("copy "), F.col("n").cast("string"), F.lit("/100%")).alias("doc_id"), "text")


def faulty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a small document for each page, seven of eight with a fault of their own kind."""
    kind = F.col("page_id") % 8
    fault = F.when(kind == 2, '"visit_count":-1').when(kind == 3, '"date_added":"x"').when(kind == 4, '"guid":7').when(kind == 5, '"source":"?"').otherwise('"id":"1"')
    node = F.concat(F.lit('{"type":"'), F.when(kind == 6, "odd").otherwise("url"), F.lit('","url":"'), F.col("url"), F.lit('",'), fault, F.lit(',"children":[{"type":"folder","name":1}]}'))
    version = F.when(kind == 1, "2").otherwise("1")
    text = F.concat(F.lit('{"roots":{"bar":{"type":"folder","children":[{"type":"separator"},'), node, F.lit(']}},"version":'), version, F.when(kind == 7, "").otherwise("}"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("doc_id"), text.alias("text"))
