"""Named queries over the derived forest, one or more for each operator; plans.sql has the SQL of each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.text import canonical_url as canonical, u64
from thicket.operators.groups import numbered
from thicket.operators import dedup, merge, nodes as N, order, prune, scc, validate
from thicket.plans.normalize import normalize
from thicket.plans.staging import send_modules, shared_root, staged
from thicket.sources import derived, documents as D
from thicket.sources.derived import functional_graph


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived forest, built once for the several times that a query reads it."""
    return staged(derived.forest(spark, sf_dir), "forest")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_folders(forest(spark, sf_dir))[0]


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.winners(merge.eligible(forest(spark, sf_dir)))


def _deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(dedup.dedup_urls(staged(_merged(spark, sf_dir), "merged"))[0], "deduped")


def _left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prune.prune_empty(_deduped(spark, sf_dir))[0]


def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    odd = F.concat(F.lit(" "), F.upper("url"), F.lit("#a#b "))
    return pages.select("page_id", F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("url").alias("u")), F.struct(F.lit(1).alias("v"), odd.alias("u")))).alias("x")).select("page_id", "x.v", canonical(F.col("x.u")).alias("canon"))


def u64_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("page_id").cast("string")
    kinds = [text, F.concat(F.lit("+"), text), F.concat(F.lit("000"), text), *map(F.lit, (" 5", "1e3", "99999999999999999999", "18446744073709551615", "-3", ""))]
    s = F.element_at(F.array(*kinds), (F.col("page_id") % 9 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", s.alias("s")).select("page_id", "s", u64(F.col("s")).cast("string").alias("n"))


def folder_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.eligible(forest(spark, sf_dir)).select("path", "key")


def input_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.input_counts(forest(spark, sf_dir)).drop("doc_id")


def flatten_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest(spark, sf_dir).select("path", "parent_id", "root_key", "depth", "child_pos", "type", "name", "url", "id", "date_added", "date_modified", "date_last_used", "visit_count")


def arena_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.arena_order(forest(spark, sf_dir)).drop("doc_id")


def folder_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).select("key", "winner")


def folder_merge_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("path", "new_parent")


def folder_merge_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).select("key", "winner_path", "group_size", "visits", "modified")


def merged_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_folders(forest(spark, sf_dir))[2].select("merged_from", "merged_into")


def merge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, groups, origin = merge.merge_folders(forest(spark, sf_dir))
    return merge.merge_events(groups, origin).select("normalized_name", "group_size", "winner_path", F.array_join("losers", ",").alias("losers"))


def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.candidates(_merged(spark, sf_dir))
    return found.groupBy("new_parent", "canon").agg(F.min_by("node_id", dedup.url_rank()).alias("winner"))


def url_dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_urls(_merged(spark, sf_dir))[1].drop("doc_id")


def prune_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prune.kept_folders(_deduped(spark, sf_dir)).select(F.col("node_id").alias("path"))


def prune_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prune.prune_empty(_deduped(spark, sf_dir))[1].select("path")


def sibling_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.sibling_order(_left(spark, sf_dir)).select("path", "new_parent", "position")


def folder_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.folder_registry(_left(spark, sf_dir)).drop("doc_id")


def all_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.all_unique(order.folder_registry(_left(spark, sf_dir))).drop("doc_id")


def _violations(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    nodes = forest(spark, sf_dir).withColumn("new_parent", F.col("parent_id"))
    return validate.violations(nodes).where(F.col("rule") == rule)


def viol_global_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir, "folder_name_not_unique").select("detail", "path")


def viol_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the entries of every other segment folder."""
    nodes = forest(spark, sf_dir).where("depth < 3 or idx[1] % 2 = 0").withColumn("new_parent", F.col("parent_id"))
    return validate.violations(nodes).where("rule = 'empty_folder'").select("path")


def viol_folders_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every other nation turned into something else than a folder."""
    kind = F.when((F.col("depth") == 1) & (F.col("child_pos") % 2 == 1), "other").otherwise(F.col("type"))
    nodes = forest(spark, sf_dir).withColumns({"type": kind, "new_parent": F.col("parent_id")})
    return validate.violations(nodes).select("rule", "path", "detail")


def viol_dup_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the nations' folders taken out, so that segments of one name meet below their region."""
    nodes = forest(spark, sf_dir).where("depth <> 1").withColumn("new_parent", F.when(F.col("depth") == 2, F.col("root_key")).otherwise(F.col("parent_id")))
    return validate.violations(nodes).where("rule = 'duplicate_child_folder'").select("path", "detail")


def viol_dup_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir, "duplicate_url").select("path", "detail")


def violations_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With roots that bear a segment's name, which merging leaves alone."""
    nodes = forest(spark, sf_dir).withColumn("name", F.when(F.col("depth") == 0, F.lit(" Building")).otherwise(F.col("name")))
    return normalize(nodes).violations.select("rule", "detail")


def identity_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.identity_vertices(forest(spark, sf_dir)).select("key")


def identity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.identity_edges(forest(spark, sf_dir)).select("src", "dst")


def identity_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = forest(spark, sf_dir)
    vertices, edges = N.identity_vertices(nodes), N.identity_edges(nodes)
    return scc.summary(vertices, edges, scc.strongly_connected(vertices, edges)).drop("doc_id")


def scc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scc.strongly_connected(*functional_graph(spark, sf_dir)).drop("doc_id")


def scc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, edges = functional_graph(spark, sf_dir)
    return scc.summary(vertices, edges, scc.strongly_connected(vertices, edges)).drop("doc_id")


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(forest(spark, sf_dir)).stats.drop("doc_id")


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(forest(spark, sf_dir)).events.groupBy("type").agg(F.count("*").alias("n"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(forest(spark, sf_dir)).events.drop("doc_id")


def prune_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed folders in post-order, of a forest whose entries all hang below a sixth of the segments."""
    none = F.when(F.lit(False), merge.folder_rank())  # as where nothing was merged
    nodes = forest(spark, sf_dir).where("depth < 3 or (idx[0] + 2 * idx[1]) % 6 = 0").withColumns({"new_parent": F.col("parent_id"), "child_order": F.struct(none.alias("parent_rank"), "child_pos")})
    nodes = staged(nodes, "unique")
    _, gone = prune.prune_empty(nodes)
    return numbered(prune.postorder(staged(gone, "gone"), nodes), ["doc_id"], [F.col("top"), F.col("turn")], "seq", 1).select("seq", "path")


def registry_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.registry_report(order.folder_registry(_left(spark, sf_dir))).drop("doc_id")


_NODE = ("type", "name", "url", "id", "date_added", "date_modified", "date_last_used", "visit_count")


def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.flatten(derived.json_documents(spark, sf_dir)).select("doc_id", "path", "parent_id", "root_key", "depth", "child_pos", *_NODE)


def json_schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.schema_violations(derived.faulty_documents(spark, sf_dir))
    return found.select("doc_id", "place", "path", F.substring_index("error", ":", 1).alias("error"))


def document_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents flattened, normalised, nested, written, read, checked and flattened again."""
    docs = derived.json_documents(spark, sf_dir)
    target = f"{shared_root(spark).rstrip('/')}/forest/documents-{uuid.uuid4().hex}"
    D.write_documents(D.nest(docs, normalize(D.flatten(docs)).nodes), target)
    back = D.read_documents(spark, target)
    wrong = D.schema_violations(back).select("doc_id").distinct()
    return D.flatten(back.join(wrong, "doc_id", "left_anti")).select("doc_id", "path", *_NODE)


def normalized_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(forest(spark, sf_dir)).nodes.select("path", "new_parent", "position", "type", "name", "url", "id", "date_added", "date_modified", "date_last_used", "visit_count")


_ALL = (
    canonical_url, u64_parse, folder_key, input_counts, flatten_nodes, arena_order, folder_winner, folder_merge_map, folder_merge_attrs, merged_from, merge_events, url_dedup,
    url_dedup_counts, prune_keep, prune_removed, sibling_order, folder_registry, all_unique, viol_global_unique, viol_empty, viol_dup_child, viol_dup_url, violations_left,
    identity_vertices, identity_edges, identity_scc, scc_labels, scc_summary, stats, event_counts, event_log, prune_order, registry_report, viol_folders_only,
    json_flatten, json_schema_errors, document_round_trip, normalized_nodes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def sent(query: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            send_modules(spark)
            return query(spark, sf_dir)

        return run

    return {f.__name__: sent(f) for f in _ALL}


def oracle_sql() -> dict[str, str]:
    from thicket.plans import sql

    return sql.oracle_sql()
