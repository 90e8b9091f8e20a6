"""The node table that all operators share, its order and its graph of identities.

One row a node: doc_id, node_id (its path, unique in a document), parent_id (null at a root), root_key, idx
(child indexes from the root), child_pos, depth, path, type, name, url, date_added, date_modified,
date_last_used, visit_count, guid, id, source, show_icon, extra (JSON of unknown fields by name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.operators.groups import numbered

FOLDER, URL = "folder", "url"
COLUMNS = (
    "doc_id string, node_id string, parent_id string, root_key string, idx array<int>, child_pos int, depth int, path string, "
    "type string, name string, url string, date_added string, date_modified string, date_last_used string, visit_count bigint, "
    "guid string, id string, source string, show_icon boolean, extra map<string,string>"
)


def arena() -> Column:
    """A node's place in the order that settles all ties, as a value to sort by: by root; a depth-1 node,
    then its subtree; in that blocks of siblings by their parent's path, each from the last sibling on."""
    return F.struct(
        F.col("root_key").alias("root"), F.slice("idx", 1, 1).alias("first"), (F.size("idx") > 1).alias("below"),
        F.slice("idx", F.lit(2), F.greatest(F.size("idx") - 2, F.lit(0))).alias("block"), (-F.col("child_pos")).alias("turned"),
    )


def arena_order(nodes: DataFrame) -> DataFrame:
    """(doc_id, path, position): places counted from 1 in each document."""
    return numbered(nodes.select("doc_id", "path", arena().alias("turn")), ["doc_id"], [F.col("turn")], "position", 1).drop("turn")


def input_counts(nodes: DataFrame) -> DataFrame:
    """Folders (roots included) and addresses of each document."""
    return nodes.groupBy("doc_id").agg(F.count_if(F.col("type") == FOLDER).alias("folders_seen"), F.count_if(F.col("type") == URL).alias("urls_seen"))


def with_identity(nodes: DataFrame) -> DataFrame:
    """Folders with the key that identifies them: guid, else id, else their path."""
    return nodes.where(F.col("type") == FOLDER).withColumn("key", F.coalesce("guid", "id", F.concat(F.lit("path:"), "path")))


def identity_vertices(nodes: DataFrame) -> DataFrame:
    return with_identity(nodes).select("doc_id", "key").distinct()


def identity_edges(nodes: DataFrame) -> DataFrame:
    """Distinct containments of folders in folders, between keys; a folder in one of its own key is a loop."""
    folders = with_identity(nodes).select("doc_id", "node_id", "parent_id", "key")
    parents = folders.select("doc_id", F.col("node_id").alias("parent_id"), F.col("key").alias("src"))
    return folders.join(parents, ["doc_id", "parent_id"]).select("doc_id", "src", F.col("key").alias("dst")).distinct()
