"""Merging of equally named folders across a document.

A winner is the least of its group in an order that merging never changes, and no winner loses elsewhere,
so one aggregation and one join do it all. Groups are aggregated before the shuffle, never sorted, and large
ones are joined back by broadcast, so a name that very many folders share is no one task's burden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.text import U64_MAX, u64, with_merge_key
from thicket.operators.groups import join_groups
from thicket.operators.nodes import FOLDER, arena
from thicket.plans.staging import staged


def _number(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(20,0)")


def folder_rank() -> Column:
    """A folder's rank in its group, smallest first: outermost; earliest added, unknown last; id by number,
    then missing, then by text; guid, missing first; arena order."""
    number = u64(F.col("id"))
    return F.struct(
        F.col("depth"), F.coalesce(u64(F.col("date_added")), _number(U64_MAX)).alias("added"), number.isNull().alias("no_number"), number.alias("number"),
        F.when(number.isNull(), F.col("id")).alias("text"), F.col("guid"), arena().alias("arena"),
    )


def eligible(nodes: DataFrame) -> DataFrame:
    """Named folders below the roots with their group's ``key`` and their ``rank`` in it."""
    return with_merge_key(nodes.where((F.col("type") == FOLDER) & (F.col("depth") > 0) & F.col("name").isNotNull()), "name", "key").withColumn("rank", folder_rank())


def winners(folders: DataFrame) -> DataFrame:
    """For each group of eligible folders: winner and its rank, size, the sum of visit counts (null if none
    is known) and the latest date_modified as it was written, of equal ones that of the best rank."""
    modified = F.coalesce(u64(F.col("date_modified")), _number(0))
    return folders.groupBy("doc_id", "key").agg(
        F.min_by("node_id", "rank").alias("winner"), F.min_by("path", "rank").alias("winner_path"), F.count("*").alias("group_size"),
        F.sum("visit_count").alias("visits"), F.min_by("date_modified", F.struct((-modified).alias("m"), "rank")).alias("modified"),
    )


def merge_folders(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes without losing folders, with ``new_parent`` and ``child_order``; the groups; and which folder
    was merged_from / merged_into which.

    Winners carry their group's visit_count and date_modified; a loser's other fields go. Children of
    losers follow the winner's own, in order of the losers' rank.
    """
    folders = staged(eligible(nodes).select("doc_id", "key", "node_id", "path", "rank", "visit_count", "date_modified"), "folders")
    groups = staged(winners(folders), "groups")
    placed = join_groups(folders.drop("visit_count", "date_modified"), groups, ["doc_id", "key"], "group_size")
    placed = staged(placed.select("doc_id", "key", "node_id", "path", "rank", "winner", "winner_path", "visits", "modified"), "placed")
    fate = placed.select("doc_id", "node_id", "winner", "rank", "visits", "modified")
    own = fate.select("doc_id", "node_id", F.col("winner").alias("own_winner"), "visits", "modified")
    parent = fate.select("doc_id", F.col("node_id").alias("parent_id"), F.col("winner").alias("parent_winner"), F.col("rank").alias("parent_rank"))
    joined = nodes.join(own, ["doc_id", "node_id"], "left").where(F.col("own_winner").isNull() | (F.col("own_winner") == F.col("node_id"))).join(parent, ["doc_id", "parent_id"], "left")
    won = F.col("own_winner").isNotNull()
    merged = joined.withColumns({
        "new_parent": F.coalesce("parent_winner", "parent_id"), "child_order": F.struct("parent_rank", "child_pos"),
        "visit_count": F.when(won, F.col("visits")).otherwise(F.col("visit_count")), "date_modified": F.when(won, F.col("modified")).otherwise(F.col("date_modified")),
    })
    origin = placed.where("winner <> node_id").select("doc_id", "key", F.col("path").alias("merged_from"), F.col("winner_path").alias("merged_into"), "rank")
    return merged.select(*nodes.columns, "new_parent", "child_order"), groups, origin


def merge_events(groups: DataFrame, origin: DataFrame) -> DataFrame:
    """For each group that merged: key, group_size, winner_path and the losers' paths in order of rank."""
    losers = origin.groupBy("doc_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "merged_from"))), lambda x: x["merged_from"]).alias("losers"))
    return groups.where("group_size > 1").join(losers, ["doc_id", "key"]).select("doc_id", F.col("key").alias("normalized_name"), "group_size", "winner_path", "losers")
