"""Maintenance dataflows: duplicates, pruning, moves, migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlake.functions.text import file_hash, move_prefix

_KNOWN = "message_id is not null and message_id <> ''"


def duplicate_groups(emails: DataFrame) -> DataFrame:
    """message_id and number of rows of each id that more than one row has."""
    return emails.where(_KNOWN).groupBy("message_id").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")


def duplicate_counts(emails: DataFrame) -> DataFrame:
    """One row: groups, and rows that removing duplicates would delete."""
    return duplicate_groups(emails).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).cast("long").alias("surplus"))


def newest_rows(emails: DataFrame) -> DataFrame:
    """(message_id, kept_id): the newest row (by indexed_at, then id) of each message id.

    An aggregate that is combined before the shuffle, so an id that very many rows have makes no long task.
    """
    order = F.struct(F.coalesce("indexed_at", F.lit("0001-01-01").cast("timestamp")).alias("at"), F.col("id").alias("i"))
    return emails.where(_KNOWN).groupBy("message_id").agg(F.max(order)["i"].alias("kept_id"))


def surplus_rows(emails: DataFrame) -> DataFrame:
    """Rows to delete: all but the newest of each message id; rows without an id are never surplus."""
    return emails.where(_KNOWN).join(newest_rows(emails).select(F.col("kept_id").alias("id")), "id", "left_anti")


def keep_latest(emails: DataFrame) -> DataFrame:
    """Rows that stay: the newest of each message id, and all without one."""
    newest = emails.where(_KNOWN).join(newest_rows(emails).select(F.col("kept_id").alias("id")), "id", "left_semi")
    return newest.unionByName(emails.where(~F.coalesce(F.expr(_KNOWN), F.lit(False))))


def best_per_message(results: DataFrame, rank: str = "rank") -> DataFrame:
    """Search results without duplicates: of one message id the row with the lowest distance (a missing one
    is 1.0, ties keep the first), at the place of its first appearance; rows without an id all stay.

    ``rank`` is the row's place in the results, which are few.
    """
    key = F.coalesce(F.nullif(F.col("message_id"), F.lit("")), F.concat(F.lit("\x00row:"), F.col(rank).cast("string")))
    keyed = results.withColumn("_key", key)
    best = Window.partitionBy("_key").orderBy(F.coalesce("distance", F.lit(1.0)), rank)
    out = keyed.withColumn("_n", F.row_number().over(best)).withColumn("_first", F.min(rank).over(Window.partitionBy("_key")))
    return out.where("_n = 1").withColumn(rank, F.col("_first")).drop("_key", "_n", "_first")


def orphans(emails: DataFrame, present: DataFrame, root: str | None = None) -> DataFrame:
    """Rows whose file isn't in ``present(file_path)``; with ``root`` only those below it are judged."""
    judged = emails if root is None else emails.where(F.startswith(F.col("file_path"), F.lit(root.rstrip("/") + "/")))
    return judged.join(present.select("file_path"), "file_path", "left_anti")


def orphan_counts(emails: DataFrame, present: DataFrame) -> DataFrame:
    """One row: rows with and without a file."""
    seen = present.select("file_path").distinct().withColumn("_seen", F.lit(True))
    return emails.join(seen, "file_path", "left").agg(F.count_if(F.col("_seen").isNull()).alias("missing"), F.count_if(F.col("_seen").isNotNull()).alias("present"))


def moved(emails: DataFrame, incoming: DataFrame) -> DataFrame:
    """Indexed rows that a new message with the same id under another path replaces."""
    fresh = incoming.where(_KNOWN).select("message_id", F.col("file_path").alias("new_path"))
    return emails.where(_KNOWN).alias("e").join(fresh.alias("n"), (F.col("e.message_id") == F.col("n.message_id")) & (F.col("e.file_path") != F.col("n.new_path")), "left_semi")


def migrate_paths(emails: DataFrame, vectors: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with paths below ``old`` moved below ``new``: hashes and vector ids follow, embeddings stay.

    Where the new path exists already its row stays and the old one goes, so a second run changes nothing.
    """
    there = emails.withColumn("_to", move_prefix("file_path", old, new))
    still = there.where("_to is null").drop("_to")
    moving = there.where("_to is not null").join(emails.select(F.col("file_path").alias("_to")), "_to", "left_anti")
    moving = moving.withColumn("file_path", F.col("_to")).withColumn("file_hash", file_hash("_to")).drop("_to").select(*emails.columns)
    v = vectors.withColumn("_to", move_prefix("file_path", old, new))
    kept = v.where("_to is null").drop("_to")
    moved_v = v.where("_to is not null").withColumn("_id", file_hash("_to")).join(vectors.select(F.col("id").alias("_id")), "_id", "left_anti")
    moved_v = moved_v.withColumn("file_path", F.col("_to")).withColumn("id", F.col("_id")).drop("_to", "_id").select(*vectors.columns)
    return still.unionByName(moving), kept.unionByName(moved_v)
