"""Inventories of files: formats, duplicates, differences and the work list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_format(path: Column) -> Column:
    """Format by suffix, letter case ignored; null is unsupported."""
    p = F.lower(path)
    return F.when(p.endswith(".pdf"), "pdf").when(p.endswith(".jpg") | p.endswith(".jpeg"), "jpeg")


def summary(inventory: DataFrame) -> DataFrame:
    """Counts per generation."""
    return inventory.groupBy("generation_id").agg(
        F.count_if(F.col("file_format").isNotNull()).alias("supported"),
        F.count_if(F.col("file_format").isNull() & (F.col("kind") == "file")).alias("unsupported"),
        F.count_if((F.col("status") == "ready") & F.col("content_hash").isNotNull()).alias("ready"),
        F.count_distinct("content_hash").alias("contents"),
    )


def sources_by_content(inventory: DataFrame) -> DataFrame:
    """Contents with all their paths in order; one shared relation for many joins."""
    known = inventory.where(F.col("content_hash").isNotNull())
    return known.groupBy("generation_id", "content_hash").agg(F.sort_array(F.collect_set("relative_path")).alias("sources"))


def work_list(inventory: DataFrame) -> DataFrame:
    """One row per content and format to read: its first path and the copies."""
    ready = inventory.where((F.col("status") == "ready") & F.col("content_hash").isNotNull() & F.col("file_format").isNotNull())
    return ready.groupBy("generation_id", "content_hash", "file_format").agg(F.min("relative_path").alias("first_path"), (F.count(F.lit(1)) - 1).alias("copies"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """``diff_kind, relative_path``: added, removed, changed and unverifiable paths.

    A full outer join on the path. A path is changed when status, hash, kind or
    format differ (nulls are equal), unverifiable when either side has no hash;
    it can be both. Warnings do not count."""
    fields = ("kind", "file_format", "status", "content_hash")
    a = before.select("relative_path", F.struct(*fields).alias("a"))
    b = after.select("relative_path", F.struct(*fields).alias("b"))
    joined = a.join(b, "relative_path", "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    tags = F.array(
        F.when(F.col("a").isNull(), "added"), F.when(F.col("b").isNull(), "removed"),
        F.when(both & ~F.col("a").eqNullSafe(F.col("b")), "changed"),
        F.when(both & (F.col("a.content_hash").isNull() | F.col("b.content_hash").isNull()), "unverifiable"),
    )
    return joined.select(F.explode(F.array_compact(tags)).alias("diff_kind"), "relative_path")


def consistency(diff: DataFrame) -> DataFrame:
    """One row: counts by kind, whether consistent, and the reason if not."""
    counts = diff.agg(*[F.count_if(F.col("diff_kind") == k).alias(k) for k in ("added", "removed", "changed", "unverifiable")])
    moved = F.col("added") + F.col("removed") + F.col("changed") > 0
    reason = F.when(moved, "SOURCE_CHANGED").when(F.col("unverifiable") > 0, "SOURCE_UNVERIFIABLE")
    return counts.withColumns({"consistent": reason.isNull(), "reason": reason})


def outcomes(inventory: DataFrame) -> DataFrame:
    """Per generation, content and format: the worst status and all warnings."""
    known = inventory.where(F.col("content_hash").isNotNull() & F.col("file_format").isNotNull())
    rank = status_rank(F.col("status"))
    return known.groupBy("generation_id", "content_hash", "file_format").agg(
        F.max_by("status", F.struct(rank, "status")).alias("status"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("warnings")))).alias("warnings"))


def status_rank(status: Column) -> Column:
    """0 is best; unknown states are as bad as failed ones."""
    return F.when(status.isin("ready", "completed"), 0).when(status == "partial", 1).when(status.isin("unsupported", "skipped"), 2).otherwise(3)


def same_content(items: DataFrame, member: str) -> DataFrame:
    """``content_hash, copies, members``: contents with all that carry them, in order."""
    known = items.where(F.col("content_hash").isNotNull())
    return known.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.sort_array(F.collect_list(member)).alias("members"))


def with_counts(parents: DataFrame, children: DataFrame, key: str, out: str) -> DataFrame:
    """Parents with the number of their children; parents without any have 0.
    Children are counted before they move."""
    n = children.groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return parents.join(n, key, "left").fillna(0, [out])
