"""The guard before a new generation replaces the active one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inventory import status_rank

KEYS = ["content_hash", "file_format"]


def has_usable_evidence(outcomes: DataFrame) -> DataFrame:
    """Per generation whether any content was read at least in part."""
    return outcomes.groupBy("generation_id").agg(F.bool_or(status_rank(F.col("status")) <= 1).alias("usable"))


def evaluate_replacement(active: DataFrame, candidate: DataFrame, active_files: DataFrame, candidate_files: DataFrame) -> DataFrame:
    """``finding, subject, detail``: what would get worse.

    ``active`` and ``candidate`` hold one row per content and format with
    ``status, warnings, facts, verified``; the files are inventories. Removed
    contents are never findings."""
    a = active.select(*KEYS, *[F.col(c).alias(f"a_{c}") for c in ("status", "warnings", "facts", "verified")])
    both = candidate.join(a, KEYS)
    subject = F.concat_ws(":", *KEYS)

    def change(x: str) -> F.Column:
        return F.concat(F.col(f"a_{x}").cast("string"), F.lit(" -> "), F.col(x).cast("string"))

    def found(df: DataFrame, kind, detail) -> DataFrame:
        return df.select(kind.alias("finding"), subject.alias("subject"), detail.alias("detail"))

    worse = both.where(status_rank(F.col("status")) > status_rank(F.col("a_status")))
    new_failure = F.when(status_rank(F.col("status")) >= 3, "new processing failure").otherwise("worse processing status")
    warned = both.withColumn("w", F.explode(F.array_except("warnings", "a_warnings")))
    parts = [
        found(worse, new_failure, change("status")),
        found(warned, F.lit("new coverage warning"), F.col("w")),
        found(both.where(F.col("facts") < F.col("a_facts")), F.lit("fewer extracted facts"), change("facts")),
        found(both.where(F.col("verified") < F.col("a_verified")), F.lit("fewer verified facts"), change("verified")),
        found(candidate.join(a, KEYS, "left_anti").where(status_rank(F.col("status")) > 0), F.lit("new content not fully processed"), F.col("status")),
    ]
    before = active_files.select("relative_path", F.col("status").alias("a_status"))
    files = candidate_files.where(F.col("status") != "ready").join(before, "relative_path", "left")
    files = files.where(F.col("a_status").isNull() | (F.col("a_status") == "ready"))
    parts.append(files.select(F.lit("new unsupported or failed file").alias("finding"), F.col("relative_path").alias("subject"), F.col("status").alias("detail")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
