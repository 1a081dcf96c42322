"""Relational operators over facts, units and their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["content_hash", "file_format"]
# Codes that a page is listed for although it is complete.
COVERAGE_CODES = ("HANDWRITING_NOT_INTERPRETED", "MISSING_CONTEXT", "POSSIBLE_INCOMPLETE_TABLE_EXTRACTION", "VISION_ITEMS_DROPPED", "TEXT_LAYER_COVERAGE_UNVERIFIED")


def fact_counts(labs: DataFrame, events: DataFrame) -> DataFrame:
    """Facts and verified facts of both tables per content and format.

    Each side is aggregated before the union, so only counts move."""
    def part(df: DataFrame) -> DataFrame:
        return df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("verification") == "verified").alias("verified"))

    return part(labs).unionByName(part(events)).groupBy(*KEYS).agg(F.sum("facts").alias("facts"), F.sum("verified").alias("verified"))


def with_sources(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts with the sorted paths of their content; none gives an empty array."""
    return facts.join(sources.select("content_hash", "sources"), "content_hash", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key by ``order``; an aggregate, so hot keys combine
    before they move."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*")


def unit_outcomes(spans: DataFrame) -> DataFrame:
    """Status and warnings of every page, from its spans."""
    letters = F.sum(F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")))
    units = spans.groupBy(*KEYS, "unit_number").agg(F.bool_or(F.col("x0").isNull()).alias("unlocated"), letters.alias("letters"), F.count(F.lit(1)).alias("spans"))
    warnings = F.array_compact(F.array(F.when(F.col("letters") < 10, "TEXT_LAYER_LOW_QUALITY"), F.when(F.col("unlocated"), "TEXT_LOCATION_UNAVAILABLE")))
    return units.select(*KEYS, "unit_number", "spans", F.when(F.size(warnings) == 0, "completed").otherwise("partial").alias("status"), warnings.alias("warnings"))


def coverage_units(units: DataFrame) -> DataFrame:
    """Pages that are not complete or carry a coverage code."""
    codes = F.array(*[F.lit(c) for c in COVERAGE_CODES])
    return units.where((F.col("status") != "completed") | F.arrays_overlap("warnings", codes))


def roll_up(units: DataFrame, expected: DataFrame) -> DataFrame:
    """Status of every content from its pages and the pages expected.

    Completed when all expected pages are; partial when anything was kept;
    failed otherwise; an unknown page count never completes."""
    agg = units.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("status") == "completed").alias("whole"), F.bool_or(F.col("status").isin("completed", "partial")).alias("kept"))
    rows = expected.join(agg, "content_hash", "left")
    whole = F.col("whole") & (F.col("n") == F.col("page_count"))
    return rows.select("content_hash", F.when(whole, "completed").when(F.col("kept"), "partial").otherwise("failed").alias("status"))


def unique_prefixes(ids: DataFrame, key: str, length: int) -> DataFrame:
    """Prefixes of ``length`` that name exactly one id."""
    p = F.substring(F.col(key), 1, length).alias("prefix")
    return ids.select(key).distinct().groupBy(p).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("only")).where("n = 1").select("prefix", "only")


def find_fact(labs: DataFrame, events: DataFrame, key: str, prefix: str) -> DataFrame:
    """The fact whose id begins with ``prefix``, lab facts first; empty unless unique."""
    for df in (labs, events):
        hits = df.where(F.col(key).cast("string").startswith(prefix)).limit(2)
        if hits.count() == 1:
            return hits
    return labs.limit(0)


def cache_misses(wanted: DataFrame, memo: DataFrame, keys: list[str]) -> DataFrame:
    """What the memo does not hold yet."""
    return wanted.join(memo.select(*keys).distinct(), keys, "left_anti")


def units_histogram(facts: DataFrame) -> DataFrame:
    """Facts per unit text."""
    return facts.where(F.col("unit").isNotNull()).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


def top_warnings(warnings: DataFrame, order: list[str], most: int = 30) -> DataFrame:
    """The first ``most`` lines, priority lines first, and a line for the rest.

    Each task keeps its first lines only; positions are given to what is left,
    and of the rest only the count is kept."""
    top = warnings.orderBy(F.col("priority").desc(), *order).limit(most)
    # A window over at most ``most`` rows.
    seq = F.row_number().over(Window.orderBy(F.col("priority").desc(), *order)).cast("long")
    rest = warnings.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    rest = rest.select(F.lit(most + 1).cast("long").alias("seq"), F.lit(False).alias("priority"), F.format_string("… and %d more coverage warnings elsewhere in the collection", F.col("n") - most).alias("line"))
    return top.select(seq.alias("seq"), "priority", "line").unionByName(rest)


def availability(checks: DataFrame, results: DataFrame, contents: DataFrame) -> DataFrame:
    """Checks with what is left of what they were made on."""
    r = results.select(F.col("fact_id").alias("result_id"), F.lit(True).alias("_r")).distinct()
    c = contents.select("content_hash", F.lit(True).alias("_c")).distinct()
    state = F.when(F.col("_r"), "result and evidence available").when(F.col("_c"), "document present; result not in this generation").otherwise("unavailable")
    return checks.join(r, "result_id", "left").join(c, "content_hash", "left").withColumn("availability", state).drop("_r", "_c")


def observed_by_state(checks: DataFrame, labs: DataFrame, events: DataFrame) -> DataFrame:
    """Verdicts against the state of the fact they were given on."""
    a = labs.select(F.col("fact_id").alias("result_id"), F.col("verification").alias("_a"))
    b = events.select(F.col("fact_id").alias("result_id"), F.col("verification").alias("_b"))
    rows = checks.join(a, "result_id", "left").join(b, "result_id", "left")
    return rows.groupBy("verdict", F.coalesce("_a", "_b", F.lit("gone")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def islands(df: DataFrame, keys: list[str], order: list[str], gap: str, most: float, out: str = "island") -> DataFrame:
    """Numbers runs whose ``gap`` column to the row before stays within ``most``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    start = F.when(F.col(gap).isNull() | (F.col(gap) > most), 1).otherwise(0)
    return df.withColumn("_s", start).withColumn(out, F.sum("_s").over(w)).drop("_s")
