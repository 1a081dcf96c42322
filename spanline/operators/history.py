"""The flagship: the history of a term between two dates, in sections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import rows as R
from ..functions import text as T
from ..session import written
from . import layout, terms

# The order of sections in an answer.
SECTIONS = ("dated", "undated", "candidate")


@dataclass(frozen=True)
class HistoryResult:
    """The sections of an answer as DataFrames."""

    rows: DataFrame
    mentions: DataFrame
    excluded_undated: DataFrame


def sections(facts: DataFrame, label: str, matches: DataFrame, window: D.DateRange) -> DataFrame:
    """Matched facts with ``section, placement, reasons``; out-of-range facts are dropped.

    A fact becomes a candidate for review when its terminology is unconfirmed,
    its reading conflicts, it could not be located, or its date is uncertain; an
    unverified reading alone does not. Undated facts are shown only without an
    active window. The filter on the earliest and latest day comes first, as a
    plain comparison the scan can use."""
    start, end = D.envelope(F.col("alternatives"))
    rows = facts
    if window.active:
        inside = F.lit(True)
        if window.start:
            inside = inside & (end >= F.lit(window.start))
        if window.end:
            inside = inside & (start <= F.lit(window.end))
        rows = rows.where(F.coalesce(F.size("alternatives"), F.lit(0)).isin(0, -1) | inside)
    rows = rows.withColumn("placement", D.classify(F.col("alternatives"), window)).where(F.col("placement") != "out of range")
    if window.active:
        rows = rows.where(F.col("placement") != "undated")
    rows = rows.join(matches.withColumnRenamed("label", "_l"), F.col(label) == F.col("_l")).drop("_l")
    notes = F.col("notes") if "notes" in facts.columns else F.array().cast("array<string>")
    reasons = F.array_compact(F.array(
        F.when(~F.col("status").isin("mapped", "raw"), F.concat(F.lit("terminology "), F.col("status"))),
        F.when(F.col("verification") == "conflicting", "conflicting reading"),
        F.when(F.array_contains(notes, "ASSOCIATION_NOT_LOCATED"), "association not located"),
        F.when(F.col("placement") == "date uncertain", "date uncertain"),
    ))
    rows = rows.withColumns({"reasons": reasons, "date_text": D.format_alternatives(F.col("alternatives")), "first_day": F.try_element_at("alternatives", F.lit(1))["start_date"]})
    section = F.when(F.size("reasons") > 0, "candidate").when(F.col("placement") == "undated", "undated").otherwise("dated")
    return rows.withColumn("section", section)


def excluded_undated(facts: DataFrame, label: str, matches: DataFrame, window: D.DateRange) -> DataFrame:
    """One row: matched facts without a date that an active window leaves out."""
    rows = facts.where(F.coalesce(F.size("alternatives"), F.lit(0)).isin(0, -1)) if window.active else facts.limit(0)
    return rows.join(matches.select(F.col("label").alias("_l")), F.col(label) == F.col("_l"), "left_semi").agg(F.count(F.lit(1)).alias("excluded_undated"))


def ordered(rows: DataFrame) -> DataFrame:
    """Sections in order, dated rows by day, then by source and id."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    return rows.orderBy(rank, F.col("first_day").asc_nulls_last(), "content_hash", "unit_number", "fact_id")


def candidate_pages(spans: DataFrame, phrases: list[str]) -> DataFrame:
    """Pages with a span that holds a fragment of a phrase; no phrase, no pages."""
    norm = T.normalise(F.col("text"))
    hit = F.lit(False)
    for f in T.fragments(phrases):
        hit = hit | F.contains(norm, F.lit(f))
    return spans.where(F.coalesce(hit, F.lit(False))).select(*layout.PAGE).distinct()


def sweep(spans: DataFrame, facts: DataFrame, phrases: list[str]) -> DataFrame:
    """``content_hash, unit_number, mentions, example``: mentions of phrases (stems
    joined by spaces) in page text that no matched fact's evidence covers.

    Only pages with a fragment of a phrase are cut into rows. Runs of one to
    three rows whose stems hold a phrase are mentions, unless all spans that carry
    its stems there are evidence of matched facts, whether or not their date is in
    the window. A page's distinct texts are counted, with the least as example.
    Pages without content or number, and phrases that are empty, have none."""
    phrases = [p for p in phrases if p]
    near = spans.join(candidate_pages(spans, phrases), layout.PAGE, "left_semi")
    rows = written(layout.cluster_rows(near, normalised=True), "sweep-rows")
    words = rows.select(*layout.PAGE, "row", T.stems(T.tokens(F.col("text"))).alias("stems"))
    found = layout.mentions(layout.row_windows(words, "stems"), phrases).select(*layout.PAGE, "row", "rows", "phrase")
    lines = found.withColumn("_row", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rows") - 1)))
    lines = lines.join(rows.select(*layout.PAGE, F.col("row").alias("_row"), "members", "parts", "said"), [*layout.PAGE, "_row"])
    refs = F.flatten(F.transform(F.split("phrase", " "), lambda w: R.spans_with(F.col("parts"), F.col("members"), w)))
    runs = lines.groupBy(*layout.PAGE, "row", "rows", "phrase").agg(
        F.array_distinct(F.flatten(F.collect_list(refs))).alias("refs"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_row", "said"))), lambda r: r["said"]), " ").alias("text"))
    covered = facts.select(*layout.PAGE, F.explode("evidence").alias("i")).groupBy(*layout.PAGE).agg(F.collect_set("i").alias("covered"))
    runs = runs.join(covered, layout.PAGE, "left").where(F.col("covered").isNull() | (F.size(F.array_except("refs", "covered")) > 0))
    texts = runs.select(*layout.PAGE, F.substring("text", 1, 100).alias("text")).distinct()
    return texts.groupBy(*layout.PAGE).agg(F.count(F.lit(1)).alias("mentions"), F.min("text").alias("example"))


def units_note(rows: DataFrame) -> DataFrame:
    """One row ``note`` when an answer's rows report more than one unit, else none."""
    n = rows.groupBy(F.coalesce("unit", F.lit("-")).alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    listed = n.agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s (%d)", "unit", "n"))), ", ").alias("l"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return listed.select(F.format_string("Different units are reported: %s. Values are shown as written.", "l").alias("note"))


def newer_staged(generations: DataFrame, active: str) -> DataFrame:
    """The latest finished scan that is staged and began after the active one:
    ``generation_id, started_at, finished_at``, or no row."""
    begun = generations.where(F.col("generation_id") == active).select(F.col("started_at").alias("_a"))
    later = generations.where("kind = 'scan' and state = 'staged' and finished_at is not null").join(F.broadcast(begun.limit(1)), F.col("started_at") > F.col("_a"))
    return later.agg(F.max_by(F.struct("generation_id", "started_at", "finished_at"), F.struct("started_at", "generation_id")).alias("g")).where("g is not null").select("g.*")


def run_query(facts: DataFrame, label: str, spans: DataFrame, term_list: DataFrame, kind: str, term: str, frm: str | None = None, to: str | None = None, groups: DataFrame | None = None) -> HistoryResult:
    """The whole answer for one term: rows in order, mentions, and what a window left out."""
    window = D.parse_range(frm, to)
    words = terms.dictionary(term_list)
    spark = facts.sparkSession
    groups = groups if groups is not None else spark.createDataFrame([], "kind string, name string, member string")
    found = terms.resolve(words, groups, kind, term)
    scope, phrases = list(found.concepts), list(found.phrases)
    if scope:
        labels = facts.select(F.col(label).alias("label"))
        if "alternative_label" in facts.columns:
            labels = labels.union(facts.select("alternative_label"))
        matches = terms.match(labels, "label", words, scope)
        matches = written(terms.best(matches.select("label", "status"), ["label"]), "history-matches")
    else:
        key = spark.createDataFrame([(term,)], "t string").select(T.label_key(F.col("t")).alias("key"), T.stem_key(F.col("t")).alias("stem"))
        d = facts.select(F.col(label).alias("label")).distinct()
        d = d.withColumns({"_k": T.label_key(F.col("label")), "_s": T.stem_key(F.col("label"))})
        exact = d.join(key, F.col("_k") == F.col("key")).select("label", F.lit("raw").alias("status"))
        near = d.join(key, (F.col("_s") == F.col("stem")) & (F.col("_k") != F.col("key"))).select("label", F.lit("inflected").alias("status"))
        matches = exact.unionByName(near)
    if "alternative_label" in facts.columns:  # a fact no label of which matches may match by its other reading
        own = facts.join(matches.select(F.col("label").alias("_l")), F.col(label) == F.col("_l"), "left")
        facts = own.withColumn("_by", F.when(F.col("_l").isNull(), F.col("alternative_label")).otherwise(F.col(label))).drop("_l")
        label = "_by"
    matched = facts.join(matches.select(F.col("label").alias("_l")), F.col(label) == F.col("_l"), "left_semi")
    return HistoryResult(ordered(sections(facts, label, matches, window)), sweep(spans, matched, phrases), excluded_undated(facts, label, matches, window))
