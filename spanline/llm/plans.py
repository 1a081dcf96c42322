"""The queries of the operators for language-model data, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from .canonical import map_to_list, near_entries, not_listed
from .details import find_details, redact
from .leaks import find_leaks
from .lookalikes import changed_rows, normalise_text
from .mixing import mix, queued, shares, short_sources
from .scans import paragraphs, scan_noise
from .sentences import split_sentences


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and lines that are not in their one consistent form."""
    terms = load(spark, sf_dir, "concept_terms")
    parts = (("lab_facts", "fact_id", "raw_label"), ("spans", "span_id", "text"))
    labels, spans = (changed_rows(load(spark, sf_dir, t), k, c, terms).select(F.lit(t).alias("tab"), "row_id") for t, k, c in parts)
    return labels.union(spans).distinct()


def p2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label in its one consistent form."""
    return normalise_text(load(spark, sf_dir, "lab_facts").select("fact_id", "raw_label"), "raw_label", terms=load(spark, sf_dir, "concept_terms")).select("fact_id", "plain_text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freely entered labels and specialties with the concept meant."""
    terms = load(spark, sf_dir, "concept_terms")
    parts = (("lab_facts", "raw_label", "analyte"), ("event_facts", "raw_specialty", "specialty"))
    labs, events = (map_to_list(not_listed(load(spark, sf_dir, t).select("fact_id", c), c, terms, k), c, terms, k).select("fact_id", "concept_id") for t, c, k in parts)
    return labs.union(events).distinct()


def p5_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of the list near each freely entered label."""
    return near_entries(load(spark, sf_dir, "lab_facts"), "raw_label", load(spark, sf_dir, "concept_terms"), "analyte")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wordings and lines that hold personal details, with their types."""
    parts = (("event_facts", "fact_id", "wording"), ("spans", "span_id", "text"))
    events, spans = (find_details(load(spark, sf_dir, t), k, c).select(F.lit(t).alias("tab"), "row_id", "pii_type") for t, k, c in parts)
    return events.union(spans).distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every wording and line with its details replaced by placeholders."""
    parts = (("event_facts", "fact_id", "wording"), ("spans", "span_id", "text"))
    events, spans = (redact(load(spark, sf_dir, t).select(F.lit(t).alias("tab"), F.col(k).alias("row_id"), c), c).select("tab", "row_id", "redacted") for t, k, c in parts)
    return events.union(spans)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with page furniture, broken words and misread letters."""
    return scan_noise(load(spark, sf_dir, "spans"))


def p7_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every content as continuous paragraphs."""
    return paragraphs(load(spark, sf_dir, "spans"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items they leak."""
    return find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their target."""
    return short_sources(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets")).select("source").distinct()


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix, in its order."""
    return mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares the mix reaches."""
    targets = load(spark, sf_dir, "mix_targets")
    return shares(queued(load(spark, sf_dir, "documents"), targets), targets).select("source", "target_share", "tokens", "repeats", F.round("actual_share", 4).alias("actual_share"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of every document."""
    return split_sentences(load(spark, sf_dir, "documents")).distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_labels, p5_found, p5_entries, p6_found, p6_redacted, p7_found, p7_paragraphs, p8_found, p9_found, p9_mix, p9_shares, p10_found)}
SQL: dict[str, str] = {}
