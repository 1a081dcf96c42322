"""Readers of documents and pages as pluggable extractors, run once and remembered.

An extractor is any object with a ``version`` and an ``extract`` method; its results
are kept under keys that hold the version, so a new version reads again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from .files import parse_claims

# Resolutions a page may be drawn at, and pixels of a page and of a document.
DPI_STEPS = (150, 100, 75, 72)
MOST_PAGE_PIXELS, MOST_PIXELS = 8_000_000, 100_000_000
# Warnings that do not keep a reading from being remembered.
HARMLESS = ("TEXT_LAYER_COVERAGE_UNVERIFIED", "TEXT_LOCATION_UNAVAILABLE", "TEXT_LAYER_LOW_QUALITY", "OCR_REQUIRED", "IMAGE_ORIENTATION_APPLIED", "PDF_REPAIRED")
RETRY = ";dropped-retry=1"


class UnitExtractor(Protocol):
    """Reads one page image into claims: a JSON object as ``parse_claims`` takes it."""

    version: str

    def extract(self, content: bytes, hints: list[str]) -> str:
        """The claims; ``hints`` are rows to look at again. Raises when unreadable."""


def page_dpi(pages: Column) -> Column:
    """Resolution of each page, in order: the finest at which this page, and all
    that follow if they were as large, stay within what is left of the document.

    ``pages`` is an array of structs with ``width`` and ``height`` in points. A
    page for which none fits is drawn as coarsely as the steps allow; a page
    without a size counts as too large for any step."""
    n = F.size(pages)

    def pixels(p: Column, dpi: int) -> Column:
        drawn = (F.ceil(p["width"] * dpi / 72) * F.ceil(p["height"] * dpi / 72)).cast("double")
        known = (p["width"] > 0) & (p["height"] > 0)
        return F.when(F.coalesce(known, F.lit(False)), drawn).otherwise(F.lit(MOST_PAGE_PIXELS + 1.0))

    def step(state: Column, p: Column) -> Column:
        remaining = (n - F.size(state["dpi"])).cast("double")
        fits = lambda d: (pixels(p, d) <= MOST_PAGE_PIXELS) & (pixels(p, d) * remaining <= MOST_PIXELS - state["used"])
        chosen = F.coalesce(*[F.when(fits(d), d) for d in DPI_STEPS], F.when(~fits(DPI_STEPS[-1]), DPI_STEPS[-1]))
        drawn = F.coalesce(*[F.when(chosen == d, pixels(p, d)) for d in DPI_STEPS])
        return F.struct((state["used"] + drawn).alias("used"), F.concat(state["dpi"], F.array(chosen)).alias("dpi"))

    start = F.struct(F.lit(0.0).alias("used"), F.array().cast("array<int>").alias("dpi"))
    return F.aggregate(pages, start, step)["dpi"]


def cache_eligible(status: Column, page_count: Column, units: Column, warnings: Column) -> Column:
    """Whether a reading may be remembered: it kept something, has all its pages,
    each with its image, and only harmless warnings. ``units`` is an array of
    structs with ``status, raster, warnings``."""
    allowed = F.array(*[F.lit(w) for w in HARMLESS])
    kept = lambda s: s.isin("completed", "partial")
    harmless = lambda w: F.size(F.array_except(w, allowed)) == 0
    whole = F.forall(units, lambda u: kept(u["status"]) & u["raster"].isNotNull() & harmless(u["warnings"]))
    return F.coalesce(kept(status) & (F.size(units) == page_count) & whole & harmless(warnings), F.lit(False))


def verified_cache(wanted: DataFrame, cache: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Wanted readings (``content_hash, file_format, configuration_hash``) whose
    remembered artifacts are all there unchanged, with their ``reference``.

    ``cache`` holds what was remembered with ``artifacts map<name,digest>``,
    ``artifacts`` the digests found now (``reference, name, digest``). A reading
    without artifacts, or with one missing or changed, is no hit."""
    key = ["content_hash", "file_format", "configuration_hash"]
    hits = wanted.select(*key).distinct().join(cache.select(*key, "reference", "artifacts"), key)
    named = hits.select(*key, "reference", F.explode("artifacts").alias("name", "kept"))
    found = named.join(artifacts.select("reference", "name", F.col("digest").alias("now")), ["reference", "name"], "left")
    whole = found.groupBy(*key, "reference").agg(F.bool_and(F.coalesce(F.col("kept") == F.col("now"), F.lit(False))).alias("same"))
    return whole.where("same").drop("same")


def extracted(pages: DataFrame, extractor: UnitExtractor, store, step: str, version: str | None = None) -> DataFrame:
    """``pages`` (``content_hash, file_format, unit_number, raster_hash, content`` and
    maybe ``hints array<string>``) with ``claims`` and ``failed``.

    Each step of a page is read once: its key is a digest of the step, the page
    and the extractor's version (and its hints); what is remembered is not read
    again. Failures are not remembered, so they are tried again next time."""
    hints = F.col("hints") if "hints" in pages.columns else F.array().cast("array<string>")
    told = F.when(F.size(hints) > 0, F.concat(F.lit(";hints="), F.sha2(F.to_json(hints), 256))).otherwise("")
    key = V.step_key(F.lit(step), F.col("content_hash"), F.col("file_format"), F.col("unit_number"), F.col("raster_hash"), F.concat(F.lit(version or extractor.version), told))
    keyed = pages.withColumns({"hints": hints, "cache_key": key})

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, content, h in zip(f["cache_key"], f["content"], f["hints"], strict=True):
                try:
                    rows.append((k, extractor.extract(bytes(content), list(h) if h is not None else [])))
                except Exception:  # noqa: BLE001 - whatever a reader raises, the page is a failure
                    rows.append((k, None))
            yield pd.DataFrame(rows, columns=["cache_key", "claims"])

    def compute(missing: DataFrame) -> DataFrame:
        todo = keyed.select("cache_key", "content", "hints").dropDuplicates(["cache_key"]).join(missing, "cache_key", "left_semi")
        return todo.mapInPandas(read, "cache_key string, claims string").where(F.col("claims").isNotNull())

    out = store.memoise(f"memo_{step.replace('-', '_')}", ["cache_key"], keyed.drop("content"), compute, "cache_key string, claims string")
    return out.withColumn("failed", F.col("claims").isNull()).drop("cache_key")


def read_pages(pages: DataFrame, extractor: UnitExtractor, store) -> DataFrame:
    """Claims of pages, read in stages: ``content_hash, file_format, unit_number,
    raster_hash, invalid, document_class, lab_rows, event_rows, page_dates, dropped,
    failed``.

    Every page is read; a laboratory report from which rows were dropped is read
    once more and its rows are added, without removing repeats. Pages that cannot
    be read, or whose claims do not parse, are failed; their other columns are null
    or empty. Each stage is remembered on its own."""
    key = ["content_hash", "file_format", "unit_number", "raster_hash"]
    first = parse_claims(extracted(pages, extractor, store, "read"), "claims")
    again = first.where((F.col("dropped") > 0) & (F.col("document_class") == "lab_report")).select(*key)
    second = extracted(pages.join(again, key, "left_semi"), extractor, store, "read-dropped-retry", extractor.version + RETRY)
    more = parse_claims(second, "claims").where(~F.col("failed") & ~F.col("invalid")).select(*key, F.col("lab_rows").alias("_more"))
    both = first.join(more, key, "left")
    rows = F.when(F.col("_more").isNull(), F.col("lab_rows")).otherwise(F.concat("lab_rows", "_more"))
    return both.withColumns({"lab_rows": rows, "failed": F.col("failed") | F.col("invalid")}).select(*key, "invalid", "document_class", "lab_rows", "event_rows", "page_dates", "dropped", "failed")


def supplemented(read: DataFrame, pages: DataFrame, hints: DataFrame, extractor: UnitExtractor, store) -> DataFrame:
    """``read_pages`` with the rows of a further reading of the pages that have
    ``hints`` (``content_hash, unit_number, hint``): rows no fact covers."""
    key = ["content_hash", "file_format", "unit_number", "raster_hash"]
    listed = hints.groupBy("content_hash", "unit_number").agg(F.array_sort(F.collect_set("hint")).alias("hints"))
    more = parse_claims(extracted(pages.join(listed, ["content_hash", "unit_number"]), extractor, store, "read-supplement"), "claims")
    more = more.where(~F.col("failed") & ~F.col("invalid")).select(*key, F.col("lab_rows").alias("_more"))
    rows = F.when(F.col("_more").isNull(), F.col("lab_rows")).otherwise(F.concat(F.coalesce("lab_rows", F.slice("_more", 1, 0)), "_more"))
    return read.join(more, key, "left").withColumn("lab_rows", rows).drop("_more")


def as_json(document_class: str = "other", **parts: object) -> str:
    """Claims as the text that extractors return."""
    return json.dumps({"document_class": document_class, **parts})
