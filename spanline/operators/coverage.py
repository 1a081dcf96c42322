"""What an answer does not cover, and how its rows are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from .facts import coverage_units, top_warnings

# How a state of terminology is worded.
TERMINOLOGY = {
    "inflected": "terminology: inflection-only match, not yet reviewed",
    "auto-mapped": "terminology: auto-mapped, unreviewed",
    "ambiguous": "terminology: ambiguous label, several possible meanings",
}
LONGEST_SNIPPET, LONGEST_WORDING, MOST_SAMPLES = 120, 80, 3
UNIT = ["content_hash", "file_format", "unit_number"]


def source_text(paths: Column, file_format: Column, unit: Column | None = None) -> Column:
    """The first path, the page, and how many identical copies there are."""
    where = F.lit("") if unit is None else F.when(unit.isNull(), "").when(file_format == "pdf", F.concat(F.lit(" page "), unit.cast("string"))).otherwise(" image")
    more = F.when(F.size(paths) > 1, F.concat(F.lit(" (+"), (F.size(paths) - 1).cast("string"), F.lit(" identical copies)"))).otherwise("")
    return F.concat(F.coalesce(F.try_element_at(paths, F.lit(1)), F.lit("unknown source")), where, more)


def terminology_reason(status: Column) -> Column:
    """Why a match of this state needs review; null for confirmed ones."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in TERMINOLOGY.items() for x in pair]), status)


def last_tables(warnings: DataFrame) -> DataFrame:
    """Of several notes of an incomplete table on a page the last one holds;
    ``warnings`` is ordered by ``seq``."""
    return warnings.groupBy(*UNIT).agg(F.max_by("evidence", "seq").alias("evidence"))


def coverage_lines(unlisted: DataFrame, problems: DataFrame, units: DataFrame, sources: DataFrame, spans: DataFrame, tables: DataFrame | None = None, priority: DataFrame | None = None) -> DataFrame:
    """All messages about what was not read whole: ``section, subject, unit_number,
    kind, priority, line``, ordered by the first four.

    ``unlisted`` are inventory rows that are not ready, ``problems`` contents with
    ``status, page_count, unit_count, warnings``, ``units`` the outcomes of pages,
    ``sources`` the paths of each content, ``tables`` pages with rows that no fact
    covers (``evidence``: their spans; given for measurements only). With
    ``priority`` (``relative_path``) lines about those paths come first and
    unlisted files are only counted. A text layer that shows no full coverage is
    told once a file."""
    paths = sources.select("content_hash", "sources")
    none = F.array().cast("array<string>")

    def line(df: DataFrame, section: int, kind: int, text: Column, unit: bool = True) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.col("subject"), (F.col("unit_number") if unit else F.lit(None)).cast("int").alias("unit_number"), F.lit(kind).alias("kind"), F.col("content_hash"), text.alias("line"))

    if priority is None:
        extra = F.when(F.size("warnings") > 0, F.concat(F.lit("; "), F.array_join("warnings", ", "))).otherwise("")
        first = line(unlisted.withColumns({"subject": F.col("relative_path"), "content_hash": F.lit(None).cast("string")}), 0, 0, F.concat(F.lit("Not processed: "), "relative_path", F.lit(" ("), "status", extra, F.lit(")")), unit=False)
    else:
        n = unlisted.agg(F.count(F.lit(1)).alias("n")).where("n > 0").withColumns({"subject": F.lit(""), "content_hash": F.lit(None).cast("string")})
        first = line(n, 0, 0, F.format_string("Not processed: %d unsupported files (see scan inventory).", "n"), unit=False)
    failed = problems.join(paths, "content_hash", "left").withColumn("sources", F.coalesce("sources", none))
    failed = failed.withColumn("subject", source_text(F.col("sources"), F.col("file_format")))
    known = F.concat(F.lit(" (pages known: "), F.coalesce(F.col("page_count").cast("string"), F.lit("unknown")), F.coalesce(F.concat(F.lit("; units recorded: "), F.col("unit_count").cast("string")), F.lit("")), F.when(F.size("warnings") > 0, F.concat(F.lit("; "), F.array_join("warnings", ", "))).otherwise(""), F.lit(")"))
    second = line(failed, 1, 0, F.concat(F.lit("File "), "status", F.lit(": "), "subject", known), unit=False)
    pages = coverage_units(units).join(paths, "content_hash", "left").withColumn("sources", F.coalesce("sources", none))
    pages = pages.withColumns({"subject": source_text(F.col("sources"), F.col("file_format")), "where": source_text(F.col("sources"), F.col("file_format"), F.col("unit_number"))})
    unverified = "TEXT_LAYER_COVERAGE_UNVERIFIED"
    files = pages.where(F.array_contains("warnings", unverified)).groupBy("content_hash", "file_format", "subject").agg(F.min("unit_number").alias("unit_number"))
    parts = [first, second, line(files, 2, 0, F.concat(F.lit("Text layer does not establish full page coverage: "), "subject"))]
    rest = F.sort_array(F.array_remove("warnings", unverified))
    parts.append(line(pages.where("status <> 'completed'"), 2, 1, F.concat(F.lit("Partially processed: "), "where", F.lit(" ("), "status", F.lit("; "), F.array_join(rest, ", "), F.lit(")"))))
    told = [("HANDWRITING_NOT_INTERPRETED", "Handwriting not interpreted: "), ("VISION_ITEMS_DROPPED", "Vision extraction dropped items: ")]
    told += [("MISSING_CONTEXT", "Missing context (date/unit/header): ")] if tables is not None else []
    parts += [line(pages.where(F.array_contains("warnings", code)), 2, k, F.concat(F.lit(text), "where")) for k, (code, text) in enumerate(told, 2)]
    if tables is not None:
        at = pages.join(tables.select(*UNIT, "evidence"), UNIT).select(*UNIT, "subject", "where", F.explode("evidence").alias("span_index"))
        texts = at.join(spans.select(*UNIT, "span_index", "text"), [*UNIT, "span_index"])
        rows = texts.groupBy(*UNIT, "subject", "where").agg(F.array_sort(F.collect_list(F.struct("span_index", F.trim("text").alias("t")))).alias("s"))
        snippet = F.substring(F.array_join(F.transform("s", lambda s: s["t"]), " | "), 1, LONGEST_SNIPPET)
        parts.append(line(rows, 2, 9, F.concat(F.lit("Possible incomplete table extraction: "), "where", F.lit("; row without a structured result near: "), snippet)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if priority is None:
        return out.withColumn("priority", F.lit(True)).drop("content_hash")
    first_ones = sources.select("content_hash", F.explode("sources").alias("relative_path")).join(priority.select("relative_path").distinct(), "relative_path", "left_semi").select("content_hash").distinct().withColumn("_p", F.lit(True))
    return out.join(first_ones, "content_hash", "left").withColumn("priority", F.coalesce("_p", F.lit(False))).drop("_p", "content_hash")


def coverage_warnings(lines: DataFrame, most: int = 30) -> DataFrame:
    """The first ``most`` messages, priority ones first, and how many more there are."""
    return top_warnings(lines, ["section", "subject", "unit_number", "kind"], most)


def summarise_findings(findings: DataFrame) -> DataFrame:
    """``finding, detail, n, before, after, samples``: findings of one kind together.

    Counts that fell are added up; of a warning of a page, ``CODE (unit n)``, the
    code alone is kept; of the subjects the first ``MOST_SAMPLES`` are named."""
    counts = F.col("finding").isin("fewer extracted facts", "fewer verified facts")
    number = lambda i: F.when(counts, F.regexp_extract("detail", r"^(\d+) -> (\d+)$", i).try_cast("long"))
    code = F.when(counts, "").otherwise(F.regexp_replace("detail", r" \((?:unit \d+|file)\)$", ""))
    rows = findings.select("finding", code.alias("code"), "subject", number(1).alias("b"), number(2).alias("a"))
    key = ["finding", "code"]
    sums = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("before"), F.sum("a").alias("after"))
    # a limit within groups is met on both sides of the shuffle
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("subject"))
    few = rows.select(*key, "subject").distinct().withColumn("nth", nth).where(F.col("nth") <= MOST_SAMPLES)
    few = few.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list("subject")), ", ").alias("samples"))
    return sums.join(few, key).select("finding", F.col("code").alias("detail"), "n", "before", "after", "samples")


def date_text(role: Column, alternatives: Column, planned: Column) -> Column:
    """A timeline as shown: its readings and its role."""
    label = F.when(planned & (role == "event"), "planned").otherwise(role)
    return F.when(F.coalesce(F.size(alternatives), F.lit(0)) <= 0, "-").otherwise(F.concat(D.format_alternatives(alternatives), F.lit(" ("), F.coalesce(label, F.lit("None")), F.lit(")")))


def other_dates(dates: Column, role: Column) -> Column:
    """Dates of other roles than the chosen one, as shown."""
    others = F.filter(dates, lambda d: ~d["role"].eqNullSafe(role) & (F.size(d["alternatives"]) > 0))
    one = lambda d: F.concat(d["role"], F.when(~d["role_supported"], " (unsupported)").otherwise(""), F.when(d["planned"], " (planned)").otherwise(""), F.lit(": "), d["raw"])
    return F.array_join(F.transform(others, one), "; ")


def unconfirmed_date(dates: Column, notes: Column, alternatives: Column) -> Column:
    """``struct<role, alternatives, raw>`` of a located date whose role is not
    confirmed, specimen first; null where there is a timeline or no such note."""
    out = F.lit(None)
    fits = lambda role: F.try_element_at(F.filter(dates, lambda d: (d["role"] == role) & ~d["role_supported"] & d["located"] & (F.size(d["alternatives"]) > 0)), F.lit(1))
    picked = F.coalesce(*[fits(role) for role in ("specimen", "report", "unspecified")])
    out = F.struct(picked["role"].alias("role"), picked["alternatives"].alias("alternatives"), picked["raw"].alias("raw"))
    return F.when((F.coalesce(F.size(alternatives), F.lit(0)) <= 0) & F.array_contains(notes, "DATE_ROLE_UNSUPPORTED") & picked.isNotNull(), out)


def _markers(*more: Column) -> Column:
    return F.array_join(F.array_compact(F.array(F.when(F.col("verification") == "unverified reading", "unverified reading"), *more)), "; ")


def lab_display(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Measurements as shown: ``fact_id, date_text, label, value, unit, reference,
    flag, specimen, markers, source``. ``rows`` may carry ``placement, status`` and
    ``alternative_label``."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    df = rows.join(sources.select("content_hash", "sources"), "content_hash", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    label = F.when((F.col("verification") == "conflicting") & has("alternative_label").isNotNull(), F.concat_ws(" / ", "raw_label", has("alternative_label"))).otherwise(F.col("raw_label"))
    inferred = (F.col("timeline_role") == "filename") | F.coalesce(F.array_contains("notes", "FILENAME_DATE_INFERRED"), F.lit(False))
    marks = _markers(F.when(has("placement") == "may fall in range", "may fall within range"), F.when(has("status") == "auto-mapped", "auto-mapped, unreviewed"), F.when(inferred, "inferred from filename"))
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))
    return df.select(
        "fact_id", date_text(F.col("timeline_role"), F.col("alternatives"), F.lit(False)).alias("date_text"), label.alias("label"), F.col("raw_value").alias("value"), dash("unit").alias("unit"),
        dash("reference_interval").alias("reference"), dash("flag").alias("flag"), dash("specimen").alias("specimen"), marks.alias("markers"), source_text(F.col("sources"), F.col("file_format"), F.col("unit_number")).alias("source"))


def event_display(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Events as shown: ``fact_id, date_text, event, specialty, wording, markers, source``."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    df = rows.join(sources.select("content_hash", "sources"), "content_hash", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    kind = F.when(F.coalesce("recommendation", F.lit(False)), "other — recommendation").otherwise(F.col("event_type"))
    kind = F.when((F.col("verification") == "conflicting") & has("alternative_event_type").isNotNull(), F.concat_ws(" / ", kind, has("alternative_event_type"))).otherwise(kind)
    marks = _markers(F.concat(F.lit("evidence: "), "strength"), F.when(has("placement") == "may fall in range", "may fall within range"), F.when(has("status") == "auto-mapped", "auto-mapped, unreviewed"))
    return df.select(
        "fact_id", date_text(F.col("timeline_role"), F.col("alternatives"), F.coalesce("planned", F.lit(False))).alias("date_text"), F.translate(kind, "_", " ").alias("event"), F.col("raw_specialty").alias("specialty"),
        F.substring("wording", 1, LONGEST_WORDING).alias("wording"), marks.alias("markers"), source_text(F.col("sources"), F.col("file_format"), F.col("unit_number")).alias("source"))
