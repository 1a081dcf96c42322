"""Claims about a page checked against the page's own rows.

Claims and rows meet in equi-joins on the page and one word of the claim, so a
page of n rows and n claims forms no n squared pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import rows as R
from ..functions import text as T
from ..session import written
from .layout import PAGE, cluster_rows

VERIFIED, UNVERIFIED, CONFLICTING = "verified", "unverified reading", "conflicting"
LAB_ROLES, EVENT_ROLES = ("specimen", "report", "unspecified"), ("event",)
#: Rows this many heights apart still belong together.
NEAR = 3
#: Every text that reads as a date has a year of four digits, or three numbers in a row.
MAYBE_DATE = r"\d{4}|\d[./-]\d{1,2}[./-]\d{2}"


def page_rows(spans: DataFrame) -> DataFrame:
    """Rows of all pages in comparable form with ``is_result``, and the row above
    each (``above``: its text, parts and whether it is a result); written once."""
    rows = cluster_rows(spans, normalised=True).withColumn("is_result", R.is_result_row(F.col("text")))
    above = F.lag(F.when(F.col("y").isNotNull(), F.struct("text", "parts", "is_result"))).over(Window.partitionBy(*PAGE).orderBy("row"))
    return written(rows.withColumn("above", F.when(F.col("y").isNotNull(), above)), "page-rows")


def holding(claims: DataFrame, needle: str, rows: DataFrame) -> DataFrame:
    """Claims with every row of their page that holds the needle as a token."""
    words = F.array_union(F.array_distinct(R.word_runs(F.col("text"))), F.array(F.lit("\0")))
    places = rows.select(*PAGE, "row", F.explode(words).alias("_h"))
    pairs = claims.where(F.length(needle) > 0).withColumn("_h", R.handle(F.col(needle))).join(places, [*PAGE, "_h"]).drop("_h")
    return pairs.join(rows, [*PAGE, "row"]).where(R.has_token(F.col("text"), F.col(needle)))


def _refs(row: str, needle: str) -> Column:
    return R.spans_with(F.col(f"{row}.parts"), F.col(f"{row}.members"), F.col(needle))


def ground_labs(labs: DataFrame, rows: DataFrame) -> DataFrame:
    """``fact_id, grounding, notes, evidence, alternative_label, alternative_evidence``
    of lab claims against the ``page_rows`` of their pages.

    Verified: the first row with label and value is a result row (or a short
    one) with the value as its first result, and the unit stands there or, where
    the row has none, in the nearest row above that is no result; a specimen may
    stand in any such row, and is only noted when it stands in none. Where label
    and value stand apart, the value's row nearest to the label's decides: with
    another label left of the value the readings conflict.

    Equal claims of a page are judged once. Null or empty labels and values are
    not located; pages without rows neither."""
    parts = {"label": "raw_label", "value": "raw_value", "unit": "unit", "specimen": "specimen"}
    claims = labs.select("fact_id", *PAGE, *[F.coalesce(T.clean(F.col(c)) if c in labs.columns else F.lit(None), F.lit("")).alias(n) for n, c in parts.items()])
    claims = claims.withColumn("k", F.xxhash64(*PAGE, *parts))
    claims = written(claims, "ground-claims")
    once = claims.drop("fact_id").distinct()
    row = F.struct("row", "y", "text", "parts", "members", "is_result")
    has_value = R.has_token(F.col("text"), F.col("value"))
    at = R.result_at(F.col("text"), F.col("label"), F.col("value"))
    of_label = holding(once, "label", rows).withColumns({"has_value": has_value, "at": at})
    by_label = of_label.groupBy("k").agg(
        F.min_by(row, "row").alias("anchor"), F.min_by(F.struct(row.alias("r"), "at"), F.when(F.col("has_value") | F.col("at"), F.col("row"))).alias("shared"))
    found = once.join(by_label, "k", "left")
    found = written(found.withColumn("shared_row", F.col("shared.r")), "ground-rows")
    # label and value stand apart: the nearest row with the value
    apart = found.where(F.col("anchor").isNotNull() & F.col("shared").isNull()).select("k", *PAGE, "value", F.col("anchor.y").alias("anchor_y"))
    away = F.coalesce(F.abs(F.col("y") - F.col("anchor_y")), F.lit(1e9))
    nearest = holding(apart, "value", rows).groupBy("k").agg(F.min_by(row, F.struct(away, "row")).alias("nearest"))
    # units and specimens that may stand in a row above
    here = lambda c: R.has_token(F.col("shared_row.text"), F.col(c)) | F.coalesce(F.exists(_aliases(c), lambda a: R.has_token(F.col("shared_row.text"), a)), F.lit(False))
    wanted = F.array_compact(F.array(
        F.when((F.col("unit") != "") & ~here("unit") & ~R.unit_like(F.col("shared_row.text")), F.struct(F.lit("unit").alias("field"), F.col("unit").alias("needle"))),
        F.when((F.col("specimen") != "") & ~here("specimen"), F.struct(F.lit("specimen").alias("field"), F.col("specimen").alias("needle")))))
    missing = found.where(F.col("shared.at")).select("k", *PAGE, F.col("shared_row.y").alias("shared_y"), F.explode(wanted).alias("w")).select("k", *PAGE, "shared_y", "w.field", "w.needle")
    missing = missing.withColumn("spelt", F.explode(F.array_distinct(F.concat(F.array("needle"), F.coalesce(_aliases("needle"), F.array().cast("array<string>"))))))
    headers = holding(missing, "spelt", rows).where((F.col("y") < F.col("shared_y")) & ~F.col("is_result"))
    refs = R.spans_with(F.col("parts"), F.col("members"), F.col("needle"))
    headers = headers.groupBy("k").agg(*[F.max_by(F.when(F.col("field") == f, refs), F.when(F.col("field") == f, F.col("y"))).alias(f"{f}_above") for f in ("unit", "specimen")])
    found = found.join(nearest, "k", "left").join(headers, "k", "left")

    none = F.array().cast("array<int>")
    loose = ~F.col("shared_row.is_result") & (F.size(F.split("shared_row.text", " ")) > 4)
    unit_spans, specimen_spans = (F.when(F.col(c) == "", none).when(here(c), _refs("shared_row", c)).otherwise(F.col(f"{c}_above")) for c in ("unit", "specimen"))
    left = F.filter(F.col("nearest.parts"), lambda p: ~R.has_token(p["t"], F.col("value")))
    first = F.array_position(F.transform(F.col("nearest.parts"), lambda p: R.has_token(p["t"], F.col("value"))), True)
    before = F.when(first > 0, F.slice(F.col("nearest.parts"), F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int"))).otherwise(left)
    other = F.regexp_replace(F.array_join(F.transform(before, lambda p: p["t"]), " "), r"^[ :;,.|]+|[ :;,.|]+$", "")
    disagrees = F.col("nearest.is_result") & other.rlike(r"\p{L}") & (other != F.col("label"))
    located = F.when(F.col("shared").isNull(), "apart").when(loose, "loose").when(~F.col("shared.at"), "elsewhere").otherwise("there")
    state = found.withColumns({"_s": located, "_u": unit_spans, "_p": specimen_spans, "_other": F.when((located == "apart") & F.coalesce(disagrees, F.lit(False)), other)})
    there = F.col("_s") == "there"
    nothing = (F.col("label") == "") | (F.col("value") == "") | (F.col("anchor").isNull() & F.col("nearest").isNull())
    notes = F.array_compact(F.array(
        F.when((F.col("label") == "") | (F.col("value") == "") | F.col("no_rows"), "NOT_LOCATED").when(F.col("_other").isNotNull(), "ANALYTE_ASSIGNMENT_DISAGREES")
        .when(F.col("_s").isin("apart", "loose"), "ASSOCIATION_NOT_LOCATED").when(F.col("_s") == "elsewhere", "VALUE_NOT_AT_RESULT"),
        F.when(there & F.col("_u").isNull(), "UNIT_NOT_LOCATED"), F.when(there & F.col("_p").isNull(), "SPECIMEN_NOT_LOCATED")))
    pages = rows.select(*PAGE).distinct().withColumn("_page", F.lit(True))
    state = state.join(pages, PAGE, "left").withColumn("no_rows", F.col("_page").isNull())
    whole = F.array_union(F.array_union(_refs("shared_row", "label"), _refs("shared_row", "value")), F.array_union(F.coalesce("_u", none), F.coalesce("_p", none)))
    evidence = F.when(there, whole).when(F.col("_s").isin("loose", "elsewhere"), _refs("shared_row", "label")).when(F.col("nearest").isNotNull() & ~nothing & (F.col("_other").isNotNull() | ~F.col("nearest.is_result")), _refs("anchor", "label")).otherwise(none)
    beside = F.when(F.col("_other").isNotNull(), F.array_union(F.transform(before, lambda p: p["i"]), _refs("nearest", "value"))).otherwise(none)
    verdict = F.when(there & F.col("_u").isNotNull(), VERIFIED).when(F.col("_other").isNotNull(), CONFLICTING).otherwise(UNVERIFIED)
    judged = state.select("k", verdict.alias("grounding"), notes.alias("notes"), F.sort_array(evidence).alias("evidence"), F.col("_other").alias("alternative_label"), F.sort_array(beside).alias("alternative_evidence"))
    return claims.select("fact_id", "k").join(judged, "k").drop("k")


def _aliases(column: str) -> Column:
    out = F.lit(None).cast("array<string>")
    for unit, others in R.UNIT_ALIASES.items():
        out = F.when(F.col(column) == unit, F.array(*[F.lit(o) for o in others])).otherwise(out)
    return out


def locate(claims: DataFrame, key: str, raw: str, rows: DataFrame) -> DataFrame:
    """``claims`` with ``needle, place`` (the row) and ``evidence``: the first row
    of the page that holds the text; else, for a text that reads as a date, the
    one row or span of the page that reads as the same period."""
    claims = written(claims.withColumn("needle", F.coalesce(T.clean(F.col(raw)), F.lit(""))), "locate-claims")
    row = F.struct("row", "y", "height", "text", "parts", "members", "is_result", "above")
    direct = holding(claims.select(key, *PAGE, "needle"), "needle", rows).groupBy(key).agg(F.min_by(row, "row").alias("place"))
    direct = written(claims.join(direct, key, "left"), "locate-direct")
    exact = direct.where(F.col("place").isNotNull()).withColumn("evidence", F.sort_array(_refs("place", "needle")))
    open_ = direct.where(F.col("place").isNull()).drop("place")
    # read only rows that may hold a date, of pages where a claim is left
    read = open_.where(F.col("needle").rlike(r"\d")).select(key, *PAGE, F.explode(D.parse_normalised(F.col("needle"))).alias("p")).select(key, *PAGE, "p.*")
    texts = rows.where(F.col("text").rlike(MAYBE_DATE)).join(read.select(*PAGE).distinct(), PAGE, "left_semi")
    candidates = F.concat(F.array(F.struct(F.col("text").alias("t"), F.col("members").alias("m"))), F.transform(F.filter("parts", lambda p: p["t"].rlike(MAYBE_DATE)), lambda p: F.struct(p["t"].alias("t"), F.array(p["i"]).alias("m"))))
    texts = texts.withColumn("c", F.explode(candidates)).select(*PAGE, row.alias("place"), F.sort_array("c.m").alias("evidence"), F.explode(D.parse_normalised(F.col("c.t"))).alias("p")).select(*PAGE, "place", "evidence", "p.*")
    hits = read.join(texts, [*PAGE, "start_date", "end_date", "date_precision"]).groupBy(key, "evidence").agg(F.min_by("place", F.col("place.row")).alias("place"))
    one = hits.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first("place").alias("place"), F.first("evidence").alias("evidence")).where("n = 1").drop("n")
    return exact.unionByName(open_.join(one, key, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<int>"))).select(*exact.columns))


def reported_dates(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """Dates claimed of pages: ``date_id, content_hash, unit_number, raw, role,
    planned, alternatives, evidence, located, role_supported, y, height``.

    A role of a specimen or report is supported when the nearest cue left of the
    date says so; else, under a caption row of several columns, when the nearest
    cue across does; else when the nearest cue in the caption above does. A
    caption lends nothing to a row with words of its own, and nothing when it is
    a result, speaks of a birth or states another date. An event's date must have
    no such cue. Dates that are located but cannot be read are dropped; those of
    a role that is not known are never supported."""
    slim = claims.select("date_id", *PAGE, "raw", F.col("date_role").alias("role"), "planned")
    at = locate(slim, "date_id", "raw", rows).withColumn("alternatives", D.parse_date(F.col("raw")))
    at = at.where(F.col("place").isNull() | (F.size("alternatives") > 0))
    text, date, above = F.col("place.text"), F.col("needle"), F.col("place.above")
    on_row = R.role_before(text, date)
    other = F.coalesce(R.states_other_date(above["text"], date), F.lit(False))
    lends = above.isNotNull() & ~F.coalesce(above["is_result"], F.lit(False)) & ~other
    middle = F.filter(F.col("place.parts"), lambda p: F.array_contains(F.col("evidence"), p["i"]) & p["x"].isNotNull())
    x = F.aggregate(middle, F.lit(0.0), lambda a, p: a + p["x"]) / F.nullif(F.size(middle), F.lit(0))

    def across(role: str, rank: int) -> Column:
        cue = "|".join(R.ROLE_CUES[role])
        away = lambda p, i: F.struct(F.abs(p["x"] - x).alias("away"), F.lit(rank).alias("rank"), i.alias("i"), F.lit(role).alias("role"))
        return F.transform(above["parts"], lambda p, i: F.when(p["x"].isNotNull() & p["t"].rlike(cue), away(p, i)))

    told = F.array_compact(F.flatten(F.array(*[across(role, rank) for rank, role in enumerate(R.ROLE_CUES)])))
    aligned = F.when(lends & x.isNotNull() & ~text.rlike(R.PRINTED), F.array_min(told)["role"])
    alone = R.has_other_words(text, date) | text.rlike(R.BIRTH)
    borrowed = F.when(alone | ~lends | above["text"].rlike(R.BIRTH), text).otherwise(F.concat_ws(" ", above["text"], text))
    nearest = R.role_before(borrowed, date)
    role = F.col("role")
    supported = (
        F.when(F.col("place").isNull() | text.rlike(R.BIRTH), False)
        .when(role.isin(*R.ROLE_CUES), F.coalesce(on_row, aligned, nearest).eqNullSafe(role))
        .when(role == "event", nearest.isNull()).otherwise(role == "unspecified")
    )
    return at.select("date_id", *PAGE, "raw", "role", F.coalesce("planned", F.lit(False)).alias("planned"), "alternatives", "evidence", F.col("place").isNotNull().alias("located"), F.coalesce(supported, F.lit(False)).alias("role_supported"), F.col("place.row").alias("row"), F.col("place.y").alias("y"), F.col("place.height").alias("height"))


def _of_page(dates: DataFrame) -> DataFrame:
    """All dates of each page in one array; a page states a handful."""
    fields = ("date_id", "raw", "role", "planned", "alternatives", "evidence", "located", "role_supported", "row", "y", "height")
    return dates.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("dates"))


def _usable(dates: Column) -> Column:
    return F.filter(dates, lambda d: d["located"] & d["role_supported"] & (F.size(d["alternatives"]) > 0))


def timeline(dates: Column, preference: tuple[str, ...]) -> Column:
    """``struct<role, alternatives>``: all readings of the first role that has
    supported dates; without a preferred role a single supported date of any."""
    out = D.build_timeline(F.transform(dates, lambda d: d.withField("supported", d["located"] & d["role_supported"])), list(preference))
    rest = _usable(dates)
    only = F.struct(rest[0]["role"].alias("role"), rest[0]["alternatives"].cast(D.PERIOD).alias("alternatives"))
    return F.when((F.size(out["alternatives"]) == 0) & (F.size(rest) == 1), only).otherwise(out) if preference == LAB_ROLES else out


def interpret_labs(labs: DataFrame, dates: DataFrame, rows: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Lab facts as their pages bear them out: ``fact_id, verification, timeline,
    reference_interval, flag, specimen, evidence, alternative_label,
    alternative_evidence, notes``.

    ``dates`` are ``reported_dates``; ``paths`` holds ``content_hash,
    relative_path``. A date that is not located or not of its role, and a
    reference or flag that is not in the result's row, make a verified reading
    unverified and are noted; such references and flags, and specimens the page
    never states, are dropped. A fact without a date takes the one its paths
    agree on; where a page's date reads two ways the paths' day picks one of its
    readings, which changes the dates but never the timeline."""
    ground = ground_labs(labs, rows)
    extra = [c for c in ("reference_interval", "flag", "specimen") if c in labs.columns]
    facts = labs.select("fact_id", *PAGE, F.coalesce(T.clean(F.col("raw_label")), F.lit("")).alias("label"), F.coalesce(T.clean(F.col("raw_value")), F.lit("")).alias("value"), *extra).distinct()
    facts = facts.join(ground.distinct(), "fact_id").join(_of_page(dates), PAGE, "left")
    both = holding(facts.select("fact_id", *PAGE, "label", "value"), "label", rows).where(R.has_token(F.col("text"), F.col("value")))
    facts = facts.join(both.groupBy("fact_id").agg(F.min_by("text", "row").alias("row_text")), "fact_id", "left")
    stated = F.coalesce("dates", F.array().cast(facts.schema["dates"].dataType))
    tight = lambda c: F.regexp_replace(c, r"\s+", "")
    needle = {c: F.coalesce(T.clean(F.col(c)), F.lit("")) for c in ("reference_interval", "flag")}
    facts = facts.withColumns({f"_{c}": n for c, n in needle.items()}).withColumn("dates", stated)
    in_row = {
        "reference_interval": R.has_token(F.col("row_text"), F.col("_reference_interval")) | F.coalesce((F.col("_reference_interval") != "") & F.contains(tight(F.col("row_text")), tight(F.col("_reference_interval"))), F.lit(False)),
        "flag": R.has_token(F.col("row_text"), F.col("_flag")),
    }
    lost = {c: (F.coalesce(F.col(c), F.lit("")) != "") & ~hit for c, hit in in_row.items()}
    unplaced = F.exists("dates", lambda d: ~d["located"])
    unsupported = F.exists("dates", lambda d: d["located"] & ~d["role_supported"])
    demoted = unplaced | unsupported | lost["reference_interval"] | lost["flag"]
    chosen = timeline(F.col("dates"), LAB_ROLES)
    if paths is not None:
        agreed = D.consensus(paths.where(F.col("content_hash").isNotNull()), "content_hash", "relative_path").withColumnRenamed("alternatives", "agreed")
        facts = facts.join(agreed, "content_hash", "left")
    else:
        facts = facts.withColumn("agreed", D.none())
    named = F.coalesce(F.size("agreed"), F.lit(0)) == 1
    inferred = named & (F.size(chosen["alternatives"]) == 0)
    day = F.when(named & (F.col("agreed")[0]["date_precision"] == "day"), F.col("agreed")[0]["start_date"])
    fits = lambda d: (F.size(d["alternatives"]) > 1) & (F.size(F.filter(d["alternatives"], lambda a: (a["start_date"] == day) & (a["date_precision"] == "day"))) == 1)
    aligned = F.coalesce(F.exists("dates", fits), F.lit(False))
    notes = F.array_distinct(F.array_compact(F.concat("notes", F.array(
        F.when(unplaced, "DATE_NOT_LOCATED"), F.when(unsupported, "DATE_ROLE_UNSUPPORTED"), F.when(lost["reference_interval"], "REFERENCE_NOT_LOCATED"),
        F.when(lost["flag"], "FLAG_NOT_LOCATED"), F.when(inferred, "FILENAME_DATE_INFERRED"), F.when(aligned, "FILENAME_DATE_ALIGNED")))))
    by_name = F.struct(F.lit("filename").alias("role"), F.col("agreed").cast(D.PERIOD).alias("alternatives"))
    of_dates = F.flatten(F.transform(F.filter("dates", lambda d: d["located"]), lambda d: d["evidence"]))
    return facts.select(
        "fact_id", F.when((F.col("grounding") == VERIFIED) & demoted, UNVERIFIED).otherwise(F.col("grounding")).alias("verification"), F.when(inferred, by_name).otherwise(chosen).alias("timeline"),
        *[F.when(~lost[c], F.col(c)).alias(c) for c in lost], F.when(~F.array_contains("notes", "SPECIMEN_NOT_LOCATED"), F.col("specimen")).alias("specimen"),
        F.sort_array(F.array_union("evidence", of_dates)).alias("evidence"), "alternative_label", "alternative_evidence", notes.alias("notes"))


def interpret_events(events: DataFrame, dates: DataFrame, rows: DataFrame) -> DataFrame:
    """Events as their pages bear them out: ``fact_id, verification, timeline,
    strength, evidence, alternative_event_type, notes``.

    Only events whose wording implies a type are facts. Specialty and wording
    must stand in one row or in rows within ``NEAR`` heights; then the source
    rows' own text, not the claim, tells the types, and an event whose rows imply
    none is no fact. A type beside those implied conflicts. Only located dates of
    the event's role near its wording date it."""
    claims = events.select(
        "fact_id", *PAGE, F.coalesce(T.clean(F.col("raw_specialty")), F.lit("")).alias("specialty"), F.coalesce(T.clean(F.col("wording")), F.lit("")).alias("wording_n"), "event_type", "document_class",
        R.wording_types(F.col("wording")).alias("implied")).where(F.size("implied") > 0).distinct()
    claims = written(claims, "event-claims")
    slim = claims.select("fact_id", *PAGE, "specialty", "wording_n")
    row = F.struct("row", "y", "height", "text", "parts", "members")
    s = holding(slim, "specialty", rows).select("fact_id", "specialty", "wording_n", row.alias("s"))
    w = written(holding(slim, "wording_n", rows).select("fact_id", row.alias("w")), "event-wordings")
    close = (F.col("s.row") == F.col("w.row")) | F.coalesce(F.abs(F.col("s.y") - F.col("w.y")) <= NEAR * F.greatest("s.height", "w.height"), F.lit(False))
    near = s.join(w, "fact_id").where(close).groupBy("fact_id", "specialty", "wording_n").agg(F.min_by(F.struct("s", "w"), F.struct("s.row", "w.row")).alias("n"))
    source = F.when(F.col("n.s.row") == F.col("n.w.row"), F.col("n.s.text")).otherwise(F.concat_ws(" ", "n.s.text", "n.w.text"))
    refs = F.array_union(_refs("n.s", "specialty"), _refs("n.w", "wording_n"))
    near = near.select("fact_id", source.alias("source"), refs.alias("refs")).withColumn("told", R.wording_types(F.col("source")))
    facts = claims.join(near, "fact_id", "left").where(F.col("told").isNull() | (F.size("told") > 0))
    beside = w.groupBy("fact_id").agg(F.collect_list(F.struct("w.row", "w.y", "w.height")).alias("wording_rows"))
    facts = facts.join(_of_page(dates), PAGE, "left").join(beside, "fact_id", "left")
    spoken = lambda d: F.coalesce(F.exists("wording_rows", lambda r: (r["row"] == d["row"]) | F.coalesce(F.abs(r["y"] - d["y"]) <= NEAR * F.greatest(r["height"], d["height"]), F.lit(False))), F.lit(False))
    stated = F.coalesce("dates", F.array().cast(facts.schema["dates"].dataType))
    stated = F.transform(stated, lambda d: d.withField("role_supported", d["role_supported"] & ((d["role"] != "event") | spoken(d))))
    facts = facts.withColumn("dates", stated)
    unplaced, unsupported = F.exists("dates", lambda d: ~d["located"]), F.exists("dates", lambda d: d["located"] & ~d["role_supported"])
    grounded = F.col("told").isNotNull()
    verified = grounded & ~unplaced & ~unsupported
    types = F.coalesce("told", "implied")
    conflict = verified & ~F.array_contains(types, F.col("event_type"))
    notes = F.array_compact(F.array(F.when(~grounded, "EVENT_NOT_GROUNDED"), F.when(unplaced, "DATE_NOT_LOCATED"), F.when(unsupported, "DATE_ROLE_UNSUPPORTED"), F.when(conflict, "EVENT_TYPE_DISAGREES")))
    strength = R.evidence_strength(F.lit(False), verified & ~conflict, F.col("implied"), F.col("event_type"), F.col("document_class"))
    of_dates = F.flatten(F.transform(F.filter("dates", lambda d: d["located"]), lambda d: d["evidence"]))
    return facts.select(
        "fact_id", F.when(conflict, CONFLICTING).when(verified, VERIFIED).otherwise(UNVERIFIED).alias("verification"), timeline(F.col("dates"), EVENT_ROLES).alias("timeline"), strength.alias("strength"),
        F.sort_array(F.array_union(F.coalesce("refs", F.array().cast("array<int>")), of_dates)).alias("evidence"), F.when(conflict, F.array_min(types)).alias("alternative_event_type"), notes.alias("notes"))


def uncovered_rows(rows: DataFrame, covered: DataFrame) -> DataFrame:
    """Result rows of which no span is evidence of a fact; ``covered`` holds
    ``content_hash, unit_number, evidence`` of facts."""
    seen = covered.select(*PAGE, F.explode("evidence").alias("_i")).distinct()
    results = rows.where("is_result")
    met = results.select(*PAGE, "row", F.explode("members").alias("_i")).join(seen, [*PAGE, "_i"], "left_semi").select(*PAGE, "row").distinct()
    return results.join(met, [*PAGE, "row"], "left_anti")


def row_hints(rows: DataFrame, covered: DataFrame) -> DataFrame:
    """``content_hash, unit_number, hint``: rows a second reading should look at:
    uncovered result rows, and uncovered rows of panels with a number."""
    seen = covered.select(*PAGE, F.explode("evidence").alias("_i")).distinct()
    panels = rows.where(F.col("text").rlike(R.PANEL) & F.col("text").rlike(r"\d"))
    met = panels.select(*PAGE, "row", F.explode("members").alias("_i")).join(seen, [*PAGE, "_i"], "left_semi").select(*PAGE, "row").distinct()
    more = panels.join(met, [*PAGE, "row"], "left_anti")
    return uncovered_rows(rows, covered).select(*PAGE, F.col("text").alias("hint")).union(more.select(*PAGE, "text")).distinct()
