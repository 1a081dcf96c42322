"""One query per operator on the driver tables, each with its SQL twin."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import rows as R
from ..functions import text as T
from ..functions import values as V
from ..operators import coverage, grounding, guard, history, inventory, layout, terms
from ..operators import facts as X
from ..session import load

QUERIES: dict = {}
SQL: dict[str, str] = {}
WINDOW = D.DateRange(date(2016, 3, 1), date(2021, 6, 30))
BEFORE, AFTER = "gen-0001", "gen-0002"


def query(sql: str | None = None):
    """Registers a query under its name, with its twin if SQL can express it."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _generation(spark: SparkSession, sf: str, g: str) -> DataFrame:
    return load(spark, sf, "inventory").where(F.col("generation_id") == g)


@query("""
SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids
FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def content_dedup(spark, sf):
    """Texts that occur more than once, with all their ids (G1)."""
    d = load(spark, sf, "documents").where(F.col("text").isNotNull()).select(F.sha2("text", 256).alias("content_hash"), "doc_id")
    g = inventory.same_content(d, "doc_id")
    return g.where("copies > 1").select("content_hash", "copies", F.col("members")[0].alias("first_id"), F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("ids"))


@query("""
SELECT generation_id, content_hash, file_format, min(relative_path) AS first_path, count(*) - 1 AS copies FROM inventory
WHERE status = 'ready' AND content_hash IS NOT NULL AND file_format IS NOT NULL GROUP BY 1, 2, 3""")
def work_list(spark, sf):
    """Contents to read once, by their first path."""
    return inventory.work_list(load(spark, sf, "inventory"))


@query("""
SELECT generation_id, count(*) FILTER (file_format IS NOT NULL) AS supported, count(*) FILTER (file_format IS NULL AND kind = 'file') AS unsupported,
 count(*) FILTER (status = 'ready' AND content_hash IS NOT NULL) AS ready, count(DISTINCT content_hash) AS contents FROM inventory GROUP BY 1""")
def inventory_summary(spark, sf):
    """Counts of an inventory."""
    return inventory.summary(load(spark, sf, "inventory"))


@query("""
SELECT generation_id, relative_path, CASE WHEN lower(relative_path) LIKE '%.pdf' THEN 'pdf' WHEN lower(relative_path) LIKE '%.jpg' OR lower(relative_path) LIKE '%.jpeg' THEN 'jpeg' END AS by_suffix,
 file_format FROM inventory""")
def source_formats(spark, sf):
    """Formats by suffix beside the recorded ones."""
    return load(spark, sf, "inventory").select("generation_id", "relative_path", inventory.source_format(F.col("relative_path")).alias("by_suffix"), "file_format")


DIFF = """
WITH a AS (SELECT * FROM inventory WHERE generation_id = 'gen-0001'), b AS (SELECT * FROM inventory WHERE generation_id = 'gen-0002'),
j AS (SELECT a.relative_path AS pa, b.relative_path AS pb, a.content_hash AS ha, b.content_hash AS hb,
 (a.kind IS DISTINCT FROM b.kind OR a.file_format IS DISTINCT FROM b.file_format OR a.status IS DISTINCT FROM b.status OR a.content_hash IS DISTINCT FROM b.content_hash) AS other
 FROM a FULL JOIN b ON a.relative_path = b.relative_path),
d AS (SELECT 'added' AS diff_kind, pb AS relative_path FROM j WHERE pa IS NULL UNION ALL SELECT 'removed', pa FROM j WHERE pb IS NULL
 UNION ALL SELECT 'changed', pa FROM j WHERE pa IS NOT NULL AND pb IS NOT NULL AND other
 UNION ALL SELECT 'unverifiable', pa FROM j WHERE pa IS NOT NULL AND pb IS NOT NULL AND (ha IS NULL OR hb IS NULL))"""


@query(DIFF + " SELECT diff_kind, relative_path FROM d")
def inventory_diff(spark, sf):
    """What changed between two generations."""
    return inventory.difference(_generation(spark, sf, BEFORE), _generation(spark, sf, AFTER))


@query(DIFF + """, c AS (SELECT count(*) FILTER (diff_kind = 'added') AS added, count(*) FILTER (diff_kind = 'removed') AS removed,
 count(*) FILTER (diff_kind = 'changed') AS changed, count(*) FILTER (diff_kind = 'unverifiable') AS unverifiable FROM d)
SELECT *, added + removed + changed + unverifiable = 0 AS consistent,
 CASE WHEN added + removed + changed > 0 THEN 'SOURCE_CHANGED' WHEN unverifiable > 0 THEN 'SOURCE_UNVERIFIABLE' END AS reason FROM c""")
def inventory_consistency(spark, sf):
    """Whether a generation may stand, and why not."""
    return inventory.consistency(inventory_diff(spark, sf))


OUTCOMES = """
WITH r AS (SELECT *, CASE WHEN status IN ('ready', 'completed') THEN 0 WHEN status = 'partial' THEN 1 WHEN status IN ('unsupported', 'skipped') THEN 2 ELSE 3 END AS rank
 FROM inventory WHERE content_hash IS NOT NULL AND file_format IS NOT NULL),
o AS (SELECT generation_id, content_hash, file_format, max_by(status, struct_pack(rank := rank, status := status)) AS status, max(rank) AS rank,
 list_sort(list_distinct(flatten(list(warnings)))) AS warnings FROM r GROUP BY 1, 2, 3)"""


@query(OUTCOMES + " SELECT generation_id, content_hash, file_format, status, array_to_string(warnings, ',') AS warnings FROM o")
def content_outcomes(spark, sf):
    """The outcome of every content in every generation."""
    return inventory.outcomes(load(spark, sf, "inventory")).withColumn("warnings", F.array_join("warnings", ","))


@query(OUTCOMES + " SELECT generation_id, bool_or(rank <= 1) AS usable FROM o GROUP BY 1")
def guard_usable(spark, sf):
    """Whether a generation has anything to publish."""
    return guard.has_usable_evidence(inventory.outcomes(load(spark, sf, "inventory")))


@query(OUTCOMES + """,
ev AS (SELECT content_hash, file_format, verification, loaded_at FROM lab_facts UNION ALL SELECT content_hash, file_format, verification, loaded_at FROM event_facts),
f AS (SELECT o.generation_id, o.content_hash, o.file_format, any_value(o.status) AS status, any_value(o.rank) AS rank, any_value(o.warnings) AS warnings,
 count(ev.content_hash) FILTER (o.generation_id = 'gen-0001' OR ev.verification <> 'conflicting') AS facts,
 count(ev.content_hash) FILTER (ev.verification = 'verified') AS verified
 FROM o LEFT JOIN ev ON o.content_hash = ev.content_hash AND o.file_format = ev.file_format GROUP BY 1, 2, 3),
a AS (SELECT * FROM f WHERE generation_id = 'gen-0001'), b AS (SELECT * FROM f WHERE generation_id = 'gen-0002'),
j AS (SELECT b.*, a.status AS a_status, a.rank AS a_rank, a.warnings AS a_warnings, a.facts AS a_facts, a.verified AS a_verified FROM b JOIN a USING (content_hash, file_format))
SELECT CASE WHEN rank >= 3 THEN 'new processing failure' ELSE 'worse processing status' END AS finding, content_hash || ':' || file_format AS subject, a_status || ' -> ' || status AS detail FROM j WHERE rank > a_rank
UNION ALL SELECT 'new coverage warning', content_hash || ':' || file_format, w FROM (SELECT *, unnest(list_filter(warnings, lambda x: NOT list_contains(a_warnings, x))) AS w FROM j)
UNION ALL SELECT 'fewer extracted facts', content_hash || ':' || file_format, a_facts || ' -> ' || facts FROM j WHERE facts < a_facts
UNION ALL SELECT 'fewer verified facts', content_hash || ':' || file_format, a_verified || ' -> ' || verified FROM j WHERE verified < a_verified
UNION ALL SELECT 'new content not fully processed', content_hash || ':' || file_format, status FROM b WHERE rank > 0 AND NOT EXISTS (SELECT 1 FROM a WHERE a.content_hash = b.content_hash AND a.file_format = b.file_format)
UNION ALL SELECT 'new unsupported or failed file', x.relative_path, x.status FROM inventory x LEFT JOIN (SELECT relative_path, status AS s FROM inventory WHERE generation_id = 'gen-0001') y USING (relative_path)
 WHERE x.generation_id = 'gen-0002' AND x.status <> 'ready' AND (s IS NULL OR s = 'ready')""")
def guard_findings(spark, sf):
    """What would get worse if the second generation replaced the first (J2, D16);
    the candidate's conflicting facts are taken as lost."""
    ev = [load(spark, sf, t).select("content_hash", "file_format", "verification") for t in ("lab_facts", "event_facts")]
    ev = ev[0].unionByName(ev[1]).groupBy("content_hash", "file_format").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verification") == "conflicting").alias("c"), F.count_if(F.col("verification") == "verified").alias("v"))
    o = inventory.outcomes(load(spark, sf, "inventory")).join(ev, ["content_hash", "file_format"], "left").fillna(0, ["n", "c", "v"])
    o = o.withColumns({"facts": F.when(F.col("generation_id") == BEFORE, F.col("n")).otherwise(F.col("n") - F.col("c")), "verified": F.col("v")})
    return guard.evaluate_replacement(o.where(F.col("generation_id") == BEFORE), o.where(F.col("generation_id") == AFTER), _generation(spark, sf, BEFORE), _generation(spark, sf, AFTER))


@query("""
SELECT a.relative_path, array_to_string(list_sort(list_filter(b.warnings, lambda x: NOT list_contains(a.warnings, x))), ',') AS appeared,
 array_to_string(list_sort(list_filter(a.warnings, lambda x: NOT list_contains(b.warnings, x))), ',') AS gone, list_has_any(a.warnings, b.warnings) AS shared,
 len(list_filter(b.warnings, lambda x: NOT list_contains(a.warnings, x))) = 0 AS no_worse
FROM inventory a JOIN inventory b ON a.relative_path = b.relative_path AND a.generation_id = 'gen-0001' AND b.generation_id = 'gen-0002'""")
def warning_sets(spark, sf):
    """Warnings that appeared, went and stayed per path."""
    a = _generation(spark, sf, BEFORE).select("relative_path", F.col("warnings").alias("a"))
    b = _generation(spark, sf, AFTER).select("relative_path", F.col("warnings").alias("b"))
    new, gone = F.array_except("b", "a"), F.array_except("a", "b")
    return a.join(b, "relative_path").select("relative_path", F.array_join(F.sort_array(new), ",").alias("appeared"), F.array_join(F.sort_array(gone), ",").alias("gone"), F.arrays_overlap("a", "b").alias("shared"), (F.size(new) == 0).alias("no_worse"))


@query("""
SELECT content_hash, file_format, count(*) AS facts, count(*) FILTER (verification = 'verified') AS verified
FROM (SELECT content_hash, file_format, verification FROM lab_facts UNION ALL SELECT content_hash, file_format, verification FROM event_facts) GROUP BY 1, 2""")
def fact_counts(spark, sf):
    """Facts and verified facts per content."""
    return X.fact_counts(load(spark, sf, "lab_facts"), load(spark, sf, "event_facts"))


@query("""
SELECT generation_id, content_hash, array_to_string(list_sort(list_distinct(list(relative_path))), '|') AS sources FROM inventory WHERE content_hash IS NOT NULL GROUP BY 1, 2""")
def sources_by_content(spark, sf):
    """All paths of every content."""
    return inventory.sources_by_content(load(spark, sf, "inventory")).withColumn("sources", F.array_join("sources", "|"))


@query("""
SELECT f.fact_id, coalesce(s.sources, '') AS sources FROM event_facts f LEFT JOIN
(SELECT content_hash, array_to_string(list_sort(list_distinct(list(relative_path))), '|') AS sources FROM inventory WHERE generation_id = 'gen-0002' AND content_hash IS NOT NULL GROUP BY 1) s USING (content_hash)""")
def facts_with_sources(spark, sf):
    """Facts with the paths they come from; none is empty."""
    rows = X.with_sources(load(spark, sf, "event_facts").select("fact_id", "content_hash"), inventory.sources_by_content(_generation(spark, sf, AFTER)))
    return rows.select("fact_id", F.array_join("sources", "|").alias("sources"))


@query("""
SELECT c.c_custkey, count(o.o_orderkey) AS orders FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY 1""")
def left_counts(spark, sf):
    """Parents with the number of their children, none counted as 0."""
    orders = load(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return inventory.with_counts(load(spark, sf, "customer").select("c_custkey"), orders, "c_custkey", "orders")


@query("""
SELECT g.generation_id, count(i.relative_path) AS failed FROM (SELECT DISTINCT generation_id FROM inventory) g LEFT JOIN (SELECT * FROM inventory WHERE status = 'failed' AND kind = 'symlink') i USING (generation_id) GROUP BY 1""")
def generation_counts(spark, sf):
    """Generations with the number of their failed links, none counted as 0."""
    inv = load(spark, sf, "inventory")
    return inventory.with_counts(inv.select("generation_id").distinct(), inv.where("status = 'failed' and kind = 'symlink'"), "generation_id", "failed")


UNITS = """
WITH u AS (SELECT content_hash, file_format, unit_number, count(*) AS spans, bool_or(x0 IS NULL) AS unlocated, sum(length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g'))) AS letters FROM spans GROUP BY 1, 2, 3),
w AS (SELECT *, list_filter([CASE WHEN letters < 10 THEN 'TEXT_LAYER_LOW_QUALITY' END, CASE WHEN unlocated THEN 'TEXT_LOCATION_UNAVAILABLE' END], lambda x: x IS NOT NULL) AS warnings FROM u),
o AS (SELECT content_hash, file_format, unit_number, spans, CASE WHEN len(warnings) = 0 THEN 'completed' ELSE 'partial' END AS status, warnings FROM w)"""


@query(UNITS + " SELECT content_hash, file_format, unit_number, spans, status, array_to_string(warnings, ',') AS warnings FROM o")
def unit_outcomes(spark, sf):
    """Status and warnings of every page."""
    return X.unit_outcomes(load(spark, sf, "spans")).withColumn("warnings", F.array_join("warnings", ","))


@query(UNITS + " SELECT content_hash, unit_number, status FROM o WHERE status <> 'completed' OR list_has_any(warnings, ['HANDWRITING_NOT_INTERPRETED', 'MISSING_CONTEXT', 'POSSIBLE_INCOMPLETE_TABLE_EXTRACTION', 'VISION_ITEMS_DROPPED', 'TEXT_LAYER_COVERAGE_UNVERIFIED'])")
def coverage_units(spark, sf):
    """Pages that need a coverage warning."""
    return X.coverage_units(X.unit_outcomes(load(spark, sf, "spans"))).select("content_hash", "unit_number", "status")


@query(UNITS + """, e AS (SELECT content_hash, max(unit_number) AS page_count FROM spans GROUP BY 1),
g AS (SELECT content_hash, count(*) AS n, bool_and(status = 'completed') AS whole, bool_or(status IN ('completed', 'partial')) AS kept FROM o GROUP BY 1)
SELECT content_hash, CASE WHEN whole AND n = page_count THEN 'completed' WHEN kept THEN 'partial' ELSE 'failed' END AS status FROM e LEFT JOIN g USING (content_hash)""")
def file_roll_up(spark, sf):
    """Status of every content from its pages."""
    spans = load(spark, sf, "spans")
    return X.roll_up(X.unit_outcomes(spans), spans.groupBy("content_hash").agg(F.max("unit_number").alias("page_count")))


@query("""
SELECT user_id, max_by(event_type, struct_pack(ts := ts, event_id := event_id)) AS verdict FROM events GROUP BY 1 HAVING max_by(event_type, struct_pack(ts := ts, event_id := event_id)) <> 'error'""")
def latest_decision(spark, sf):
    """The last verdict of every key, withdrawn ones gone (K5, K7)."""
    return X.latest(load(spark, sf, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("verdict")), ["user_id"], ["ts", "event_id"]).where("verdict <> 'error'").select("user_id", "verdict")


@query("""
SELECT content_hash, file_format FROM inventory WHERE generation_id = 'gen-0002' AND content_hash IS NOT NULL AND file_format IS NOT NULL
AND (content_hash, file_format) NOT IN (SELECT content_hash, file_format FROM spans) GROUP BY 1, 2""")
def cache_misses(spark, sf):
    """Contents whose text is not there yet."""
    wanted = _generation(spark, sf, AFTER).where(F.col("content_hash").isNotNull() & F.col("file_format").isNotNull()).select("content_hash", "file_format").distinct()
    return X.cache_misses(wanted, load(spark, sf, "spans"), ["content_hash", "file_format"])


PLACED = """
WITH p AS (SELECT *, coalesce(len(alternatives), 0) AS n, len(list_filter(alternatives, lambda a: a.start_date <= DATE '2021-06-30' AND a.end_date >= DATE '2016-03-01')) > 0 AS hit FROM lab_facts),
c AS (SELECT *, CASE WHEN n = 0 THEN 'undated' WHEN n > 1 THEN CASE WHEN hit THEN 'date uncertain' ELSE 'out of range' END WHEN NOT hit THEN 'out of range'
 WHEN alternatives[1].start_date >= DATE '2016-03-01' AND alternatives[1].end_date <= DATE '2021-06-30' THEN 'in range' ELSE 'may fall in range' END AS placement FROM p)"""


@query(PLACED + " SELECT fact_id, placement FROM c")
def date_placement(spark, sf):
    """Where uncertain dates fall against a window."""
    return load(spark, sf, "lab_facts").select("fact_id", D.classify(F.col("alternatives"), WINDOW).alias("placement"))


@query(PLACED + """ SELECT fact_id, array_to_string(list_transform(alternatives, lambda a: CASE WHEN a.date_precision = 'year' THEN strftime(a.start_date, '%Y') WHEN a.date_precision = 'month' THEN strftime(a.start_date, '%Y-%m') ELSE strftime(a.start_date, '%Y-%m-%d') END), ' or ') AS date_text,
 list_min(list_transform(alternatives, lambda a: a.start_date)) AS first_day, list_max(list_transform(alternatives, lambda a: a.end_date)) AS last_day FROM c""")
def timeline_text(spark, sf):
    """Dates as shown, and their envelope."""
    start, end = D.envelope(F.col("alternatives"))
    return load(spark, sf, "lab_facts").select("fact_id", D.format_alternatives(F.col("alternatives")).alias("date_text"), start.alias("first_day"), end.alias("last_day"))


#: Next year's last two digits when the test data were made: equal results need it fixed.
PIVOT = 27
_MONTHS = ", ".join(f"('{x}', {i})" for i, names in enumerate(D.MONTH_BEGINNINGS, 1) for x in names.split())
_WORDS = ", ".join(f"('{x}', {i})" for x, i in D.MONTH_WORDS.items())


def _month_of(word: str) -> str:
    return f"coalesce((SELECT m FROM (VALUES {_WORDS}) e(x, m) WHERE x = {word}), (SELECT max_by(m, length(x)) FROM (VALUES {_MONTHS}) b(x, m) WHERE starts_with({word}, x) AND length({word}) <= length(x) + 6))"


READINGS = f"""
WITH t AS (SELECT date_id, raw, regexp_replace(trim(regexp_replace(lower(coalesce(raw, '')), '\\s+', ' ', 'g')), ', ?[0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?$', '') AS s FROM date_claims),
m AS (SELECT *, regexp_extract(s, '(?:^|[^0-9])([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}})(?:[^0-9]|$)', ['y', 'm', 'd']) AS iso,
 regexp_extract(s, '(?:^|[^0-9])([0-9]{{1,2}})(?:[.]([0-9]{{1,2}})[.]|-([0-9]{{1,2}})-|/([0-9]{{1,2}})/)([0-9]{{4}}|[0-9]{{2}})(?:[^0-9]|$)', ['a', 'b1', 'b2', 'b3', 'y']) AS num,
 regexp_extract(s, '(?:^|[^0-9])([0-9]{{1,2}})(?:st|nd|rd|th)? (\\p{{L}}+)[.]?,? ([0-9]{{4}})(?:[^0-9]|$)', ['d', 'w', 'y']) AS dw,
 regexp_extract(s, '(\\p{{L}}+)[.]? ([0-9]{{1,2}})(?:st|nd|rd|th)?,? ([0-9]{{4}})(?:[^0-9]|$)', ['w', 'd', 'y']) AS wd,
 regexp_extract(s, '(?:^|[^0-9])([0-9]{{4}}) (\\p{{L}}+)[.]? ([0-9]{{1,2}})(?:st|nd|rd|th)?(?:[^0-9]|$)', ['y', 'w', 'd']) AS yw,
 regexp_extract(s, '(\\p{{L}}+)[.]? ([0-9]{{4}})(?:[^0-9]|$)', ['w', 'y']) AS wy, regexp_extract(s, '(?:^|[^0-9./-])([0-9]{{1,2}})[./]([0-9]{{4}})(?:[^0-9]|$)', ['m', 'y']) AS my,
 regexp_extract(s, '^[^0-9]*([0-9]{{4}})[^0-9]*$', 1) AS yy FROM t),
n AS (SELECT *, CASE WHEN length(num.y) = 2 THEN CASE WHEN try_cast(num.y AS INT) <= {PIVOT} THEN '20' ELSE '19' END || num.y ELSE num.y END AS ny, num.b1 || num.b2 || num.b3 AS nb,
 {_month_of('dw.w')} AS dm, {_month_of('wd.w')} AS wm, {_month_of('yw.w')} AS ym, {_month_of('wy.w')} AS mm FROM m),
r AS (SELECT date_id, raw, CASE
 WHEN iso.y <> '' THEN [try_cast(iso.y || '-' || iso.m || '-' || iso.d AS DATE)]
 WHEN num.y <> '' AND num.b3 = '' THEN [try_cast(ny || '-' || nb || '-' || num.a AS DATE)]
 WHEN num.y <> '' AND try_cast(num.a AS INT) > 12 THEN [try_cast(ny || '-' || nb || '-' || num.a AS DATE)]
 WHEN num.y <> '' AND try_cast(nb AS INT) > 12 THEN [try_cast(ny || '-' || num.a || '-' || nb AS DATE)]
 WHEN num.y <> '' AND try_cast(nb AS INT) = try_cast(num.a AS INT) THEN [try_cast(ny || '-' || nb || '-' || num.a AS DATE)]
 WHEN num.y <> '' THEN [try_cast(ny || '-' || nb || '-' || num.a AS DATE), try_cast(ny || '-' || num.a || '-' || nb AS DATE)]
 WHEN dm IS NOT NULL THEN [try_cast(dw.y || '-' || dm || '-' || dw.d AS DATE)] WHEN wm IS NOT NULL THEN [try_cast(wd.y || '-' || wm || '-' || wd.d AS DATE)]
 WHEN ym IS NOT NULL THEN [try_cast(yw.y || '-' || ym || '-' || yw.d AS DATE)] WHEN mm IS NOT NULL THEN [try_cast(wy.y || '-' || mm || '-01' AS DATE)]
 WHEN my.y <> '' THEN [try_cast(my.y || '-' || my.m || '-01' AS DATE)] WHEN yy <> '' THEN [try_cast(yy || '-01-01' AS DATE)] ELSE [] END AS days,
 CASE WHEN iso.y <> '' OR num.y <> '' OR dm IS NOT NULL OR wm IS NOT NULL OR ym IS NOT NULL THEN 'day' WHEN mm IS NOT NULL OR my.y <> '' THEN 'month' ELSE 'year' END AS form FROM n)
SELECT date_id, raw, array_to_string(list_transform(list_filter(days, lambda d: d IS NOT NULL AND year(d) BETWEEN 1900 AND 2100), lambda d: CASE form WHEN 'day' THEN strftime(d, '%Y-%m-%d') WHEN 'month' THEN strftime(d, '%Y-%m') ELSE strftime(d, '%Y') END), ' or ') AS reading FROM r"""


@query(READINGS)
def date_readings(spark, sf):
    """Readings of all dates claimed."""
    return load(spark, sf, "date_claims").select("date_id", "raw", D.format_alternatives(D.parse_date(F.col("raw"), PIVOT)).alias("reading"))


@query(r"""
WITH t AS (SELECT fact_id, raw_value, replace(replace(replace(raw_value, ' ', ''), '−', '-'), '﹣', '-') AS s FROM lab_facts)
SELECT fact_id, nullif(regexp_extract(s, '^(<=|>=|<|>|≤|≥)?([+-]?[0-9]+([.,][0-9]+)?)$', 1), '') AS comparator,
 CAST(try_cast(replace(regexp_extract(s, '^(<=|>=|<|>|≤|≥)?([+-]?[0-9]+([.,][0-9]+)?)$', 2), ',', '.') AS DECIMAL(38,9)) AS DOUBLE) AS number,
 coalesce(NOT regexp_matches(raw_value, '[0-9]') AND trim(raw_value) <> '', false) AS qualitative FROM t""")
def value_parse(spark, sf):
    """Reported values read (M1)."""
    return load(spark, sf, "lab_facts").select("fact_id", V.parse_value(F.col("raw_value")).alias("v")).select("fact_id", "v.comparator", F.col("v.number").cast("double").alias("number"), "v.qualitative")


STEM = """CASE WHEN length(w) < 5 THEN w WHEN regexp_matches(w, '^[a-z0-9''/.-]+$') THEN CASE WHEN w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END
 WHEN regexp_matches(w, '[Ѐ-ӿ]') THEN CASE """ + " ".join(
    f"WHEN length(w) - {len(g.split()[0])} >= 4 AND right(w, {len(g.split()[0])}) IN ({', '.join(repr(e) for e in g.split())}) THEN left(w, length(w) - {len(g.split()[0])})" for g in T.ENDINGS
) + " ELSE w END ELSE w END"


@query(f"""
WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(replace(lower(term_label), 'ё', 'е'), '[\\p{{L}}\\p{{N}}_'']+(?:[-/.][\\p{{L}}\\p{{N}}_'']+)*')) AS w FROM concept_terms) SELECT w AS word, {STEM} AS stem FROM t""")
def stem_tokens(spark, sf):
    """Stems of the words of all terms."""
    words = load(spark, sf, "concept_terms").select(F.explode(T.tokens(T.normalise(F.col("term_label")))).alias("word")).distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


@query("""
WITH t AS (SELECT DISTINCT replace(lower(term_label), 'ё', 'е') AS term FROM concept_terms WHERE regexp_matches(term_label, '^[\\p{L}]+$')),
d AS (SELECT DISTINCT term_label, unnest(string_split_regex(replace(lower(term_label), 'ё', 'е'), '[^\\p{L}\\p{N}_.]+')) AS part FROM concept_terms),
w AS (SELECT DISTINCT term_label, regexp_extract(part, '^([\\p{L}\\p{N}_]+)', 1) AS term FROM d WHERE NOT regexp_matches(part, '^[\\p{L}\\p{N}_]+[.][0-9]'))
SELECT term, count(*) AS labels FROM w JOIN t USING (term) GROUP BY 1""")
def token_hits(spark, sf):
    """Listed labels that hold each one-word term as a token."""
    labels = load(spark, sf, "concept_terms").select("term_label", T.normalise(F.col("term_label")).alias("text")).distinct()
    t = labels.where(F.col("term_label").rlike(r"^\p{L}+$")).select(F.col("text").alias("term")).distinct()
    words = labels.withColumn("term", F.explode(F.array_distinct(R.word_runs(F.col("text"))))).join(t, "term")
    return words.where(T.contains_token(F.col("text"), F.col("term"))).groupBy("term").agg(F.count_distinct("term_label").alias("labels"))


@query("""
WITH t AS (SELECT DISTINCT replace(lower(term_label), 'ё', 'е') AS phrase FROM concept_terms WHERE regexp_matches(term_label, '^[\\p{L}]+ [\\p{L}]+$')),
w AS (SELECT DISTINCT term_label, regexp_extract_all(replace(lower(term_label), 'ё', 'е'), '[\\p{L}\\p{N}_'']+(?:[-/.][\\p{L}\\p{N}_'']+)*') AS a FROM concept_terms),
g AS (SELECT DISTINCT term_label, unnest(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) AS phrase FROM w)
SELECT phrase, count(*) AS labels FROM g JOIN t USING (phrase) GROUP BY 1""")
def phrase_hits(spark, sf):
    """Listed labels in which the words of a two-word term follow one another (F8)."""
    labels = load(spark, sf, "concept_terms").select("term_label", T.normalise(F.col("term_label")).alias("text")).distinct()
    t = labels.where(F.col("term_label").rlike(r"^\p{L}+ \p{L}+$")).select(F.col("text").alias("phrase")).distinct()
    d = labels.select("term_label", T.tokens(F.col("text")).alias("words"))
    first = d.withColumn("_w", F.explode(F.array_distinct("words"))).join(t.withColumn("_w", F.split("phrase", " ")[0]), "_w")
    return first.where(T.contains_phrase(F.col("words"), F.split("phrase", " "))).groupBy("phrase").agg(F.count_distinct("term_label").alias("labels"))


REJECTED = (("glucose", "A107"),)
PROPOSED = (("urate", "A107"), ("hct", "A101"))


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return terms.dictionary(load(spark, sf, "concept_terms"))


def _values(rows, names: str, alias: str = "v") -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + f") {alias}({names})"


TOKENS = "regexp_extract_all(replace(replace({0}, 'ё', 'е'), '`', chr(39)), '[\\p{{L}}\\p{{N}}_'']+(?:[-/.][\\p{{L}}\\p{{N}}_'']+)*')"


def _key(label: str) -> str:
    return "array_to_string(" + TOKENS.format(f"lower({label})") + ", ' ')"


def _stems(label: str) -> str:
    return "array_to_string(list_transform(" + TOKENS.format(f"lower({label})") + f", lambda w: {STEM}), ' ')"


@query(f"""
WITH t AS (SELECT DISTINCT concept_id, {_key('term_label')} AS key, {_stems('term_label')} AS stem_key FROM concept_terms),
l AS (SELECT DISTINCT term_label AS label, {_key('term_label')} AS key, {_stems('term_label')} AS stem_key FROM concept_terms),
h AS (SELECT key, count(DISTINCT concept_id) AS holders FROM t GROUP BY 1),
x AS (SELECT l.label, l.key, t.concept_id, CASE WHEN holders > 1 THEN 3 ELSE 0 END AS r FROM l JOIN t ON l.key = t.key JOIN h ON h.key = t.key
 UNION ALL SELECT l.label, l.key, t.concept_id, 1 FROM l JOIN t ON l.stem_key = t.stem_key UNION ALL SELECT l.label, l.key, p.concept_id, 2 FROM l JOIN {_values(PROPOSED, 'key, concept_id', 'p')} ON l.key = p.key)
SELECT label, concept_id, CASE min(r) WHEN 0 THEN 'mapped' WHEN 1 THEN 'inflected' WHEN 2 THEN 'auto-mapped' ELSE 'ambiguous' END AS status FROM x
WHERE key <> '' AND (key, concept_id) NOT IN (SELECT * FROM {_values(REJECTED, 'a, b')}) GROUP BY 1, 2""")
def term_match(spark, sf):
    """All listed labels against the dictionary, with rejections, proposals and ambiguity."""
    return _matched(spark, sf, load(spark, sf, "concept_terms"), "term_label")


def _matched(spark: SparkSession, sf: str, labels: DataFrame, column: str) -> DataFrame:
    decisions = spark.createDataFrame([(k, c, "rejected") for k, c in REJECTED], "key string, concept_id string, verdict string")
    proposals = spark.createDataFrame(list(PROPOSED), "key string, concept_id string")
    return terms.match(labels, column, _words(spark, sf), decisions=decisions, proposals=proposals)


@query()
def label_matches(spark, sf):
    """All labels as typed against the dictionary (D3, J3); SQL cannot normalise them."""
    return _matched(spark, sf, load(spark, sf, "lab_facts"), "raw_label")


@query(f"""
WITH t AS (SELECT DISTINCT p_type AS concept_id, {_stems("string_split(p_name, ' ')[-1]")} AS stem_key FROM part WHERE p_name IS NOT NULL), l AS (SELECT DISTINCT p_name AS label, {_stems('p_name')} AS s FROM part)
SELECT DISTINCT label, concept_id FROM l JOIN t ON contains(' ' || s || ' ', ' ' || stem_key || ' ')
WHERE contains(s, ' ') AND NOT EXISTS (SELECT 1 FROM t u WHERE u.concept_id = t.concept_id AND u.stem_key = l.s)""")
def propose_terms(spark, sf):
    """Names of parts that hold the last word of a name of a type without being it."""
    part = load(spark, sf, "part")
    last = part.where(F.col("p_name").isNotNull()).select(F.col("p_type").alias("concept_id"), F.lit("part").alias("kind"), F.element_at(F.split("p_name", " "), -1).alias("term_label"))
    return terms.propose(part, "p_name", terms.dictionary(last))


@query()
def label_proposals(spark, sf):
    """Labels as typed that hold a term without being it (D5, G12); SQL cannot normalise them."""
    return terms.propose(load(spark, sf, "lab_facts"), "raw_label", _words(spark, sf))


@query("""
SELECT p_type AS name, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS members, count(DISTINCT p_brand) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1""")
def group_members(spark, sf):
    """Groups with their members."""
    return terms.members_of(load(spark, sf, "part"), "p_type", "p_brand").withColumn("members", F.array_join("members", ","))


@query("SELECT unit, count(*) AS n FROM lab_facts WHERE unit IS NOT NULL GROUP BY 1")
def units_histogram(spark, sf):
    """Facts per unit as written."""
    return X.units_histogram(load(spark, sf, "lab_facts"))


@query("""
WITH e AS (SELECT *, date_diff('microsecond', lag(ts) OVER w, ts) / 1e6 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM e)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first_event FROM i GROUP BY 1, 2""")
def gap_islands(spark, sf):
    """Rows merged while gaps stay small: the rule that merges words."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, sf, "events")
    at = layout.position(e, "ts")
    e = e.withColumn("gap", (at - F.lag(at).over(w)) / 1e6)
    rows = X.islands(e, ["user_id"], ["ts", "event_id"], "gap", 3600)
    return rows.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""
WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup'),
j AS (SELECT s.event_id, p.event_id AS e, row_number() OVER (PARTITION BY s.event_id ORDER BY abs(date_diff('microsecond', s.ts, p.ts)), p.ts, p.event_id DESC) AS n FROM s LEFT JOIN p USING (user_id))
SELECT event_id, e AS nearest_event_id FROM j WHERE n = 1""")
def nearest_row(spark, sf):
    """The nearest row of another kind, ties to the earlier one."""
    e = load(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    right = e.where("event_type = 'purchase'").drop("event_type")
    out = layout.nearest(e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("id")), right, ["user_id"], "ts", "event_id")
    return out.select(F.col("id").alias("event_id"), "nearest_event_id")


@query("""
WITH w AS (SELECT *, max(CASE WHEN event_type = 'view' THEN struct_pack(ts := ts, id := event_id) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM events)
SELECT event_id, v.id AS header FROM w WHERE event_type = 'error'""")
def latest_header(spark, sf):
    """The latest earlier row of a kind: a backward as-of join."""
    e = load(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return layout.latest_before(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", F.col("event_id"), "header").where("event_type = 'error'").select("event_id", "header")


@query("""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND INTERVAL 60 SECONDS FOLLOWING) - 1 AS near FROM events""")
def band_neighbours(spark, sf):
    """Rows within a band around each row."""
    return layout.band_counts(load(spark, sf, "events"), ["user_id"], "ts", 60_000_000).select("event_id", "near")


@query("""
WITH w AS (SELECT relative_path, generation_id, status = 'failed' AS priority, relative_path || ': ' || status AS line FROM inventory WHERE status <> 'ready'),
t AS (SELECT row_number() OVER (ORDER BY priority DESC, relative_path, generation_id) AS seq, priority, line FROM w)
SELECT * FROM t WHERE seq <= 30 UNION ALL SELECT 31, false, '… and ' || (n - 30) || ' more coverage warnings elsewhere in the collection' FROM (SELECT count(*) AS n FROM w) WHERE n > 30""")
def top_warnings(spark, sf):
    """Warnings by priority, thirty and the rest counted: a top-k report."""
    rows = load(spark, sf, "inventory").where("status <> 'ready'")
    rows = rows.select("relative_path", "generation_id", (F.col("status") == "failed").alias("priority"), F.concat_ws(": ", "relative_path", "status").alias("line"))
    return X.top_warnings(rows, ["relative_path", "generation_id"])


@query("""
WITH i AS (SELECT DISTINCT content_hash FROM spans) SELECT left(content_hash, 6) AS prefix, min(content_hash) AS "only" FROM i GROUP BY 1 HAVING count(*) = 1""")
def unique_prefixes(spark, sf):
    """Prefixes that name one content."""
    return X.unique_prefixes(load(spark, sf, "spans"), "content_hash", 6)


CHECKS = """
WITH c AS (SELECT fact_id + CASE WHEN planned THEN 0 ELSE 100000000 END AS result_id, content_hash, event_type AS verdict FROM event_facts)"""


def _checks(spark: SparkSession, sf: str) -> DataFrame:
    """Event facts as checks; unplanned ones point at results that are gone."""
    e = load(spark, sf, "event_facts")
    return e.select((F.col("fact_id") + F.when(F.col("planned"), 0).otherwise(100000000)).alias("result_id"), "content_hash", F.col("event_type").alias("verdict"))


@query(CHECKS + """ SELECT result_id, CASE WHEN EXISTS (SELECT 1 FROM event_facts f WHERE f.fact_id = c.result_id) THEN 'result and evidence available'
 WHEN EXISTS (SELECT 1 FROM lab_facts l WHERE l.content_hash = c.content_hash) THEN 'document present; result not in this generation' ELSE 'unavailable' END AS availability FROM c""")
def check_availability(spark, sf):
    """What is left of what checks were made on."""
    return X.availability(_checks(spark, sf), load(spark, sf, "event_facts"), load(spark, sf, "lab_facts")).select("result_id", "availability")


@query(CHECKS + """ SELECT verdict, coalesce(l.verification, e.verification, 'gone') AS state, count(*) AS n FROM c LEFT JOIN lab_facts l ON l.fact_id = c.result_id LEFT JOIN event_facts e ON e.fact_id = c.result_id GROUP BY 1, 2""")
def checks_by_state(spark, sf):
    """Verdicts against the state of their facts."""
    return X.observed_by_state(_checks(spark, sf), load(spark, sf, "lab_facts"), load(spark, sf, "event_facts"))


@query("""
SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'OCR_REQUIRED' WHEN length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) < 10 OR length(text) - length(replace(text, '�', '')) > 0.02 * length(text) THEN 'TEXT_LAYER_LOW_QUALITY' END AS warning FROM documents""")
def text_quality(spark, sf):
    """Text layers that must be read again."""
    return load(spark, sf, "documents").select("doc_id", V.quality_warning(F.col("text")).alias("warning"))


@query("""
SELECT DISTINCT content_hash, file_format, sha256('["' || content_hash || '","' || file_format || '","reader-1"]') AS cache_key FROM inventory WHERE content_hash IS NOT NULL AND file_format IS NOT NULL""")
def memo_keys(spark, sf):
    """Keys of memoised steps (M2)."""
    rows = load(spark, sf, "inventory").where(F.col("content_hash").isNotNull() & F.col("file_format").isNotNull()).select("content_hash", "file_format").distinct()
    return rows.withColumn("cache_key", V.step_key(F.col("content_hash"), F.col("file_format"), F.lit("reader-1")))


@query(r"""
WITH p AS (SELECT content_hash, list_reverse(string_split(relative_path, '/')) AS s FROM inventory WHERE content_hash IS NOT NULL),
d AS (SELECT content_hash, coalesce(try_cast(replace(nullif(regexp_extract(s[1], '(?:^|[^0-9])([0-9]{4}[.-][0-9]{2}[.-][0-9]{2})(?:[^0-9]|$)', 1), ''), '.', '-') AS DATE),
 try_cast(regexp_replace(nullif(regexp_extract(s[1], '(?:^|[^0-9])((?:19|20)[0-9]{6})(?:[^0-9]|$)', 1), ''), '(....)(..)(..)', '\1-\2-\3') AS DATE)) AS day,
 list_filter(s, lambda x: regexp_matches(x, '^[0-9]{4}$') AND x BETWEEN '1900' AND '2100') AS years FROM p),
t AS (SELECT content_hash, coalesce(strftime(day, '%Y-%m-%d'), years[1]) AS day FROM d)
SELECT content_hash, min(day) AS day FROM t WHERE day IS NOT NULL GROUP BY 1 HAVING count(DISTINCT day) = 1""")
def filename_dates(spark, sf):
    """The one period that all dated paths of a content agree on."""
    paths = load(spark, sf, "inventory").where(F.col("content_hash").isNotNull()).select("content_hash", "relative_path")
    return D.consensus(paths, "content_hash", "relative_path").select("content_hash", D.format_alternatives(F.col("alternatives")).alias("day"))


SECTIONS = """
t AS (SELECT DISTINCT lower(term_label) AS key FROM concept_terms WHERE concept_id = 'A107'),
m AS (SELECT * FROM c JOIN t ON lower(c.raw_label) = t.key WHERE placement NOT IN ('out of range', 'undated')),
s AS (SELECT *, list_filter([CASE WHEN verification = 'conflicting' THEN 'conflicting reading' END, CASE WHEN list_contains(notes, 'ASSOCIATION_NOT_LOCATED') THEN 'association not located' END,
 CASE WHEN placement = 'date uncertain' THEN 'date uncertain' END], lambda x: x IS NOT NULL) AS reasons FROM m)"""


@query(PLACED + "," + SECTIONS + " SELECT fact_id, placement, array_to_string(reasons, ';') AS reasons, CASE WHEN len(reasons) > 0 THEN 'candidate' ELSE 'dated' END AS section FROM s")
def history_sections(spark, sf):
    """The flagship: facts of a term's exact labels in a window, in sections."""
    f = load(spark, sf, "lab_facts")
    keys = load(spark, sf, "concept_terms").where("concept_id = 'A107'").select(F.lower("term_label").alias("_k")).distinct()
    matches = f.select(F.col("raw_label").alias("label")).distinct().join(keys, F.lower("label") == F.col("_k")).select("label", F.lit("mapped").alias("status"))
    rows = history.sections(f, "raw_label", matches, WINDOW)
    return rows.select("fact_id", "placement", F.array_join("reasons", ";").alias("reasons"), "section")


@query(PLACED + "," + SECTIONS + " SELECT count(*) AS excluded_undated FROM c JOIN t ON lower(c.raw_label) = t.key WHERE placement = 'undated'")
def excluded_undated(spark, sf):
    """Undated facts that a window leaves out."""
    f = load(spark, sf, "lab_facts")
    keys = load(spark, sf, "concept_terms").where("concept_id = 'A107'").select(F.lower("term_label").alias("_k")).distinct()
    matches = f.select(F.col("raw_label").alias("label")).distinct().join(keys, F.lower("label") == F.col("_k")).select("label")
    return history.excluded_undated(f, "raw_label", matches, WINDOW)


@query()
def history_labs(spark, sf):
    """The whole answer for a measurement, with inflected and look-alike labels."""
    r = history.run_query(load(spark, sf, "lab_facts"), "raw_label", load(spark, sf, "spans"), load(spark, sf, "concept_terms"), "analyte", "glucose", "2016-03", "2021-06")
    return r.rows.select("section", "date_text", "raw_label", "raw_value", "unit", "fact_id")


@query()
def history_visits(spark, sf):
    """The whole answer for a specialty."""
    r = history.run_query(load(spark, sf, "event_facts"), "raw_specialty", load(spark, sf, "spans"), load(spark, sf, "concept_terms"), "specialty", "cardiology", "2018", "2019")
    return r.rows.select("section", "date_text", "raw_specialty", "event_type", "fact_id")


@query()
def history_mentions(spark, sf):
    """Mentions in page text that no fact covers."""
    r = history.run_query(load(spark, sf, "lab_facts"), "raw_label", load(spark, sf, "spans"), load(spark, sf, "concept_terms"), "analyte", "glucose")
    return r.mentions


@query("""
WITH RECURSIVE s AS (SELECT content_hash, unit_number, span_index, text, x0, (y0 + y1) / 2 AS y, y1 - y0 AS h, x0 IS NOT NULL AND y0 IS NOT NULL AND y1 IS NOT NULL AS boxed FROM spans),
o AS (SELECT *, row_number() OVER (PARTITION BY content_hash, unit_number ORDER BY y, x0, span_index) AS n FROM s WHERE boxed),
f AS (SELECT content_hash, unit_number, n, 0 AS row, y AS total, 1 AS k, h FROM o WHERE n = 1
 UNION ALL SELECT o.content_hash, o.unit_number, o.n, CASE WHEN abs(o.y - f.total / f.k) <= 0.5 * greatest(f.h, o.h) THEN f.row ELSE f.row + 1 END,
 CASE WHEN abs(o.y - f.total / f.k) <= 0.5 * greatest(f.h, o.h) THEN f.total + o.y ELSE o.y END, CASE WHEN abs(o.y - f.total / f.k) <= 0.5 * greatest(f.h, o.h) THEN f.k + 1 ELSE 1 END,
 CASE WHEN abs(o.y - f.total / f.k) <= 0.5 * greatest(f.h, o.h) THEN greatest(f.h, o.h) ELSE o.h END
 FROM f JOIN o ON o.content_hash = f.content_hash AND o.unit_number = f.unit_number AND o.n = f.n + 1),
b AS (SELECT o.content_hash, o.unit_number, f.row, string_agg(coalesce(o.text, ''), ' ' ORDER BY o.x0, o.span_index) AS text, count(*) AS spans FROM o JOIN f USING (content_hash, unit_number, n) GROUP BY 1, 2, 3),
m AS (SELECT content_hash, unit_number, max(row) + 1 AS first FROM f GROUP BY 1, 2),
l AS (SELECT s.content_hash, s.unit_number, coalesce(m.first, 0) + row_number() OVER (PARTITION BY s.content_hash, s.unit_number ORDER BY span_index) - 1 AS row, text, 1 AS spans
 FROM s LEFT JOIN m USING (content_hash, unit_number) WHERE NOT boxed AND trim(text) <> '')
SELECT * FROM (SELECT * FROM b UNION ALL SELECT * FROM l) WHERE trim(text) <> ''""")
def row_clusters(spark, sf):
    """Visual rows of all pages."""
    return layout.cluster_rows(load(spark, sf, "spans")).select("content_hash", "unit_number", "row", "text", F.size("members").alias("spans"))


def _text(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@query()
def ground_labs(spark, sf):
    """Lab claims checked against their pages."""
    g = grounding.ground_labs(load(spark, sf, "lab_facts"), grounding.page_rows(load(spark, sf, "spans")))
    return g.select("fact_id", "grounding", F.array_join("notes", ",").alias("notes"), _text("evidence").alias("evidence"), "alternative_label", _text("alternative_evidence").alias("alternative_evidence"))


def _dates(spark: SparkSession, sf: str, rows: DataFrame, roles: dict | None = None) -> DataFrame:
    d = load(spark, sf, "date_claims")
    return grounding.reported_dates(d.replace(roles, subset=["date_role"]) if roles else d, rows)


@query()
def page_dates(spark, sf):
    """Claimed dates located on their pages, and whether their role is borne out."""
    d = _dates(spark, sf, grounding.page_rows(load(spark, sf, "spans")))
    return d.select("date_id", "raw", "role", D.format_alternatives(F.col("alternatives")).alias("reading"), "located", "role_supported", _text("evidence").alias("evidence"))


@query()
def interpreted_labs(spark, sf):
    """Lab facts as their pages and paths bear them out."""
    rows = grounding.page_rows(load(spark, sf, "spans"))
    f = grounding.interpret_labs(load(spark, sf, "lab_facts"), _dates(spark, sf, rows), rows, _generation(spark, sf, AFTER))
    return f.select("fact_id", "verification", F.col("timeline.role").alias("role"), D.format_alternatives(F.col("timeline.alternatives")).alias("dates"), "reference_interval", "flag", "specimen", F.array_join("notes", ",").alias("notes"), _text("evidence").alias("evidence"))


@query()
def interpreted_events(spark, sf):
    """Events as their pages bear them out; the pages' own dates are taken as the events' (D9, J13, J18, M6)."""
    rows = grounding.page_rows(load(spark, sf, "spans"))
    f = grounding.interpret_events(load(spark, sf, "event_facts"), _dates(spark, sf, rows, {"unspecified": "event"}), rows)
    return f.select("fact_id", "verification", "strength", D.format_alternatives(F.col("timeline.alternatives")).alias("dates"), "alternative_event_type", F.array_join("notes", ",").alias("notes"), _text("evidence").alias("evidence"))


@query()
def uncovered_rows(spark, sf):
    """Rows of results of which no fact has evidence."""
    rows = grounding.page_rows(load(spark, sf, "spans"))
    return grounding.uncovered_rows(rows, load(spark, sf, "lab_facts")).select("content_hash", "unit_number", "row", "text")


def _cue_sql() -> str:
    return ", ".join(f"CASE WHEN regexp_matches(c, '{words.replace(chr(39), chr(39) * 2).replace(' ', '|').replace('_', ' ')}') THEN '{t}' END" for t, words in R.EVENT_CUES.items())


TYPES = f"""
WITH RECURSIVE c AS (SELECT fact_id, list_filter(string_split_regex(trim(regexp_replace(replace(lower(nfc_normalize(coalesce(wording, ''))), 'ё', 'е'), '\\s+', ' ', 'g')), '[.;!?]+'), lambda x: trim(x) <> '') AS parts FROM event_facts),
k AS (SELECT fact_id, unnest(parts) AS c, generate_subscripts(parts, 1) AS n, len(parts) AS size FROM c),
o AS (SELECT *, list_filter([{_cue_sql()}], lambda x: x IS NOT NULL) AS own,
 regexp_matches(c, 'cancel|postpon|reschedul|no[\\s-]?show|did\\s+not\\s+attend|отмен|скасов|перенес|не\\s+состоял|не\\s+відбул|не\\s+явил|не\\s+з''явив') AS gone,
 regexp_matches(c, '(?:^|\\s)(?:no|not|never|denied|without|neither|nor|не|нет|ні|ни|без|відсут)(?:\\s|$)') AS neg FROM k),
f AS (SELECT fact_id, 0 AS n, CAST([] AS VARCHAR[]) AS types FROM c
 UNION ALL SELECT f.fact_id, o.n, CASE WHEN (gone OR neg) AND len(own) > 0 THEN list_filter(types, lambda x: NOT list_contains(own, x)) WHEN gone THEN [] WHEN neg THEN types ELSE list_distinct(list_concat(types, own)) END
 FROM f JOIN o ON o.fact_id = f.fact_id AND o.n = f.n + 1),
e AS (SELECT fact_id, max_by(types, n) AS types FROM f GROUP BY 1)
SELECT fact_id, CASE WHEN list_contains(types, 'recommendation') THEN 'other' ELSE array_to_string(list_sort(list_filter(types, lambda x: NOT (list_has_any(types, ['referral', 'appointment_scheduled', 'appointment_confirmed']) AND x IN ('encounter', 'procedure', 'result')))), ',') END AS types FROM e"""


@query(TYPES)
def wording_types(spark, sf):
    """Event types that wordings imply."""
    return load(spark, sf, "event_facts").select("fact_id", F.array_join(R.wording_types(F.col("wording")), ",").alias("types"))


@query()
def normalised_labels(spark, sf):
    """Comparable keys of all labels."""
    return load(spark, sf, "lab_facts").select("raw_label").distinct().select("raw_label", T.label_key(F.col("raw_label")).alias("key"), T.stem_key(F.col("raw_label")).alias("stem_key"))


def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    inv, spans, labs = _generation(spark, sf, AFTER), load(spark, sf, "spans"), load(spark, sf, "lab_facts")
    units = X.unit_outcomes(spans)
    pages = units.groupBy("content_hash", "file_format").agg(F.max("unit_number").alias("page_count"), F.count(F.lit(1)).alias("unit_count"), F.bool_and(F.col("status") == "completed").alias("whole"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("warnings")))).alias("warnings"))
    problems = pages.where(~F.col("whole") | (F.col("unit_count") != F.col("page_count"))).withColumn("status", F.lit("partial"))
    tables = coverage.last_tables(labs.where(F.array_contains("notes", "UNIT_NOT_LOCATED")).withColumn("seq", F.col("fact_id")))
    sources = inventory.sources_by_content(inv)
    first = sources.join(labs.where("verification = 'conflicting'").select("content_hash").distinct(), "content_hash", "left_semi").select(F.explode("sources").alias("relative_path"))
    return coverage.coverage_lines(inv.where("status <> 'ready'"), problems, units, sources, spans, tables, first)


COVERAGE = UNITS + """,
src AS (SELECT content_hash, list_sort(list_distinct(list(relative_path))) AS sources FROM inventory WHERE generation_id = 'gen-0002' AND content_hash IS NOT NULL GROUP BY 1),
p AS (SELECT content_hash, file_format, max(unit_number) AS page_count, count(*) AS unit_count, bool_and(status = 'completed') AS whole, list_sort(list_distinct(flatten(list(warnings)))) AS warnings FROM o GROUP BY 1, 2),
n AS (SELECT DISTINCT content_hash FROM lab_facts WHERE verification = 'conflicting'),
u2 AS (SELECT o.*, coalesce(s.sources[1], 'unknown source') || CASE WHEN len(s.sources) > 1 THEN ' (+' || (len(s.sources) - 1) || ' identical copies)' ELSE '' END AS subject,
 coalesce(s.sources[1], 'unknown source') || CASE WHEN o.file_format = 'pdf' THEN ' page ' || o.unit_number ELSE ' image' END || CASE WHEN len(s.sources) > 1 THEN ' (+' || (len(s.sources) - 1) || ' identical copies)' ELSE '' END AS place,
 s.sources IS NOT NULL AND n.content_hash IS NOT NULL AS priority FROM o LEFT JOIN src s USING (content_hash) LEFT JOIN n USING (content_hash)
 WHERE o.status <> 'completed'),
tab AS (SELECT content_hash, file_format, unit_number, max_by(evidence, fact_id) AS evidence FROM lab_facts WHERE list_contains(notes, 'UNIT_NOT_LOCATED') GROUP BY 1, 2, 3),
snip AS (SELECT u2.subject, u2.place, u2.priority, u2.content_hash, u2.unit_number, left(string_agg(trim(s.text), ' | ' ORDER BY s.span_index), 120) AS t FROM u2 JOIN tab USING (content_hash, file_format, unit_number)
 JOIN spans s ON s.content_hash = tab.content_hash AND s.file_format = tab.file_format AND s.unit_number = tab.unit_number AND list_contains(tab.evidence, s.span_index) GROUP BY 1, 2, 3, 4, 5, u2.file_format)
SELECT 0 AS section, '' AS subject, CAST(NULL AS INT) AS unit_number, 0 AS kind, false AS priority, 'Not processed: ' || count(*) || ' unsupported files (see scan inventory).' AS line FROM inventory WHERE generation_id = 'gen-0002' AND status <> 'ready' HAVING count(*) > 0
UNION ALL SELECT 1, subject, NULL, 0, priority, 'File partial: ' || subject || ' (pages known: ' || page_count || '; units recorded: ' || unit_count || CASE WHEN len(warnings) > 0 THEN '; ' || array_to_string(warnings, ', ') ELSE '' END || ')'
 FROM (SELECT p.*, coalesce(s.sources[1], 'unknown source') || CASE WHEN len(s.sources) > 1 THEN ' (+' || (len(s.sources) - 1) || ' identical copies)' ELSE '' END AS subject, s.sources IS NOT NULL AND n.content_hash IS NOT NULL AS priority
 FROM p LEFT JOIN src s USING (content_hash) LEFT JOIN n USING (content_hash) WHERE NOT whole OR unit_count <> page_count)
UNION ALL SELECT 2, subject, unit_number, 1, priority, 'Partially processed: ' || place || ' (' || status || '; ' || array_to_string(list_sort(warnings), ', ') || ')' FROM u2 WHERE status <> 'completed'
UNION ALL SELECT 2, subject, unit_number, 9, priority, 'Possible incomplete table extraction: ' || place || '; row without a structured result near: ' || t FROM snip"""


@query(COVERAGE)
def coverage_lines(spark, sf):
    """All messages about what was not read whole."""
    return _coverage(spark, sf)


@query(f"""
WITH z AS ({COVERAGE}), t AS (SELECT row_number() OVER (ORDER BY priority DESC, section, subject, unit_number NULLS FIRST, kind) AS seq, priority, line FROM z)
SELECT * FROM t WHERE seq <= 30 UNION ALL SELECT 31, false, '… and ' || (n - 30) || ' more coverage warnings elsewhere in the collection' FROM (SELECT count(*) AS n FROM z) WHERE n > 30""")
def coverage_warnings(spark, sf):
    """The thirty messages an answer shows first, and how many more there are: a top-k report."""
    return coverage.coverage_warnings(_coverage(spark, sf))


@query(f"""
WITH g AS ({SQL['guard_findings']}),
r AS (SELECT finding, subject, CASE WHEN finding LIKE 'fewer %' THEN '' ELSE detail END AS detail, CASE WHEN finding LIKE 'fewer %' THEN CAST(string_split(detail, ' -> ')[1] AS BIGINT) END AS b, CASE WHEN finding LIKE 'fewer %' THEN CAST(string_split(detail, ' -> ')[2] AS BIGINT) END AS a FROM g)
SELECT finding, detail, count(*) AS n, CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after, array_to_string(list_sort(list_distinct(list(subject)))[1:3], ', ') AS samples FROM r GROUP BY 1, 2""")
def guard_summary(spark, sf):
    """Findings of the guard by kind, with sums and three samples."""
    return coverage.summarise_findings(guard_findings(spark, sf))


DISPLAY = """
WITH src AS (SELECT content_hash, list_sort(list_distinct(list(relative_path))) AS sources FROM inventory WHERE generation_id = 'gen-0002' AND content_hash IS NOT NULL GROUP BY 1)
SELECT f.fact_id, CASE WHEN coalesce(len(alternatives), 0) = 0 THEN '-' ELSE array_to_string(list_transform(alternatives, lambda a: CASE WHEN a.date_precision = 'year' THEN strftime(a.start_date, '%Y') WHEN a.date_precision = 'month' THEN strftime(a.start_date, '%Y-%m') ELSE strftime(a.start_date, '%Y-%m-%d') END), ' or ') || ' (' || {role} || ')' END AS date_text,
 {fields}, coalesce(s.sources[1], 'unknown source') || CASE WHEN file_format = 'pdf' THEN ' page ' || unit_number ELSE ' image' END || CASE WHEN len(s.sources) > 1 THEN ' (+' || (len(s.sources) - 1) || ' identical copies)' ELSE '' END AS source
FROM {facts} f LEFT JOIN src s USING (content_hash)"""


@query(DISPLAY.format(facts="lab_facts", role="coalesce(timeline_role, 'None')", fields="""raw_label AS label, raw_value AS value, coalesce(nullif(unit, ''), '-') AS unit, coalesce(nullif(reference_interval, ''), '-') AS reference, coalesce(nullif(flag, ''), '-') AS flag,
 coalesce(nullif(specimen, ''), '-') AS specimen, CASE WHEN verification = 'unverified reading' THEN 'unverified reading' ELSE '' END AS markers"""))
def lab_display(spark, sf):
    """Measurements as an answer shows them."""
    return coverage.lab_display(load(spark, sf, "lab_facts"), inventory.sources_by_content(_generation(spark, sf, AFTER)))


@query(DISPLAY.format(facts="event_facts", role="CASE WHEN planned AND timeline_role = 'event' THEN 'planned' ELSE coalesce(timeline_role, 'None') END", fields="""replace(CASE WHEN recommendation THEN 'other — recommendation' ELSE event_type END, '_', ' ') AS event, raw_specialty AS specialty, left(wording, 80) AS wording,
 CASE WHEN verification = 'unverified reading' THEN 'unverified reading' || coalesce('; evidence: ' || strength, '') ELSE coalesce('evidence: ' || strength, '') END AS markers"""))
def event_display(spark, sf):
    """Events as an answer shows them."""
    return coverage.event_display(load(spark, sf, "event_facts"), inventory.sources_by_content(_generation(spark, sf, AFTER)))


@query("""
SELECT 'Different units are reported: ' || string_agg(unit || ' (' || n || ')', ', ' ORDER BY unit) || '. Values are shown as written.' AS note FROM (SELECT coalesce(unit, '-') AS unit, count(*) AS n FROM lab_facts WHERE lower(raw_label) = 'glucose' GROUP BY 1) HAVING count(*) > 1""")
def units_note(spark, sf):
    """The note on units of one label's rows."""
    return history.units_note(load(spark, sf, "lab_facts").where("lower(raw_label) = 'glucose'"))
