"""Claims against pages: hand-made pages with their expected readings."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from spanline.functions import dates as D
from spanline.functions import rows as R
from spanline.operators import coverage, grounding, history, layout

SPANS = "content_hash string, unit_number int, span_index int, text string, x0 double, y0 double, x1 double, y1 double"


def page(name, *lines):
    """Spans of a page from lines of (y, [(x, text), ...])."""
    out, i = [], 0
    for y, cells in lines:
        for x, text in cells:
            out.append((name, 1, i, text, float(x), float(y), float(x + 8 * len(text)), float(y + 10)))
            i += 1
    return out


def lab_line(y, label, value, rest=None):
    return (y, [(10, label), (150, value), *([(230, rest)] if rest else [])])


PAGES = {
    "plain": [lab_line(60, "Hemoglobin", "13.5", "g/dL 12 - 16"), lab_line(90, "Urea", "30", "mg/dL")],
    "crossed": [lab_line(60, "Hemoglobin", "13.5", "g/dL"), lab_line(90, "Ferritin", "12", "ng/mL")],
    "reference": [lab_line(60, "Ferritin", "150", "ug/L 12 - 150"), lab_line(90, "CRP", "<5", "mg/L"), lab_line(120, "Base excess", "−5", "mmol/L"), lab_line(150, "Urate", "<=5.5", "mg/dL")],
    "header": [(20, [(10, "Results in mmol/L, serum")]), (60, [(10, "Glucose"), (150, "5.1")]), (90, [(10, "Sodium"), (150, "140"), (230, "mg/dL")])],
    "prose": [(60, [(10, "the ferritin of the patient was found to be 12 last year in total")])],
    "words": [lab_line(60, "Nitrite", "negative", "reference negative"), lab_line(90, "Ketones", "seen reference: negative")],
    "stop": [lab_line(60, "Ferritin", "186.", "ug/L")],
    "alias": [lab_line(60, "Ferritin", "171", "ugn")],
    "other_row": [lab_line(60, "Iron", "7", "mg/dL"), lab_line(90, "Zinc", "8")],
}
CLAIMS = [
    ("plain", "hemoglobin", "13,5", "g/dl", None, "verified", ()),
    ("plain", "Hemoglobin", "30", None, None, "conflicting", ("ANALYTE_ASSIGNMENT_DISAGREES",)),
    ("plain", "hemoglobin", "12", None, None, "unverified reading", ("VALUE_NOT_AT_RESULT",)),
    ("plain", "iron", "7", None, None, "unverified reading", ("ASSOCIATION_NOT_LOCATED",)),
    ("plain", "", "7", None, None, "unverified reading", ("NOT_LOCATED",)),
    ("plain", None, None, None, None, "unverified reading", ("NOT_LOCATED",)),
    ("nowhere", "urea", "30", None, None, "unverified reading", ("NOT_LOCATED",)),
    ("plain", "urea", "30", "mg/dl", "blood", "verified", ("SPECIMEN_NOT_LOCATED",)),
    ("plain", "urea", "30", "mmol/l", None, "unverified reading", ("UNIT_NOT_LOCATED",)),
    ("crossed", "Ferritin", "13.5", None, None, "conflicting", ("ANALYTE_ASSIGNMENT_DISAGREES",)),
    ("reference", "Ferritin", "12 - 150", None, None, "unverified reading", ("VALUE_NOT_AT_RESULT",)),
    ("reference", "CRP", "5", None, None, "unverified reading", ("VALUE_NOT_AT_RESULT",)),
    ("reference", "CRP", "< 5", "mg/L", None, "verified", ()),
    ("reference", "Base excess", "-5", None, None, "verified", ()),
    ("reference", "Base excess", "5", None, None, "unverified reading", ("VALUE_NOT_AT_RESULT",)),
    ("reference", "Urate", "<=5.5", None, None, "verified", ()),
    ("reference", "Urate", "<5.5", None, None, "unverified reading", ("ASSOCIATION_NOT_LOCATED",)),
    ("header", "Glucose", "5.1", "mmol/L", "serum", "verified", ()),
    ("header", "Sodium", "140", "mmol/L", None, "unverified reading", ("UNIT_NOT_LOCATED",)),
    ("prose", "ferritin", "12", None, None, "unverified reading", ("ASSOCIATION_NOT_LOCATED",)),
    ("words", "Nitrite", "negative", None, None, "verified", ()),
    ("words", "Ketones", "negative", None, None, "unverified reading", ("VALUE_NOT_AT_RESULT",)),
    ("stop", "Ferritin", "186", "ug/L", None, "verified", ()),
    ("alias", "Ferritin", "171", "ug/L", None, "verified", ()),
    ("other_row", "Iron", "8", "mg/dL", None, "unverified reading", ("ASSOCIATION_NOT_LOCATED",)),
]


@pytest.fixture(scope="module")
def rows(spark):
    spans = [s for name, lines in PAGES.items() for s in page(name, *lines)]
    return grounding.page_rows(spark.createDataFrame(spans, SPANS))


def test_grounding_of_claims(spark, rows):
    labs = spark.createDataFrame([(i, p, 1, *c) for i, (p, *c, _, _) in enumerate(CLAIMS)], "fact_id long, content_hash string, unit_number int, raw_label string, raw_value string, unit string, specimen string")
    got = {r.fact_id: r for r in grounding.ground_labs(labs.union(labs.limit(3)), rows).distinct().collect()}
    assert {i: (r.grounding, tuple(r.notes)) for i, r in got.items()} == {i: (c[-2], c[-1]) for i, c in enumerate(CLAIMS)}
    assert got[0].evidence == [0, 1, 2] and got[1].alternative_label == "urea" and got[1].alternative_evidence == [3, 4] and got[17].evidence == [0, 1, 2]


ROWS = [
    ("glucose 5.1 mmol/l", True), ("ferritin 186. ug/l", True), ("12 glucose", False), ("glucose", False), ("glucose 5.1 4.0 - 6.0", True), ("pain in 5.1 4 - 6", False),
    ("call me 555-555-0100 4 - 6", False), ("ab 5 mg/l", False), ("your result 5.1 test status normal 4 - 6 reference range", True), ("x" * 130 + " 5 mg/l", False), ("", False), (None, False),
    ("glucose 4 - 6 mg/dl", False), ("a row of fifty letters and more before an interval comes 7 4 - 6", False),
]


def test_result_rows(spark):
    df = spark.createDataFrame(ROWS, "t string, w boolean")
    assert [(r.t, r.g) for r in df.select("t", R.is_result_row(F.col("t")).alias("g")).collect()] == ROWS


WORDINGS = [
    ("Referral for a consultation in cardiology.", ["referral"]), ("Consultation in urology was recommended.", ["other"]), ("No consultation took place.", []), ("Consultation. It was cancelled.", []),
    ("Consultation held. Patient denied pain, not examined.", []), ("Visit done. No fever.", ["encounter"]), ("Консультация состоялась. УЗИ сделано.", ["encounter", "result"]), ("Visit cancelled. Seen at a visit later.", ["encounter"]),
    ("Booked a visit; surgery planned.", ["appointment_scheduled"]), ("", []), (None, []), ("не состоялась консультация", []), ("запись на приём", ["appointment_scheduled"]),
]


def test_wording_types(spark):
    df = spark.createDataFrame([(a,) for a, _ in WORDINGS], "w string")
    assert [(r.w, r.t) for r in df.select("w", R.wording_types(F.col("w")).alias("t")).collect()] == WORDINGS


DATED = {
    "collected": [(20, [(10, "Collected 12.03.2024")]), lab_line(60, "Ferritin", "12", "ng/mL")],
    "both": [(20, [(10, "Collected 12.03.2024 reported 14.03.2024")])],
    "born": [(20, [(10, "Specimen, date of birth 01.02.1980")])],
    "columns": [(20, [(10, "Collected"), (300, "Reported")]), (40, [(10, "12.03.2024"), (300, "14.03.2024")])],
    "caption": [(20, [(10, "Specimen drawn")]), (40, [(10, "12.03.2024")])],
    "printed": [(20, [(10, "Specimen drawn")]), (40, [(10, "Printed: 12.03.2024")])],
    "other": [(20, [(10, "Collected 01.01.2024")]), (40, [(10, "12.03.2024")])],
    "split": [(20, [(10, "Collected 12 March"), (200, "2024")])],
    "twice": [(20, [(10, "12 March 2024")]), (40, [(10, "March 12, 2024")])],
}
DATES = [
    ("collected", "12.03.2024", "specimen", True, True), ("collected", "12.03.2024", "report", True, False), ("collected", "12.03.2024", "event", True, False), ("collected", "13.03.2024", "specimen", False, False),
    ("both", "14.03.2024", "report", True, True), ("both", "14.03.2024", "specimen", True, False), ("born", "01.02.1980", "specimen", True, False), ("born", "01.02.1980", "unspecified", True, False),
    ("columns", "12.03.2024", "specimen", True, True), ("columns", "14.03.2024", "report", True, True), ("columns", "14.03.2024", "specimen", True, False), ("caption", "12.03.2024", "specimen", True, True),
    ("printed", "12.03.2024", "specimen", True, False), ("other", "12.03.2024", "specimen", True, False), ("other", "12.03.2024", "unspecified", True, True), ("other", "12.03.2024", "event", True, True),
    ("collected", "2024-03-12", "specimen", True, False), ("split", "12.03.2024", "unspecified", True, True), ("twice", "12.03.2024", "unspecified", False, False), ("collected", None, "specimen", False, False), ("collected", "12.03.2024", None, True, False),
]


def test_dates_are_located_and_their_roles_judged(spark):
    rows = grounding.page_rows(spark.createDataFrame([s for n, lines in DATED.items() for s in page(n, *lines)], SPANS))
    claims = spark.createDataFrame([(i, p, 1, raw, role, False) for i, (p, raw, role, *_) in enumerate(DATES)], "date_id long, content_hash string, unit_number int, raw string, date_role string, planned boolean")
    got = {r.date_id: (r.located, r.role_supported) for r in grounding.reported_dates(claims, rows).collect()}
    assert got == {i: tuple(d[3:]) for i, d in enumerate(DATES)}


def test_lab_facts_with_dates_paths_and_flags(spark):
    spans = [s for n, lines in {
        "a": [(20, [(10, "Collected 12.03.2024")]), lab_line(60, "Ferritin", "12", "ng/mL 10 - 30 L")],
        "b": [lab_line(60, "Ferritin", "171", "ug/L")],
        "c": [(20, [(10, "Specimen collected: 05/04/2023")]), lab_line(80, "Ferritin", "186", "ug/L")],
    }.items() for s in page(n, *lines)]
    rows = grounding.page_rows(spark.createDataFrame(spans, SPANS))
    labs = [(1, "a", "Ferritin", "12", "ng/mL", "10 - 30", "L", None), (2, "a", "Ferritin", "12", "ng/mL", "10 - 99", "H", "serum"), (3, "b", "FERRITIN", "171", "ug/L", None, None, None), (4, "c", "Ferritin", "186", "ug/L", None, None, None)]
    df = spark.createDataFrame([(i, h, 1, *rest) for i, h, *rest in labs], "fact_id long, content_hash string, unit_number int, raw_label string, raw_value string, unit string, reference_interval string, flag string, specimen string")
    claims = spark.createDataFrame([(1, "a", 1, "12.03.2024", "specimen", False), (2, "c", 1, "05/04/2023", "specimen", False)], "date_id long, content_hash string, unit_number int, raw string, date_role string, planned boolean")
    paths = spark.createDataFrame([("a", "2025-12-08bw.jpg"), ("b", "2025-12-08bw.jpg"), ("b", "x/scan.jpg"), ("c", "2023-04-05.pdf")], "content_hash string, relative_path string")
    facts = grounding.interpret_labs(df, grounding.reported_dates(claims, rows), rows, paths)
    got = {r.fact_id: r for r in facts.withColumn("d", D.format_alternatives(F.col("timeline.alternatives"))).collect()}
    assert (got[1].verification, got[1].d, got[1].timeline.role, got[1].notes, got[1].flag) == ("verified", "2024-03-12", "specimen", [], "L")
    assert (got[2].verification, got[2].reference_interval, got[2].flag, got[2].specimen) == ("unverified reading", None, None, None)
    assert got[2].notes == ["SPECIMEN_NOT_LOCATED", "REFERENCE_NOT_LOCATED", "FLAG_NOT_LOCATED"]
    assert (got[3].verification, got[3].d, got[3].timeline.role, got[3].notes) == ("verified", "2025-12-08", "filename", ["FILENAME_DATE_INFERRED"])
    assert (got[4].d, got[4].notes) == ("2023-04-05 or 2023-05-04", ["FILENAME_DATE_ALIGNED"])
    left = grounding.uncovered_rows(rows, facts.where("fact_id = 1").select(F.lit("a").alias("content_hash"), F.lit(1).alias("unit_number"), "evidence"))
    assert sorted(r.content_hash for r in left.collect()) == ["b", "c"]
    assert {r.hint for r in grounding.row_hints(rows, df.select("content_hash", "unit_number", F.array(F.lit(99)).alias("evidence")).limit(1)).collect()} == {"ferritin 12 ng/ml 10 - 30 l", "ferritin 171 ug/l", "ferritin 186 ug/l"}


def test_events(spark):
    spans = [s for n, lines in {
        "a": [(20, [(10, "Cardiology")]), (32, [(10, "Referral for assessment on 05.04.2024")])],
        "b": [(20, [(10, "Cardiology")]), (400, [(10, "Referral for assessment")])],
        "c": [(20, [(10, "Urology: consultation was not held")])],
        "d": [(20, [(10, "Urology: surgery on 05.04.2024")])],
    }.items() for s in page(n, *lines)]
    rows = grounding.page_rows(spark.createDataFrame(spans, SPANS))
    events = [(1, "a", "Cardiology", "Referral for assessment", "referral", "referral"), (2, "b", "Cardiology", "Referral for assessment", "referral", "referral"), (3, "c", "Urology", "consultation was", "encounter", "visit_note"), (4, "d", "Urology", "surgery", "encounter", None), (5, "d", "Urology", "seen", "encounter", None), (6, "d", None, None, None, None)]
    df = spark.createDataFrame([(i, h, 1, *rest) for i, h, *rest in events], "fact_id long, content_hash string, unit_number int, raw_specialty string, wording string, event_type string, document_class string")
    claims = spark.createDataFrame([(1, "a", 1, "05.04.2024", "event", False), (2, "d", 1, "05.04.2024", "event", False)], "date_id long, content_hash string, unit_number int, raw string, date_role string, planned boolean")
    facts = grounding.interpret_events(df, grounding.reported_dates(claims, rows), rows)
    got = {r.fact_id: r for r in facts.withColumn("d", D.format_alternatives(F.col("timeline.alternatives"))).collect()}
    assert sorted(got) == [1, 2, 4]
    assert (got[1].verification, got[1].strength, got[1].d, got[1].notes, got[1].evidence) == ("verified", "direct", "2024-04-05", [], [0, 1])
    assert (got[2].verification, got[2].notes) == ("unverified reading", ["EVENT_NOT_GROUNDED"])
    assert (got[4].verification, got[4].alternative_event_type, got[4].notes) == ("conflicting", "procedure", ["EVENT_TYPE_DISAGREES"])


def test_sweep(spark):
    spans = page("a", (20, [(10, "white blood"), (150, "cell count was normal")]), (60, [(10, "nothing here")]), (80, [(10, "ends in white")]), (100, [(10, "blood cell count")])) + page("b", (20, [(10, "white blood cell count 5")]))
    df = spark.createDataFrame([*spans, ("c", None, 0, "white blood cell count", 1.0, 1.0, 2.0, 2.0)], SPANS)
    facts = spark.createDataFrame([("b", 1, [0])], "content_hash string, unit_number int, evidence array<int>")
    got = {r.content_hash: r for r in history.sweep(df, facts, ["white blood cell count", ""]).collect() if r.unit_number}
    assert set(got) == {"a"} and got["a"].mentions == 5 and got["a"].example.startswith("ends in white blood cell count")
    assert history.sweep(df, facts, []).collect() == []
    many = [" ".join(f"w{i}" for i in range(n)) for n in range(1, 20)]
    text = spark.createDataFrame(page("p", (20, [(10, many[-1])])), SPANS)
    assert layout.mentions(layout.cluster_rows(text).select("content_hash", "unit_number", F.split("text", " ").alias("stems")), many).count() == 19


def test_display_and_coverage_texts(spark):
    one = spark.createDataFrame([(["b/x.pdf", "c.pdf"], "pdf", 2), ([], "jpeg", 1), (["y.jpg"], "jpeg", None)], "p array<string>, f string, u int")
    assert [r.s for r in one.select(coverage.source_text(F.col("p"), F.col("f"), F.col("u")).alias("s")).collect()] == ["b/x.pdf page 2 (+1 identical copies)", "unknown source image", "y.jpg"]
    status = spark.createDataFrame([("inflected",), ("mapped",), (None,)], "s string")
    assert [r.t is None for r in status.select(coverage.terminology_reason(F.col("s")).alias("t")).collect()] == [False, True, True]
    day = date(2020, 1, 2)
    dates = [("specimen", "02.01.2020", False, True, False, [(day, day, "day")]), ("report", "x", True, True, True, [(day, day, "day")])]
    df = spark.createDataFrame([(dates, ["DATE_ROLE_UNSUPPORTED"]), (dates, [])], f"d array<struct<role:string,raw:string,planned:boolean,located:boolean,role_supported:boolean,alternatives:{D.PERIOD}>>, notes array<string>")
    got = df.select(coverage.other_dates(F.col("d"), F.lit(None)).alias("o"), coverage.unconfirmed_date(F.col("d"), F.col("notes"), F.array()).alias("u")).collect()
    assert got[0].o == "specimen (unsupported): 02.01.2020; report (planned): x" and got[0].u.raw == "02.01.2020" and got[1].u is None
    scans = spark.createDataFrame([("g1", "scan", "active", 1, 2), ("g2", "scan", "staged", 3, 4), ("g3", "scan", "staged", 5, None), ("g0", "scan", "staged", 0, 1)], "generation_id string, kind string, state string, started_at long, finished_at long")
    assert [r.generation_id for r in history.newer_staged(scans, "g1").collect()] == ["g2"]
