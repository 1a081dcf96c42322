"""Units, labels, spikes and chunking against literals and brute force."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest

from spanline.functions.labels import LabelIndex, edits, resolve_labels
from spanline.functions.units import factor, read_interval, read_unit, read_value
from spanline.operators import grouped, spikes, units

FACTORS = [
    ("mmol/L", "mg/dL", 180.16, 18.016), ("мкмоль/л", "mg/dL", 113.12, 0.011312), ("g·L-1", "g/dL", None, 0.1), ("mg / 100 mL", "mg/dL", None, 1.0), ("mg%", "mg/dL", None, 1.0),
    ("ukat/L", "U/L", None, 60.0), ("L/L", "%", None, 100.0), ("10⁹/L", "10^9/L", None, 1.0), ("/mm3", "10^9/L", None, 0.001), ("тыс/мкл", "10^9/L", None, 1.0), ("uIU/mL", "mIU/L", None, 1.0),
    ("МЕ/л", "mIU/L", None, 1000.0), ("mM", "mmol/L", None, 1.0), ("pM", "pg/mL", 1355.4, 1.3554), ("per microliter", "10^9/L", None, 0.001), ("grams/liter", "g/dL", None, 0.1), ("g/dL", "mmol/L", None, None),
]


@pytest.mark.parametrize(("unit", "common", "mass", "expected"), FACTORS)
def test_factors(unit, common, mass, expected):
    found = factor(read_unit(unit), read_unit(common), mass)
    assert found == expected if expected is None else found == pytest.approx(expected)


def test_reading_values_and_intervals():
    assert read_value("<= 13,5  mg/dL") == (13.5, "mg/dL")
    assert read_value("233 627") == (233627.0, None)
    assert read_value("pending") == (None, None) == read_value(None)
    assert read_interval("0.42 to 0.90 mg/dl") == (0.42, 0.90, "mg/dl")
    assert read_interval("159–306") == (159.0, 306.0, None)


def test_labels():
    index = LabelIndex([("G", "glucose"), ("G", "blood sugar"), ("T", "tsh"), ("R", "глюкоза"), ("V", "vitamin b12")])
    for label in ("GLUCOSE *", "gluc ose", "sugar, blood", "Ｇｌｕｃｏｓｅ", "glucsoe", "P-glucose", "glucо​se (serum)", "blood s."):
        assert index.match(label) == "G", label
    assert index.match("rack barcode 7") is None and index.match("") is None and index.match(None) is None
    assert edits("abcd", "abdc", 2) == 1 and edits("abc", "xyz", 2) == 3


def test_viterbi_against_all_paths():
    r = np.random.default_rng(1)
    emit = r.normal(0, 1, (6, 3))
    keep, move = math.log(0.8), math.log(0.1)
    best = max((sum(emit[t, s] for t, s in enumerate(p)) + sum(keep if a == b else move for a, b in zip(p, p[1:])), p) for p in np.ndindex(*(3,) * 6))
    assert tuple(units.viterbi(emit, 0.8)) == best[1]


FACT = (
    "fact_id long, content_hash string, unit_number int, source_id string, raw_label string, raw_value string, value_number double, unit string, "
    "reference_interval string, alternatives array<struct<start_date:date,end_date:date,date_precision:string>>, verification string"
)


def fact(i, value, unit=None, interval=None, day=0, source="s", label="glucose"):
    at = date(2020, 1, 1) + timedelta(day)
    return (i, f"c{i}", 1, source, label, value, None, unit, interval, [(at, at, "day")], "verified")


@pytest.fixture(scope="module")
def lists(spark):
    concepts = spark.createDataFrame([("G", "analyte", "glucose", "mg/dL", 180.16)], "concept_id string, kind string, concept_name string, common_unit string, molar_mass double")
    terms = spark.createDataFrame([("G", "analyte", "en", "glucose")], "concept_id string, kind string, lang string, term_label string")
    return concepts, terms


def test_unit_rules(spark, lists):
    rows = [fact(i, "5.0", "mmol/L", "4 - 6", i) for i in range(20)] + [fact(i, "90", "mg/dl", "72 - 108", i) for i in range(20, 40)]
    rows += [fact(50, "5.1", None, "4 - 6", 41), fact(51, "91", None, "72 - 108", 42), fact(52, "5.1", None, None, 43), fact(53, "5.1 mmol/l", None, "72 - 108", 44), fact(54, "5.2", None, "4 - 6 mmol/L", 45), fact(55, "95", "mg/dL", "4 - 6 mmol/l", 46), fact(56, "n/a", "mmol/L"), fact(57, "5", "mmol/L", label="unknown")]
    out = {r.fact_id: r for r in units.normalise_units(spark.createDataFrame(rows, FACT), *lists).collect()}
    assert out[50].number_changes and out[50].unit_basis == "scale" and out[50].value_common == pytest.approx(91.88, abs=0.01)
    assert not out[51].number_changes and not out[52].number_changes and out[52].unit_basis == "common"
    assert out[53].number_changes and out[53].unit_basis == "raw_value"
    assert out[54].number_changes and out[54].unit_basis == "interval"
    assert not out[55].number_changes and out[55].low_common == pytest.approx(72.06, abs=0.01)
    assert not out[56].number_changes and 57 not in out
    bare = {r.fact_id: r for r in units.normalise_units(spark.createDataFrame(rows, FACT), *lists, infer_bare=True).collect()}
    assert bare[52].number_changes


def test_implausible_with_and_without_small_chunks(spark, lists, monkeypatch):
    r = random.Random(3)
    values = [f"{90 + r.gauss(0, 3):.1f}" for _ in range(300)]
    values[40], values[41], values[120], values[121] = "300.0", "290.0", "0", "9999"
    values[200:206] = ["92.2"] * 6
    values[250:254] = ["88.8"] * 4
    rows = [fact(i, v, "mg/dL", None, i) for i, v in enumerate(values)]
    again = (1000, *rows[40][1:])
    df = spark.createDataFrame([*rows, again], FACT)
    expected = {40, 41, 120, 121, 1000, *range(200, 206)}
    assert {x.fact_id for x in spikes.implausible(df, *lists).collect()} == expected
    monkeypatch.setattr(spikes, "CHUNK", 37)
    monkeypatch.setattr(units, "CHUNK", 37)
    monkeypatch.setattr(units, "HALO", 40)
    assert {x.fact_id for x in spikes.implausible(df, *lists).collect()} == expected


@pytest.mark.parametrize("n", range(3, 13))
def test_spikes_in_short_series(n):
    r = np.random.default_rng(n)
    for at in range(n):
        series = r.normal(0, 0.04, n)
        series[at] = math.log(10)
        assert np.flatnonzero(spikes.spikes(series, 0.04)).tolist() == [at]
    assert not spikes.spikes(r.normal(0, 0.02, n), 0.04).any() and not spikes.spikes(np.array([0.0, 2.0]), 0.04).any()


def drifting(seed=1, n=400):
    """A series whose level moves by a factor of twenty, with seven spikes that
    stay inside the range of the whole."""
    r = np.random.default_rng(seed)
    series = np.linspace(0, 3, n) + 0.4 * np.sin(np.arange(n) / 20) + r.normal(0, 0.04, n)
    at = [10, 50, 51, 120, 200, 300, 390]
    series[at] += [1, 1.2, 1.1, -1, 0.8, -0.9, 1]
    return series, at


def test_the_wavelet_finds_what_the_range_does_not(monkeypatch):
    series, at = drifting()
    q = np.quantile(series, [0.25, 0.5, 0.75])
    assert np.flatnonzero(spikes.spikes(series, (q[2] - q[0]) / 1.349)).tolist() == at
    off = np.abs(series - q[1])
    assert not (off > spikes.DETAIL_LIMIT * 1.4826 * np.median(off)).any()
    # without the decomposition nothing is found
    monkeypatch.setattr(spikes, "details", lambda series, known=None, levels=3: [np.zeros(len(series))])
    assert not spikes.spikes(series, (q[2] - q[0]) / 1.349).any()


def test_details_add_up_and_skip_unknown_places():
    series, at = drifting(4)
    known = np.ones(len(series), dtype=bool)
    known[at] = False
    rest = sum(spikes.details(series, known))
    assert np.abs(rest[known]).max() < 0.3 and np.abs(rest[at]).min() > 0.6
    impulse = np.zeros(65)
    impulse[32] = 1.0
    smooth = impulse - sum(spikes.details(impulse))
    assert smooth.sum() == pytest.approx(1.0) and smooth.argmax() == 32


def switching(seed, interval, n=300):
    """One device's numbers without units: the level drifts ninefold, the unit
    changes four times, by a factor of eighteen."""
    r = np.random.default_rng(seed)
    level = math.log(90) + np.linspace(0, 2.2, n) + 0.3 * np.sin(np.arange(n) / 25)
    other = math.log(18.016)
    state = np.where((np.arange(n) // 60) % 2 == 1, other, 0.0)
    value = np.exp(level + r.normal(0, 0.08, n) - state)
    none = np.full(n, np.nan)
    factors = np.empty(n, dtype=object)
    for i in range(n):
        factors[i] = [0.0, other]
    rows = {
        "factors": factors, "stated": np.where(np.arange(n) < 5, np.exp(state), np.nan), "value": value, "interval_stated": none, "low": value / 1.2 if interval else none,
        "high": value * 1.2 if interval else none, "level": np.full(n, math.log(90)), "basis": np.array([None] * n, dtype=object), "own": np.ones(n, dtype=bool),
    } | {c: np.arange(n) for c in ("fact_id", "source_id", "concept_id", "day", "exact_day", "delivery")}
    return rows, state


@pytest.mark.parametrize("interval", [False, True])
def test_viterbi_decodes_unit_switches_that_single_rows_do_not(monkeypatch, interval):
    for seed in range(4):
        rows, state = switching(seed, interval)
        assert np.abs(np.log(units.decode(rows, infer_bare=not interval)["unit_factor"]) - state).max() < 1e-6
    lost = 0
    monkeypatch.setattr(units, "viterbi", lambda emit, stay=0.9, jumps=None: emit.argmax(axis=1))
    for seed in range(4):
        rows, state = switching(seed, interval)
        lost += int((np.abs(np.log(units.decode(rows, infer_bare=not interval)["unit_factor"]) - state) > 1e-6).sum())
    assert lost > 20


def test_viterbi_with_jumps_against_all_paths():
    r = np.random.default_rng(2)
    emit, jumps = r.normal(0, 1, (5, 3)), r.normal(0, 1, (5, 3, 3))
    keep, move = math.log(0.8), math.log(0.1)
    best = max((sum(emit[t, s] for t, s in enumerate(p)) + sum((keep if p[t - 1] == p[t] else move) + jumps[t, p[t - 1], p[t]] for t in range(1, 5)), p) for p in np.ndindex(*(3,) * 5))
    assert tuple(units.viterbi(emit, 0.8, jumps)) == best[1]


def test_a_hot_day_is_cut_exactly(spark):
    from pyspark.sql import functions as F

    df = spark.range(60_000).select(F.lit("a").alias("k"), F.lit(None).cast("date").alias("d"), (F.col("id") * 7).alias("i"))
    df = df.union(spark.range(20_000).select(F.lit("a"), F.expr("date_add(date'2020-01-01', cast(id / 3 as int))"), F.col("id") + 1_000_000)).union(spark.range(300).select(F.lit(None).cast("string"), F.lit(None).cast("date"), F.col("id") + 5_000_000))
    out = grouped.chunked(df, ["k"], "d", "i", 4096, halo=24)
    sizes = out.groupBy("k", "chunk").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("own"), F.min(F.when(F.col("own"), F.col("i"))).alias("lo"), F.max(F.when(F.col("own"), F.col("i"))).alias("hi")).orderBy("k", "chunk").collect()
    assert max(r.n for r in sizes) <= 4096 + 48 and sum(r.own for r in sizes) == 80_300
    of_a = [r for r in sizes if r.k]
    assert all(r.own == 4096 for r in of_a[:-1]) and all(a.hi < b.lo for a, b in zip(of_a, of_a[1:])) and all(r.n - r.own in (24, 48) for r in of_a)


def test_chunks_have_exact_context(spark):
    rows = [("x", date(2020, 1, 1) + timedelta(i // 4), i) for i in range(50)]
    out = grouped.chunked(spark.createDataFrame(rows, "k string, d date, i int"), ["k"], "d", "i", 10, halo=13).collect()
    for c in range(5):
        assert sorted(r.i for r in out if r.chunk == c) == list(range(max(0, c * 10 - 13), min(50, c * 10 + 23)))
        assert sorted(r.i for r in out if r.chunk == c and r.own) == list(range(c * 10, c * 10 + 10))


def test_chunks_bound_groups_and_keep_rows(spark):
    rows = [("hot", date(2020, 1, 1) + timedelta(i // 3), i) for i in range(1000)] + [("hot", None, -1), (None, date(2020, 1, 1), -2)] + [("day", date(2021, 1, 1), 5000 + i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, d date, i int")
    out = grouped.chunked(df, ["k"], "d", "i", 100, halo=5)
    own = out.where("own")
    assert own.count() == len(rows) and own.select("i").distinct().count() == len(rows)
    assert own.groupBy("k", "chunk").count().agg({"count": "max"}).first()[0] <= 100
    assert out.where("not own").count() > 0


def test_resolve_labels_keeps_rows(spark, lists):
    df = spark.createDataFrame([("glucose", 1), ("GLUCOSE", 2), (None, 3), ("x", 4), ("glucose", 1)], "l string, i int")
    out = resolve_labels(df, "l", lists[1], "analyte")
    assert sorted((r.i, r.concept_id) for r in out.collect()) == [(1, "G"), (1, "G"), (2, "G"), (3, None), (4, None)]
