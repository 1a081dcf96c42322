"""Dates, moments and values against literal tables and brute force."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanline.errors import EngineError
from spanline.functions import dates as D
from spanline.functions.moments import read_moment
from spanline.operators.timestamps import extend_dictionary, normalise_moments, same_moments
from spanline.plans import catalogue
from spanline.session import run_folder

MOMENTS = [
    ("2018-07-05T23:37:19", "America/Chicago", ("minute", "2018-07-06T04:37Z")),
    ("20150607T104802Z", None, ("minute", "2015-06-07T10:48Z")),
    ("Fri, 10 Feb 2017 13:32:32 +0200", None, ("minute", "2017-02-10T11:32Z")),
    ("April 10, 2019 1:38 PM EDT", "Asia/Tokyo", ("minute", "2019-04-10T17:38Z")),
    ("31.10.2021 03:36 UTC+2", None, ("minute", "2021-10-31T01:36Z")),
    ("10 березня 2017 р. о 21:21", "Europe/Athens", ("minute", "2017-03-10T19:21Z")),
    ("1433970188", None, ("minute", "2015-06-10T21:03Z")),
    ("1425801383241", None, ("minute", "2015-03-08T07:56Z")),
    ("201507012158", "Asia/Tokyo", ("minute", "2015-07-01T12:58Z")),
    ("20150610", None, ("day", "2015-06-10")),
    ("01.03.19", None, ("day", "2019-03-01")),
    ("03/17/2021", None, ("day", "2021-03-17")),
    ("04/04/2021", None, ("day", "2021-04-04")),
    ("29 Dezember 2024", None, ("day", "2024-12-29")),
    ("2 августа 2015 г.", None, ("day", "2015-08-02")),
    ("январь 2022", None, ("month", "2022-01")),
    ("12.2022", None, ("month", "2022-12")),
    ("2015 г.", None, ("year", "2015")),
    ("03/04/2021", None, ("unsettled", "two readings")),
    ("29.10.17 02:18", "Europe/Berlin", ("unsettled", "two readings")),
    ("2018-03-25 02:45", "Europe/Warsaw", ("unsettled", "no reading")),
    ("31.02.2021", None, ("unsettled", "no reading")),
    ("25:61", None, ("unsettled", "no reading")),
    ("2019-03-31 02:14", None, ("unsettled", "no zone")),
    ("", None, ("unsettled", "no reading")),
    (None, None, ("unsettled", "no reading")),
]


@pytest.mark.parametrize(("raw", "zone", "expected"), MOMENTS)
def test_read_moment(raw, zone, expected):
    assert read_moment(raw, zone) == expected


@settings(max_examples=200, deadline=None)
@given(st.datetimes(datetime(1990, 1, 1), datetime(2060, 1, 1)), st.integers(-12 * 4, 14 * 4))
def test_offsets_round_trip(at, quarters):
    minutes = quarters * 15
    sign = "+" if minutes >= 0 else "-"
    raw = f"{at:%Y-%m-%d %H:%M}{sign}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"
    assert read_moment(raw, None) == ("minute", (at - timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%MZ"))


def test_dictionary_grows_only_by_new_strings(spark, tmp_path):
    path = f"file:{tmp_path}/dictionary"
    schema = "date_id long, content_hash string, unit_number int, raw string, site_zone string"
    rows = [(1, "a", 1, "2020-01-02", None), (2, "a", 1, "02.01.2020", None), (3, "a", 1, "02.01.2020", None), (4, "b", 1, "2020-01-02", None), (5, "a", 1, None, None)]
    df = spark.createDataFrame(rows, schema)
    assert extend_dictionary(df, path).count() == 2
    assert extend_dictionary(df.union(spark.createDataFrame([(6, "c", 1, "May 2021", None)], schema)), path).count() == 3
    assert spark.read.parquet(path).count() == 3
    pairs = {tuple(r) for r in same_moments(normalise_moments(df, path)).collect()}
    assert pairs == {(1, 2), (1, 3)}


def test_the_kept_dictionary_parses_only_new_strings(spark, monkeypatch):
    from spanline.operators import timestamps

    monkeypatch.setattr(timestamps, "kept_folder", lambda s, label: f"{run_folder(s, 'kept')}")
    where = timestamps.kept_folder(spark, "moments")
    monkeypatch.setattr(timestamps, "kept_folder", lambda s, label: where)
    first = spark.createDataFrame([(1, "2020-01-02", None)], "date_id long, raw string, site_zone string")
    more = first.union(spark.createDataFrame([(2, "May 2021", None)], first.schema))
    for df in (first, more, more):
        assert normalise_moments(df).where("kind = 'unsettled'").count() == 0
    entries = spark.read.parquet(where)
    assert entries.count() == 2 and sorted(r["count"] for r in entries.groupBy("load").count().collect()) == [1, 1]


def test_pairs_against_brute_force(spark, data):
    claims = spark.read.parquet(f"{data}/date_claims.parquet")
    rows = [(r.date_id, r.content_hash, r.unit_number, r.raw, *read_moment(r.raw, r.site_zone)) for r in claims.collect()]
    expected = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1:3] == b[1:3] and a[3] != b[3] and a[4:] == b[4:] and a[4] != "unsettled"}
    assert {tuple(r) for r in same_moments(normalise_moments(claims)).collect()} == expected


def test_readings_of_all_claims(spark, data):
    claims = {r.date_id: r.raw for r in spark.read.parquet(f"{data}/date_claims.parquet").collect()}
    got = {r.date_id: r for r in catalogue.QUERIES["date_readings"](spark, data).collect()}
    assert {k: r.raw for k, r in got.items()} == claims
    seen = 0
    for k, raw in claims.items():
        m = re.fullmatch(r"(?P<y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)|(?P<d2>\d\d)\.(?P<m2>\d\d)\.(?P<y2>\d{4})", raw or "")
        if m:
            y, mo, d = (int(m[c] or m[c + "2"]) for c in "ymd")
            try:
                want = date(y, mo, d).isoformat()
            except ValueError:
                want = ""
            assert got[k].reading == want, raw
            seen += 1
    assert seen > 5 and len({r.reading for r in got.values()}) > 20


LITERALS = (
    ("12.03.2024", "2024-03-12"), ("2024-03-12", "2024-03-12"), ("25/03/2024", "2024-03-25"), ("03/25/2024", "2024-03-25"), ("03/04/2024", "2024-04-03 or 2024-03-04"), ("12-3-2024", "2024-03-12"),
    ("04/04/2024", "2024-04-04"), ("12 марта 2024", "2024-03-12"), ("March 12, 2024", "2024-03-12"), ("2 травня 2024", "2024-05-02"), ("05.2024", "2024-05"), ("травень 2024", "2024-05"),
    ("2024", "2024"), ("31.02.2024", ""), ("13/13/2024", ""), ("1.2.24", "2024-02-01"), ("seen 2024-07-01, 10:30", "2024-07-01"), ("2024 June 5", "2024-06-05"), ("soon", ""), ("", ""), (None, ""),
    ("12 березня 2024 р.", "2024-03-12"), ("12 March 2024", "2024-03-12"), ("02.2024", "2024-02"), ("Fe 5.1", ""), ("１２.０３.２０２４", "2024-03-12"), ("Mayor 2024", "2024"), ("mayor 5, 2024", ""),
    ("1.2.27", "2027-02-01"), ("1.2.28", "1928-02-01"), ("3rd June, 2020", "2020-06-03"), ("2024-13-01 05.2024", ""), ("5 of may 2020", "2020-05"), ("1899", ""), ("12.03.20245", ""), ("Mаrch 12, 2024", "2024-03-12"),
    ("10:30 may 2024", "2024-05-30"), ("12.03.2024 10:30", "2024-03-12"), ("2024, 10:30", "2024"), ("2024 10:30", ""),
)


def test_readings_of_literals(spark):
    df = spark.createDataFrame(LITERALS, "raw string, expected string")
    got = df.select("raw", "expected", D.format_alternatives(D.parse_date(F.col("raw"), 27)).alias("r")).collect()
    assert [(r.raw, r.r) for r in got] == [(r.raw, r.expected) for r in got]


def test_default_pivot_is_next_year(spark):
    year = date.today().year % 100
    df = spark.createDataFrame([(f"1.2.{year + 1:02d}",), (f"1.2.{year + 2:02d}",)], "raw string")
    assert [r.r for r in df.select(D.format_alternatives(D.parse_date(F.col("raw"))).alias("r")).collect()] == [f"20{year + 1:02d}-02-01", f"19{year + 2:02d}-02-01"]


PATHS = [("2025-12-08bw.jpg", "2025-12-08"), ("a/2011.07.23 15.31.53 004.jpg", "2011-07-23"), ("a/20240312.pdf", "2024-03-12"), ("march 2021/scan.pdf", "2021-03"), ("x/y.pdf", ""), ("2024.13.01 2024-02-03/z.pdf", "2024-02-03"), ("2015/scan_00024.PDF", "2015"), ("3/4/5.pdf", ""), (None, ""), ("", "")]


def test_dates_in_paths_and_their_consensus(spark):
    df = spark.createDataFrame(PATHS, "p string, expected string")
    got = df.select("p", "expected", D.format_alternatives(D.dates_in_path(F.col("p"))).alias("r")).collect()
    assert [(r.p, r.r) for r in got] == [(r.p, r.expected) for r in got]
    pairs = spark.createDataFrame([("a", "x/2020-01-02.pdf"), ("a", "y/none.pdf"), ("b", "2020-01-02.pdf"), ("b", "2020-01-03.pdf"), ("c", "n.pdf")], "k string, p string")
    assert [(r.k, r.d) for r in D.consensus(pairs, "k", "p").select("k", D.format_alternatives(F.col("alternatives")).alias("d")).collect()] == [("a", "2020-01-02")]


def test_classify_against_every_day(spark):
    window = D.DateRange(date(2020, 2, 1), date(2020, 3, 15))
    periods = [(date(2020, 1, 15), date(2020, 1, 15)), (date(2020, 2, 1), date(2020, 2, 29)), (date(2020, 3, 1), date(2020, 3, 31)), (date(2020, 1, 1), date(2020, 12, 31)), (date(2021, 1, 1), date(2021, 1, 31))]
    for a, b in periods:
        df = spark.createDataFrame([([(a, b, "day")],)], f"a {D.PERIOD}")
        inside = [window.start <= a + timedelta(i) <= window.end for i in range((b - a).days + 1)]
        want = "in range" if all(inside) else "may fall in range" if any(inside) else "out of range"
        assert df.select(D.classify(F.col("a"), window).alias("p")).first()["p"] == want
    none = spark.createDataFrame([([],), (None,)], f"a {D.PERIOD}")
    assert [r.p for r in none.select(D.classify(F.col("a"), window).alias("p")).collect()] == ["undated", "undated"]
    two = spark.createDataFrame([([(*periods[0], "day"), (*periods[1], "month")],)], f"a {D.PERIOD}")
    assert two.select(D.classify(F.col("a"), D.DateRange()).alias("p")).first()["p"] == "date uncertain"


def test_ranges():
    assert D.parse_range("2020-02", "2020-02") == D.DateRange(date(2020, 2, 1), date(2020, 2, 29))
    for bad in (("2021", "2020"), ("20", None), ("2020-13", None)):
        with pytest.raises(EngineError):
            D.parse_range(*bad)
