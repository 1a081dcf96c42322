"""Catalogue against DuckDB, layout, grounding, sources, store and streams."""

from __future__ import annotations

import math
import os
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from spanline import logs
from spanline.errors import EngineError
from spanline.functions import text as T
from spanline.functions import values as V
from spanline.operators import facts as X
from spanline.operators import layout, terms
from spanline.plans import catalogue
from spanline.render import safe, table
from spanline.sources import extract, files
from spanline.sources.store import Store
from spanline.streaming import ingest


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_catalogue_against_sql(spark, data, name):
    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    df = catalogue.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rel = con.sql(catalogue.SQL[name])
    assert sorted(rel.columns) == columns
    ours = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    theirs = [tuple(plain(dict(zip(rel.columns, r, strict=True))[c]) for c in columns) for r in rel.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(ours, key=key) == sorted(theirs, key=key)


CASES = [("13,5", "13.5"), ("Ёлка", "елка"), ("don’t", "don't"), ("a​b", "ab"), ("Гемоглoбин", "гемоглобин"), ("  A  b ", "a b"), ("STRASSE ß", "strasse ss"), ("", "")]


def test_normalise(spark):
    df = spark.createDataFrame([(a,) for a, _ in CASES] + [(None,)], "t string")
    assert [r.n for r in df.select(T.normalise(F.col("t")).alias("n")).collect()] == [b for _, b in CASES] + [None]


def test_tokens_stems_and_phrases(spark):
    one = spark.createDataFrame([("x",)], "x string")

    def value(c):
        return one.select(c.alias("v")).first()["v"]

    assert not value(T.contains_token(F.lit("113.5"), F.lit("13.5"))) and not value(T.contains_token(F.lit("5.1"), F.lit("5"))) and value(T.contains_token(F.lit("at 13.5 now"), F.lit("13.5")))
    assert value(T.stems(F.array(*[F.lit(w) for w in ("studies", "glass", "cells", "глюкозы", "цинк", "сечової")]))) == ["study", "glass", "cell", "глюкоз", "цинк", "сечов"]
    words = T.tokens(F.lit("c-reactive protein, high"))
    assert value(words) == ["c-reactive", "protein", "high"]
    assert value(T.contains_phrase(words, F.array(F.lit("protein"), F.lit("high")))) and not value(T.contains_phrase(words, F.array(F.lit("c-reactive"), F.lit("high")))) and not value(T.contains_phrase(words, F.array()))
    assert value(V.parse_value(F.lit("−5"))).number == -5 and value(V.parse_value(F.lit("negative"))).qualitative and value(V.parse_value(F.lit(">=2"))).comparator == ">="


def rows_by_hand(spans):
    """Row clustering in plain Python."""
    rows = []
    for i, x, y0, y1, t in sorted(spans, key=lambda s: ((s[2] + s[3]) / 2, s[1], s[0])):
        y, h = (y0 + y1) / 2, y1 - y0
        last = rows[-1] if rows else None
        if last and abs(y - sum(last["ys"]) / len(last["ys"])) <= 0.5 * max(last["h"], h):
            last["ys"].append(y)
            last["h"] = max(last["h"], h)
            last["m"].append((x, i, t))
        else:
            rows.append({"ys": [y], "h": h, "m": [(x, i, t)]})
    return [" ".join(t for *_, t in sorted(r["m"])) for r in rows]


def test_row_clusters_against_plain_python(spark):
    r = random.Random(2)
    pages = {(f"c{p}", 1): [(i, float(r.randrange(0, 300)), y := r.choice([10.0, 13.0, 16.0, 22.0, 40.0]) + r.random(), y + r.choice([8.0, 10.0, 14.0]), f"w{i}") for i in range(r.randrange(1, 15))] for p in range(30)}
    df = spark.createDataFrame([(c, u, i, t, x, y0, x + 9, y1) for (c, u), spans in pages.items() for i, x, y0, y1, t in spans], "content_hash string, unit_number int, span_index int, text string, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for row in layout.cluster_rows(df).orderBy("content_hash", "row").collect():
        got.setdefault((row.content_hash, row.unit_number), []).append(row.text)
    assert got == {k: rows_by_hand(v) for k, v in pages.items()}


def test_merge_words_and_windows(spark):
    words = spark.createDataFrame([(1, 1, 1, 10, 10, 20, 10, "free"), (1, 1, 1, 35, 10, 20, 10, "t4"), (1, 1, 1, 100, 10, 20, 10, "12.5"), (1, 1, 2, 10, 30, 20, 10, "x")], "block_num int, par_num int, line_num int, left int, top int, width int, height int, text string")
    assert [r.text for r in layout.merge_words(words).collect()] == ["free t4", "12.5", "x"]
    rows = spark.createDataFrame([("c", 1, i, t) for i, t in enumerate("abc")], "content_hash string, unit_number int, row int, text string")
    assert sorted(r.text for r in layout.row_windows(rows, "text").collect()) == ["a", "a b", "a b c", "b", "b c", "c"]


def test_latest_and_memo(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, s int, v string")
    assert {(r.k, r.v) for r in X.latest(df, ["k"], ["s"]).collect()} == {("a", "y"), ("b", "z")}
    store = Store(spark, str(tmp_path / "s"))
    calls = []

    def compute(d):
        calls.append(d.count())
        return d.withColumn("n", F.length("k"))

    assert store.memoise("memo", ["k"], df.select("k"), compute).count() == 3
    assert store.memoise("memo", ["k"], df.select("k"), compute).count() == 3 and calls == [2, 0]


def test_store_lifecycle(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(EngineError, match="NO_ACTIVE_GENERATION"):
        store.load("labs")
    rows = spark.createDataFrame([(1, "a")], "fact_id int, v string")
    for g in ("g1", "g2"):
        store.begin(g)
        store.save("labs", g, rows)
        store.move(g, "staged")
    findings = spark.createDataFrame([("fewer facts",)], "finding string")
    assert not store.activate("g1", findings) and store.active() is None
    assert store.activate("g1", findings, force=True) and store.load("labs").count() == 1
    assert store.activate("g2") and store.state_of("g1") == "superseded"
    assert store.prune() == ["g1"] and not os.path.exists(f"{store.root}/labs/generation_id=g1")
    with pytest.raises(EngineError, match="GENERATION_STATE_BLOCKED"):
        store.activate("g1")
    store.begin("g3")
    assert store.recover() == ["g3"] and store.state_of("g3") == "interrupted"
    assert store.decide("hgb", "A1", "accepted", "Hgb") == 2 and store.decide("hgb", "A1", "rejected", "other") == 3
    assert [(r.verdict, r.label) for r in store.decisions().collect()] == [("rejected", "Hgb")]
    assert store.reverse("hgb", "A1") and not store.reverse("hgb", "A1") and store.decisions().count() == 0
    with store.lock(), pytest.raises(EngineError, match="OPERATION_BUSY"), store.lock():
        pass
    with pytest.raises(EngineError, match="ERASE_PHRASE_MISMATCH"):
        store.erase("yes")
    store.erase()
    assert store.active() is None and store.revision() == 4
    store.erase("erase all")
    assert store.revision() == 1


def test_store_reading_and_finishing(spark, tmp_path):
    store = Store(spark, f"file:{tmp_path}/store")
    inv = spark.createDataFrame([("a.pdf", "file", "pdf", "ready", "h1", []), ("b.pdf", "file", "pdf", "ready", "h1", []), ("c.jpg", "file", "jpeg", "ready", "h2", []), ("d", "symlink", None, "skipped", None, [])], "relative_path string, kind string, file_format string, status string, content_hash string, warnings array<string>")
    reads = spark.createDataFrame([("h1", "pdf", "completed", 1), ("h9", "pdf", "completed", 1)], "content_hash string, file_format string, status string, page_count int")
    for g in ("g1", "g2"):
        store.begin(g)
        store.save_inventory(g, inv)
        assert store.load("contents", g).count() == 2 and store.record_reads(g, reads) == 1
    assert not store.finish_scan("g1") and store.state_of("g1") == "invalid"
    store.record_reads("g2", spark.createDataFrame([("h2", "jpeg", "partial", 1)], reads.schema))
    units = spark.createDataFrame([("h1", "pdf", 1, "completed", [("Hgb", 1.0), ("13", 9.0)], [("Hgb", "13")])], "content_hash string, file_format string, unit_number int, status string, spans array<struct<text:string,x0:double>>, labs array<struct<raw_label:string,raw_value:string>>")
    store.record_units("g2", units)
    assert store.finish_scan("g2") and [r.text for r in store.unit_spans("h1", "pdf", 1, generation="g2").collect()] == ["Hgb", "13"]
    assert [r.text for r in store.unit_spans("h1", "pdf", 1, [1], "g2").collect()] == ["13"] and store.load("labs", "g2").count() == 1 and not os.listdir(tmp_path / "store" / "_staging")
    with pytest.raises(EngineError, match="SOURCE_CHANGED"):
        store.activate("g2", now=inv.where("relative_path <> 'a.pdf'"), force=True)
    assert store.state_of("g2") == "invalid" and store.active() is None
    store.begin("g3", "inventory")
    store.save_inventory("g3", inv.where("kind = 'file'"), finish=True)
    assert store.revalidate("g3", inv.where("kind = 'file'")) is None and store.state_of("g3") == "staged"
    assert [r.relative_path for r in store.load_inventory("g3").collect()] == ["a.pdf", "b.pdf", "c.jpg"] and store.source_entries("g3").count() == 3
    # a crash after the log and before the pointer
    store.move("g3", "active")
    assert store.active() is None
    store.begin("g4")
    assert store.recover() == ["g4"] and store.active() == "g3"
    with store.lock(), pytest.raises(EngineError, match="OPERATION_BUSY"):
        Store(spark, f"file:{tmp_path}/store").begin("g5")


def test_store_dictionary_and_checks(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    seed = spark.createDataFrame([("A1", "analyte", "en", "Hemoglobin"), ("A2", "analyte", "en", "Urea")], "concept_id string, kind string, lang string, term_label string")
    assert store.sync_seed(seed, "d1") and not store.sync_seed(seed, "d1") and store.revision() == 1 and store.concept_exists("A1") and not store.concept_exists("A9")
    store.store_proposals("g", spark.createDataFrame([("Hgb B", "A1"), ("HGB b", "A1"), ("ur", "A2"), ("", "A2")], "label string, concept_id string"))
    store.decide("hgb b", "A1", "accepted", "Hgb B")
    assert sorted((r.key, r.label, r.verdict) for r in store.proposals("g").collect()) == [("hgb b", "HGB b", "accepted"), ("ur", "ur", None)]
    assert sorted((r.concept_id, r.key) for r in store.snapshot().collect()) == [("A1", "hemoglobin"), ("A1", "hgb b"), ("A2", "urea")]
    assert store.sync_seed(seed.limit(1), "d2") and store.revision() == 3
    store.record_check("h", "page 1", "correct", "x" * 3000, "r1")
    store.record_check("h", "page 2", "missed")
    with pytest.raises(EngineError, match="CHECK_INVALID"):
        store.record_check("h", "page 1", "correct")
    assert [(r.verdict, len(r.note)) for r in store.checks().collect()] == [("missed", 0), ("correct", 2000)] and {r.verdict: r.n for r in store.check_counts().collect()} == {"missed": 1, "correct": 1}


def test_scopes(spark):
    words = terms.dictionary(spark.createDataFrame([("A1", "analyte", "white cells"), ("A2", "analyte", "glucose"), ("S1", "specialty", "glucose")], "concept_id string, kind string, term_label string"))
    groups = spark.createDataFrame([("analyte", "sugar_panel", "A2", "sugars"), ("analyte", "sugar_panel", "A9", "sugars"), ("specialty", "sugar_panel", "S1", "x")], "kind string, name string, member string, group_term string")
    proposals = spark.createDataFrame([("dextrose", "A2")], "key string, concept_id string")
    scope = lambda t: terms.resolve(words, groups, "analyte", t, proposals)
    assert scope("glucose").concepts == ("A2",) and scope("Sugar-Panel").concepts == ("A2", "A9") and scope("Sugar-Panel").group == "sugar_panel" and scope("sugar").concepts == ("A2", "A9")
    assert scope("white-cell").concepts == ("A1",) and scope("dextrose").concepts == ("A2",) and scope("nothing").concepts == () and scope("nothing").phrases == ("nothing",)


class Reader:
    """Reads pages whose content is its own answer; the first reading drops a row."""

    version = "reader-1"

    def extract(self, content, hints):
        text = content.decode()
        if text == "bad":
            raise ValueError("unreadable")
        rows = [{"label": h, "value": "9"} for h in hints] or [{"label": text, "value": "5"}, {"label": "", "value": "1"}]
        return extract.as_json("lab_report", lab_rows=rows)


def test_pages_are_read_in_remembered_stages(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    pages = spark.createDataFrame([("h1", "pdf", 1, "r1", bytearray(b"Hgb")), ("h2", "pdf", 1, "r2", bytearray(b"bad"))], "content_hash string, file_format string, unit_number int, raster_hash string, content binary")
    for _ in range(2):
        read = extract.read_pages(pages, Reader(), store)
        got = {r.content_hash: r for r in read.collect()}
        assert [x.label for x in got["h1"].lab_rows] == ["Hgb", "Hgb"] and got["h1"].dropped == 1 and not got["h1"].failed and got["h2"].failed
    for t in ("memo_read", "memo_read_dropped_retry"):
        assert spark.read.parquet(f"{store.root}/{t}").count() == 1
    hints = spark.createDataFrame([("h1", 1, "Urea"), ("h1", 1, "Urea")], "content_hash string, unit_number int, hint string")
    more = {r.content_hash: r for r in extract.supplemented(read, pages, hints, Reader(), store).collect()}
    assert [x.label for x in more["h1"].lab_rows] == ["Hgb", "Hgb", "Urea"]


def test_resolutions_within_the_budget(spark):
    size = "array<struct<width:double,height:double>>"
    a4, poster = (595.0, 842.0), (5000.0, 5000.0)
    cases = [([a4] * 3, [150] * 3), ([a4] * 200, None), ([poster, a4], [72, 150]), ([(None, None)], [72]), ([], [])]
    got = [r.d for r in spark.createDataFrame([(c,) for c, _ in cases], f"p {size}").select(extract.page_dpi(F.col("p")).alias("d")).collect()]
    for (pages, want), dpi in zip(cases, got, strict=True):
        assert want is None or dpi == want
    # by hand: as fine as what is left allows
    used = 0
    for i, d in enumerate(got[1]):
        pixels = {k: math.ceil(595 * k / 72) * math.ceil(842 * k / 72) for k in extract.DPI_STEPS}
        fits = [k for k in extract.DPI_STEPS if pixels[k] * (200 - i) <= extract.MOST_PIXELS - used]
        assert d == (fits[0] if fits else 72)
        used += pixels[d]


def test_remembered_readings(spark):
    units = "array<struct<status:string,raster:string,warnings:array<string>>>"
    ok = [("completed", "r", ["OCR_REQUIRED"])]
    rows = [("completed", 1, ok, []), ("completed", 2, ok, []), ("failed", 1, ok, []), ("completed", 1, [("completed", None, [])], []), ("completed", 1, ok, ["STRANGE"]), ("partial", None, ok, [])]
    df = spark.createDataFrame(rows, f"s string, n int, u {units}, w array<string>")
    assert [r.e for r in df.select(extract.cache_eligible(F.col("s"), F.col("n"), F.col("u"), F.col("w")).alias("e")).collect()] == [True, False, False, False, False, False]
    wanted = spark.createDataFrame([("h1", "pdf", "c"), ("h2", "pdf", "c"), ("h3", "pdf", "x")], "content_hash string, file_format string, configuration_hash string")
    cache = spark.createDataFrame([("h1", "pdf", "c", "r1", {"a": "1", "b": "2"}), ("h2", "pdf", "c", "r2", {"a": "1"}), ("h3", "pdf", "c", "r3", {"a": "1"})], "content_hash string, file_format string, configuration_hash string, reference string, artifacts map<string,string>")
    now = spark.createDataFrame([("r1", "a", "1"), ("r1", "b", "2"), ("r2", "a", "9")], "reference string, name string, digest string")
    assert [r.reference for r in extract.verified_cache(wanted, cache, now).collect()] == ["r1"]


def test_log_lines():
    assert logs.line("scan", state="done now", facts=3, secret="x") == '{"event": "scan", "state": "done_now", "facts": 3}'
    with pytest.raises(ValueError):
        logs.line("other")


def test_folder_inventory(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PDF").write_bytes(b"1")
    (tmp_path / "a" / "y.txt").write_bytes(b"1")
    (tmp_path / "z.jpeg").write_bytes(b"2")
    (tmp_path / "link").symlink_to(tmp_path / "z.jpeg")
    out = {r.relative_path: r for r in files.inventory(spark, str(tmp_path), "g").collect()}
    assert {k: (r.kind, r.file_format, r.status) for k, r in out.items()} == {"a/x.PDF": ("file", "pdf", "ready"), "a/y.txt": ("file", None, "unsupported"), "z.jpeg": ("file", "jpeg", "ready"), "link": ("symlink", None, "skipped")}
    assert out["a/x.PDF"].content_hash == out["a/y.txt"].content_hash and len(out["z.jpeg"].content_hash) == 64 and out["link"].content_hash is None
    (tmp_path / "z.jpeg").chmod(0o644)
    deep = tmp_path / "deep"
    for _ in range(files.DEEPEST + 2):
        deep = deep / "d"
    deep.mkdir(parents=True)
    (deep / "lost.pdf").write_bytes(b"3")
    rows = files.list_folder(spark, str(tmp_path)).where("reason = 'DEPTH_LIMIT'").collect()
    assert len(rows) == 1 and rows[0].status == "failed"


def test_states_of_files(spark):
    state = "struct<device:long,inode:long,mode:long,size:long,modified:long,changed:long>"
    a = (1, 2, 3, 4, 5, 6)
    df = spark.createDataFrame([(a, a), (a, (1, 2, 3, 4, 9, 9)), (a, (1, 2, 3, 7, 9, 6)), (a, None)], f"b {state}, a {state}")
    changes = files.stat_changes(F.col("b"), F.col("a"))
    got = df.select(changes.alias("c"), files.identity_state(changes).alias("s")).collect()
    assert [(r.c, r.s) for r in got[:3]] == [([], None), (["modified", "changed"], "METADATA_TOUCHED"), (["size", "modified"], "SOURCE_CHANGED")] and got[3].s == "SOURCE_CHANGED"


def test_seed(spark, tmp_path):
    (tmp_path / "seed.json").write_text('{"concepts": [{"concept_id": "A1", "kind": "analyte", "terms": {"en": ["a", "b"], "ru": ["в"]}}], "groups": [{"name": "g", "kind": "analyte", "members": ["A1"]}]}')
    terms_, groups, digest = files.read_seed(spark, str(tmp_path / "seed.json"))
    assert sorted((r.lang, r.term_label) for r in terms_.collect()) == [("en", "a"), ("en", "b"), ("ru", "в")] and [tuple(r) for r in groups.collect()] == [("analyte", "g", "A1")] and len(digest) == 64


def test_words_and_claims(spark, tmp_path):
    tsv = tmp_path / "w.tsv"
    tsv.write_text("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t10\t10\t20\t10\t91\tHgb\n5\t1\t1\t1\t1\t2\t10\t10\t20\t10\t-1\tx\n4\t1\t1\t1\t1\t0\t1\t1\t1\t1\t90\ty\n5\t1\t1\t1\t1\t3\tbad\t10\t20\t10\t90\tz\n")
    assert [r.text for r in files.read_words(spark, str(tsv)).collect()] == ["Hgb"]
    page = '{"document_class":"lab_report","lab_rows":[{"label":"Hgb","value":"186."},{"label":"","value":"1"},{"label":"x","value":"n/a"}],"events":[{"wording":"seen"},{"wording":null}]}'
    out = files.parse_claims(spark.createDataFrame([(page,), ("no json",)], "j string"), "j").collect()
    assert [r.value for r in out[0].lab_rows] == ["186"] and out[0].dropped == 3 and not out[0].invalid and out[1].invalid
    many = '{"lab_rows":[' + ",".join(['{"label":"a","value":"1"}'] * 401) + "]}"
    odd = '{"lab_rows":[{"label":"a","value":"cancelled"},{"label":"b","value":"unknown"},{"label":"c","value":"TBD"}],"events":[]}'
    out = files.parse_claims(spark.createDataFrame([(many,), (odd,)], "j string"), "j").collect()
    assert out[0].invalid and len(out[0].lab_rows) == 401 and [r.value for r in out[1].lab_rows] == ["unknown"] and out[1].dropped == 2


def test_stream_of_deliveries(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, at timestamp"
    df = spark.sql("select * from values ('a', timestamp'2020-01-01'), ('a', timestamp'2020-01-02'), ('b', timestamp'2020-01-01') t(k, at)")
    df.write.parquet(src)
    ingest.append_to(ingest.first_deliveries(ingest.arriving(spark, src, schema), ["k"], "at"), out, str(tmp_path / "cp")).awaitTermination()
    df.write.mode("append").parquet(src)
    ingest.append_to(ingest.first_deliveries(ingest.arriving(spark, src, schema), ["k"], "at"), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_rendering(spark):
    assert safe("a\x1b[1m​") == "a\\u001b[1m\\u200b"
    assert table(spark.createDataFrame([(1, None)], "a int, b string"), ["a", "b"]) == "a  b\n1"
