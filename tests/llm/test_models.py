"""The tagger, details, scan noise and mixing."""

from __future__ import annotations

import random

import numpy as np
import pytest

from spanline.llm import details, mixing, pii_training, scans, tagger


def test_gradients_against_differences(monkeypatch):
    monkeypatch.setattr(tagger.np, "float32", np.float64)
    p = {k: v.astype(np.float64) for k, v in tagger.fresh(3).items()}
    texts = ["call Dr. Bo +1 55", "ab c"]
    ids, shapes = tagger.pad(texts)
    gold = np.zeros_like(ids)
    gold[0, 9], gold[0, 10], gold[0, 12] = 9, 10, 3

    def loss():
        scores, kept = tagger.forward(p, ids, shapes, True)
        return tagger.crf_loss(p, scores, kept[1], gold.T), kept

    (_, ds, dt, df), kept = loss()
    g = tagger.backward(p, ids, kept, ds) | {"trans": dt, "first": df}
    for k in p:
        at = (tagger.INDEX["c"], 3) if k == "emb" else tuple(n // 2 for n in p[k].shape)
        old, e = p[k][at], 1e-5
        p[k][at] = old + e
        up = loss()[0][0]
        p[k][at] = old - e
        down = loss()[0][0]
        p[k][at] = old
        assert (up - down) / (4 * e) == pytest.approx(g[k][at], rel=1e-3, abs=1e-6)


def test_training_learns_and_windows_agree():
    r = random.Random(1)
    texts, tags = [], []
    for _ in range(300):
        number = "".join(r.choice("0123456789") for _ in range(9))
        text = f"{r.choice(['see', 'call', 'ask'])} {number} {r.choice(['now', 'later'])}"
        a = text.index(number)
        texts.append(text)
        tags.append(pii_training.to_tags(text, [(a, a + 9, "phone")]))
    p = tagger.train(texts[:250], tags[:250], epochs=10, rate=0.02)
    right = sum(f == tagger.entities(np.array(g)) for f, g in zip(tagger.tag(p, texts[250:]), tags[250:], strict=True))
    assert right >= 47


def test_long_texts_are_read_whole():
    filler = "The sample was repeated and the second value agreed with the first. "
    text = filler * 30 + "Contact: Mrs. Velova, +1 555 555 0148. " + filler * 30 + "Contact: K. Dormer."
    found = [(text[a:b], k) for a, b, k in details.details([text])[0]]
    assert ("+1 555 555 0148", "phone") in found and ("Velova", "person") in found and found[-1] == ("K. Dormer", "person") and len(found) == 3


def test_details_of_literals():
    text = "Reply to Mrs. Velova please, call +1 555 555 0148 or marel+lab@inbox.test; passport X01858870, 63B Candlewick Rd., Estwick."
    found = {(text[a:b], k) for a, b, k in details.details([text])[0]}
    assert found == {("Velova", "person"), ("+1 555 555 0148", "phone"), ("marel+lab@inbox.test", "email"), ("X01858870", "id_number"), ("63B Candlewick Rd., Estwick", "address")}
    assert details.redacted(text, details.details([text])[0]).startswith("Reply to Mrs. [PERSON] please, call [PHONE] or [EMAIL]; passport [ID_NUMBER]")
    for harmless in ("Hashimoto thyroiditis is stable.", "Batch 555-01 of the reagent was replaced.", "Ward 4, Room 12, bed by the window.", "Болезнь Крона в ремиссии.", "Code K50.0 noted on the form."):
        assert details.details([harmless])[0] == [], harmless


def test_held_out_accuracy(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/spans.parquet").select("text").collect()] + [r.wording for r in spark.read.parquet(f"{data}/event_facts.parquet").select("wording").where("wording is not null").collect()]
    names = pii_training.learn_names(texts * 2)
    kinds = lambda spans: {k for _, _, k in spans}
    found = details.details(texts)
    labels = [pii_training.annotate(t, names) for t in texts]
    right = sum(kinds(a) == kinds(b) for a, b in zip(found, labels, strict=True))
    assert right >= 0.97 * len(texts)


def test_redact_keeps_nulls(spark):
    df = spark.createDataFrame([("Details: Mrs. Marova.",), (None,), ("",), ("5.1 mmol/L 4.0 - 6.0",)], "t string")
    from spanline.llm.details import redact

    assert [r.redacted for r in redact(df, "t").collect()] == ["Details: Mrs. [PERSON].", None, "", "5.1 mmol/L 4.0 - 6.0"]


def test_redacted_holds_all_rows_of_both_tables(spark, data):
    from spanline.llm import plans

    texts = {(t, r[0]): r[1] for t, k, c in (("event_facts", "fact_id", "wording"), ("spans", "span_id", "text")) for r in spark.read.parquet(f"{data}/{t}.parquet").select(k, c).collect()}
    rows = plans.p6_redacted(spark, data).collect()
    got = {(r.tab, r.row_id): r.redacted for r in rows}
    assert len(rows) == len(got) and got.keys() == texts.keys()
    found = {(r.tab, r.row_id, r.pii_type) for r in plans.p6_found(spark, data).collect()}
    assert {t for t, _, _ in found} == {"event_facts", "spans"}
    assert {(*key, kind) for key, text in got.items() for kind in tagger.TYPES if f"[{kind.upper()}]" in text} == found
    assert all(got[key] == details.plain_text(text) for key, text in texts.items() if key not in {f[:2] for f in found})


def test_no_text_is_kept_from_the_tagger(spark):
    texts = ["reply to marel.lab\uff20inbox.test", "call \u2460\u2461\u2462\u2463\u2464\u2465\u2466\u2467", "mrs. \u24cbelova", "058 5515-6595", "5.1 mmol/L 4.0 - 6.0", "a dry cough"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    want = ["reply to [EMAIL]", "call [ID_NUMBER]", "mrs. [PERSON]", "[PHONE]", *texts[4:]]
    assert [r.redacted for r in details.redact(df, "t").orderBy("k").collect()] == want
    assert {tuple(r) for r in details.find_details(df, "k", "t").collect()} == {(0, "email"), (1, "id_number"), (2, "person"), (3, "phone")}


SPANS = "span_id long, content_hash string, unit_number int, span_index int, text string, x0 double, reader string"


def pages():
    """Three contents of three pages with headers, numbers, breaks and misreadings."""
    body = "the patient came for a control of the wound and the dose was halved"
    rows, i = [], 0

    def add(c, u, texts, reader):
        nonlocal i
        for k, t in enumerate(texts):
            rows.append((i, c, u, k, t, 10.0, reader))
            i += 1

    for c in range(6):
        reader = "tesseract" if c % 2 else "pdf-text"
        for u in (1, 2, 3):
            lines = [f"{body} again today and tomorrow" for _ in range(8)]
            if u == 1:
                lines[7] = "the patient came for a control of the wo-"
            if u == 2:
                lines[0] = "und and the dose was halved again today"
                lines[3] = "the patient came for a control of the wound and the do"
                lines[4] = "se was halved again today and tomorrow"
            if c == 1 and u == 3:
                lines[5] = "the paticnt came for a control of the wound again"
            title = ["Results of the day"] if u == 1 else []
            add(f"c{c}", u, ["North Clinic of Velmar", *title, *lines, f"Page {u} of 3"], reader)
    return rows


def test_scan_noise(spark):
    rows = pages()
    df = spark.createDataFrame([*rows, (9999, None, None, None, None, None, None), (9998, "c0", 1, 99, "", None, "pdf-text")], SPANS)
    found = {(r.span_id, r.noise_kind) for r in scans.scan_noise(df).collect()}
    text = {r[0]: r[4] for r in rows}
    assert {text[i] for i, k in found if k == "furniture"} == {"North Clinic of Velmar", *(f"Page {u} of 3" for u in (1, 2, 3))}
    assert sum(k == "furniture" for _, k in found) == 6 * 6
    assert {text[i] for i, k in found if k == "broken_word"} == {"the patient came for a control of the wo-", "the patient came for a control of the wound and the do"}
    assert [text[i] for i, k in found if k == "misread"] == ["the paticnt came for a control of the wound again"]


def test_running_lines_are_several_deep_and_of_any_length(spark):
    long = "North Clinic of Velmar, department of internal medicine, " + "second building and ward of the eastern wing, " * 4
    rows, i = [], 0
    for c in range(4):
        for u in range(1, 6):
            name = "".join("akrxyn"[(7 * c + u) // d % 6] for d in (36, 6, 1))
            for k, t in enumerate([long, "Discharge letters", f"Note {name}", f"the dose of {name} was halved", "as agreed", f"see {name} too", "Confidential text", f"{u} / 5"]):
                rows.append((i, f"c{c}", u, k, t, 10.0, "pdf-text"))
                i += 1
    text = {r[0]: r[4] for r in rows}
    found = [text[r.span_id] for r in scans.scan_noise(spark.createDataFrame(rows, SPANS)).where("noise_kind = 'furniture'").collect()]
    assert set(found) == {long, "Discharge letters", "Confidential text", *(f"{u} / 5" for u in range(1, 6))} and len(found) == 80


def test_misread_words_at_line_edges(spark):
    lines = [(1, "patlent came for a control today", "tesseract"), (2, "vislt to the ward and then the control", "tesseract"), (3, "came again for a contro1", "tesseract"), (4, "vvard", "tesseract")]
    rows = [(i, "c0", i, 0, t, 10.0, r) for i, t, r in lines]
    rows += [(100 + i, "c1", i, 0, "so the patient came for a visit to the ward and then for a control today", 10.0, "pdf-text") for i in range(1, 80, 2)]
    # a decomposed letter is no misreading
    rows += [(300 + i, "c3", i, 0, "загальний", 10.0, "pdf-text") for i in range(1, 80, 2)] + [(400 + i, "c4", i, 0, "тест загальний тест", 10.0, "pdf-text") for i in range(1, 20, 2)] + [(500, "c0", 9, 0, "загальни\u0438\u0306", 10.0, "tesseract")]
    # parts of a broken word are no forms, even where one looks like a misreading
    rows += [(200, "c2", 1, 0, "came again for a con-", 10.0, "tesseract"), (201, "c2", 1, 1, "trol today and then the ward", 10.0, "tesseract")]
    found = {(r.span_id, r.noise_kind) for r in scans.scan_noise(spark.createDataFrame(rows, SPANS)).collect()}
    assert {i for i, k in found if k == "misread"} == {1, 2, 3, 4}
    assert {i for i, k in found if k == "broken_word"} == {200}


def test_paragraphs(spark):
    df = spark.createDataFrame(pages(), SPANS)
    texts = [r.text for r in scans.paragraphs(df).where("content_hash = 'c1'").collect()]
    whole = " ".join(texts)
    assert "control of the wound and the dose was halved" in whole and "paticnt" not in whole and "Page 2" not in whole and "wo- und" not in whole


@pytest.mark.parametrize("block", [4, 1024])
def test_paragraphs_run_over_all_pages(spark, monkeypatch, block):
    monkeypatch.setattr(scans, "BLOCK", block)
    rows = [(100 * u + k, "c", u, k, f"page {''.join('akrxy'[u // d % 5] for d in (25, 5, 1))} goes on with more text in line {chr(97 + k)} of", 10.0, "pdf-text") for u in range(1, 40) for k in range(3)]
    rows += [(4000, "c", 40, 0, "Title", 10.0, "pdf-text"), (4001, "c", 40, 1, "then another text that is long enough stands he-", 10.0, "pdf-text"), (4100, "c", 48, 0, "re and ends.", 10.0, "pdf-text")]
    got = sorted(tuple(r) for r in scans.paragraphs(spark.createDataFrame(rows, SPANS)).collect())
    assert [r[:3] for r in got] == [("c", 1, 1), ("c", 40, 1), ("c", 40, 2)]
    assert got[0][3] == " ".join(r[4] for r in rows[:-3]) and got[2][3].endswith("stands here and ends.")


def test_derivable():
    assert scans.derivable("cough", "c0ugh") and scans.derivable("similar", "sirnilar") and scans.derivable("контроль", "контропь")
    assert not scans.derivable("cough", "cough") and not scans.derivable("cough", "caugh") and not scans.derivable("cell", "cells")


def test_mix_meets_shares_and_caps(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, s, "x " * r.randrange(1, 30)) for s, n in (("a", 600), ("b", 300), ("c", 40)) for i in range(n)]
    rows = [(k, s, t) for k, (_, s, t) in enumerate(rows)] + [(-1, None, "x"), (-2, "zz", "x"), (-3, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")

    def count(frame, tokenizer=None):
        from pyspark.sql import functions as F

        return frame.select("doc_id", "source", F.coalesce(F.size(F.split(F.trim("text"), " ")), F.lit(0)).cast("long").alias("tokens"))

    monkeypatch.setattr(mixing, "with_tokens", count)
    monkeypatch.setattr(mixing, "SLICE_ROWS", 50)
    assert [x.source for x in mixing.short_sources(docs, targets).collect()] == ["c"]
    budget = 3000
    mixed = mixing.mix(docs, targets, budget)
    got = mixed.collect()
    assert abs(sum(x.tokens for x in got) - budget) < 100
    share = {x.source: x.actual_share for x in mixing.shares(mixed, targets).collect()}
    assert share["a"] == pytest.approx(0.5, abs=0.03) and share["b"] == pytest.approx(0.3, abs=0.03) and share["c"] == pytest.approx(0.2, abs=0.03)
    uses = {}
    for x in got:
        uses.setdefault((x.source, x.doc_id), []).append(x.repeat)
    assert all(len(set(v)) == len(v) <= {"a": 1, "b": 2, "c": 3}[s] for (s, _), v in uses.items())
    assert [x.finish for x in got] == sorted(x.finish for x in got)
    totals = {x.source: (x.repeats, x.tokens) for x in mixing.shares(mixed, targets).collect()}
    assert totals["none"] == (0, 0) and totals["a"][0] == 1 and totals["c"][0] >= 1
    # a source without any document is short of any share
    lacking = spark.createDataFrame([("a", 0.9, 1), ("gone", 0.1, 3)], targets.schema)
    assert {x.source for x in mixing.short_sources(docs, lacking).collect()} >= {"gone"}
    # more than there is: every source is used up, none beyond its cap
    full = mixing.mix(docs, targets, 10**9).groupBy("source", "doc_id").count().collect()
    assert all(x["count"] == {"a": 1, "b": 2, "c": 3}[x.source] for x in full)
