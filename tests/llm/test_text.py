"""Look-alikes, the canonical list, sentences and leaks."""

from __future__ import annotations

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanline.functions.labels import edits
from spanline.llm import canonical, leaks, lookalikes, sentences

PLAIN = ["С-реактивный белок", "naïve café – „quoted“ — dash", "витамин b12", "Об'єм рідини", "plain text, 5 mg/dL", "ไข้สูง", "नींद ठीक है"]
CASES = [
    ("Ｇｌｕｃｏｓｅ", "Glucose"), ("корй", "корй"), ("café", "café"), ("gluc​ose", "glucose"), ("a b", "a b"), ("c‑reactive", "c-reactive"),
    ("Uratе", "Urate"), ("ГЕМOГЛОБИН", "ГЕМОГЛОБИН"), ("CPБ", "СРБ"), ("Τotal", "Total"), ("ﬁel", "fiel"), ("ｐｏｔａｓｓіｕｍ", "potassium"), ("5 μg/dL", "5 µg/dL"),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_plain_text(text, expected):
    assert lookalikes.plain_text(text) == expected


@pytest.mark.parametrize("text", [*PLAIN, "", None])
def test_plain_text_is_left_alone(text):
    assert lookalikes.plain_text(text) == text


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x1FFFF), max_size=20))
def test_transducer_is_idempotent(text):
    once = lookalikes.plain_text(text)
    assert lookalikes.plain_text(once) == once


def test_marks_in_any_order_and_other_signs_for_a_letter():
    assert lookalikes.plain_text("q\u0323\u0302") == lookalikes.plain_text("q\u0302\u0323")
    assert [lookalikes.plain_text(t) for t in ("\u212a", "\u212b", "\u2126", "\u0133s", "\u0140a", "\u0149a")] == ["K", "Å", "Ω", "ijs", "l·a", "ʼna"]


def test_the_jvm_side_test_passes_no_changed_text_by():
    import regex

    rule = regex.compile(lookalikes.suspect())
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x1FFFF)]):
        for t in (c, f"a{c}b", f"я{c}"):
            assert lookalikes.plain_text(t) == t or rule.search(t), hex(ord(c))


def test_tables_have_no_conflicts():
    table = lookalikes.width_table()
    assert all(not any(k in v for k in table if len(k) == 1) for v in list(table.values())[:3000])
    assert all(len(k) == 1 or unicodedata.combining(k[-1]) for k in table)


def test_changed_rows(spark):
    terms = spark.createDataFrame([("T", "analyte", "en", "hct"), ("T", "analyte", "ru", "гематокрит")], "concept_id string, kind string, lang string, term_label string")
    rows = [(1, "НСТ"), (2, "HCT"), (3, "гематокрит"), (4, "h​ct"), (5, None), (6, ""), (None, "h​ct"), (4, "h​ct")]
    df = spark.createDataFrame(rows, "k long, t string")
    assert sorted(r.row_id for r in lookalikes.changed_rows(df, "k", "t", terms).collect()) == [1, 4, 4]
    plain = {r.k: r.plain_text for r in lookalikes.normalise_text(df, "t", terms=terms).collect() if r.k}
    assert plain == {1: "HCT", 2: "HCT", 3: "гематокрит", 4: "hct", 5: None, 6: ""}


def test_automaton_against_all_distances():
    r = random.Random(1)
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randrange(3, 12))) for _ in range(300)})
    trie = canonical.Trie([(w, w) for w in words])
    for _ in range(150):
        q = "".join(r.choice("abcd") for _ in range(r.randrange(3, 12)))
        for most in (0, 1, 2):
            found = {(d, c) for d, c, _ in trie.search(q, most)}
            assert found == {(d, w) for w in words if (d := edits(q, w, most)) <= min(most, canonical.distance_for(len(w)))}


def test_resolve_and_report():
    trie = canonical.Trie([("C", "cardiology"), ("C", "cardiologist"), ("E", "eye clinic"), ("N", "nephrology"), ("N2", "neurology"), ("W", "white cell count")])
    for value, concept in (("CARDOLOGY", "C"), ("Clinic, cardiologist", "C"), ("dept. of nephrology", "N"), ("neu rology", "N2"), ("eye cliinc", "E"), ("cell count, white", "W"), ("white cel.", "W"), ("cardiol.", "C"), ("gift shop", "unmatched"), ("", "unmatched"), (None, "unmatched"), ("x" * 5000, "unmatched")):
        assert canonical.resolve(trie, value) == concept, value


def test_short_keys_and_all_near_entries(spark):
    trie = canonical.Trie([("NA", "Na"), ("K", "K"), ("PH", "pH"), ("U", "urea"), ("V", "ureas")])
    for value, concept in (("Na*", "NA"), ("Na ", "NA"), ("pH:", "PH"), ("K (serum)", "K"), ("Nb", "unmatched"), ("urea", "U"), ("urae", "U")):
        assert canonical.resolve(trie, value) == concept, value
    assert canonical.entries(trie, "ureax") == [(1, "U", "urea"), (1, "V", "ureas")] and canonical.resolve(trie, "ureax") == "unmatched"
    terms = spark.createDataFrame([("U", "analyte", "en", "urea"), ("V", "analyte", "en", "ureas")], "concept_id string, kind string, lang string, term_label string")
    df = spark.createDataFrame([("ureax",), ("ureax",), (None,), ("",), ("zzzzzz",)], "v string")
    assert sorted(tuple(r) for r in canonical.near_entries(df, "v", terms, "analyte").collect()) == [("ureax", "U", "urea", 1), ("ureax", "V", "ureas", 1)]


def test_long_keys_are_searched():
    word = "a" * 150 + "b" * 100
    trie = canonical.Trie([("L", word)])
    assert canonical.resolve(trie, word[:-2]) == "L" and canonical.resolve(trie, word * 2) == "unmatched"


UNITS = [
    ("Dr. Rudova came at 7.46. He left.", ["Dr. Rudova came at 7.46.", "He left."]),
    ('The tutor wrote: "Stop. Wait. Repeat." beside the curve. Next.', ['The tutor wrote: "Stop. Wait. Repeat." beside the curve.', "Next."]),
    ("Plan\n\nSleep is poor\nthis week. See Fig. 3.", ["Plan", "Sleep is poor\nthis week.", "See Fig. 3."]),
    ("1. One is here.\n2. Two? Yes.\n3. Three", ["1. One is here.", "2. Two?", "Yes.", "3. Three"]),
    ("Die Termine liegen am 2., 9. und\n16. des Monats. Am 3. Mai ging es.", ["Die Termine liegen am 2., 9. und\n16. des Monats.", "Am 3. Mai ging es."]),
    ("Контроль 25 мая 2014 г. Жалобы: слабость и т. д. Пациентка спросила: «Это опасно?» — и ушла.", ["Контроль 25 мая 2014 г.", "Жалобы: слабость и т. д.", "Пациентка спросила: «Это опасно?» — и ушла."]),
    ("他问：“要住院吗？”护士说不必。睡眠一般，饮食正常。", ["他问：“要住院吗？”护士说不必。", "睡眠一般，饮食正常。"]),
    ("患者は「夜に痛みます。」と話した。再検査は必要ですか？", ["患者は「夜に痛みます。」と話した。", "再検査は必要ですか？"]),
    ("แผลแห้งดี นัดตรวจใน 14 วัน น้ำหนัก 6 กก. ในเดือน", ["แผลแห้งดี", "นัดตรวจใน 14 วัน", "น้ำหนัก 6 กก. ในเดือน"]),
    ("डॉ. वेलमार ने बुलाया। नींद ठीक है।", ["डॉ. वेलमार ने बुलाया।", "नींद ठीक है।"]),
    ("It was expected.The report came.", ["It was expected.", "The report came."]),
    ("", []), ("  \n\n ", []), (None, []),
]


@pytest.mark.parametrize(("text", "units"), UNITS)
def test_sentences(text, units):
    assert [(text or "")[a:b] for a, b in sentences.sentence_spans(text)] == units


BY_LANGUAGE = [
    ("He lost abs. Then he ran.", "en", 2), ("Call Max. He is here.", "en", 2), ("Der Wert von max. Zehn ist gut.", "de", 1), ("यह पहला है. यह दूसरा है.", "hi", 2), ("Dr. Who came.", "en", 1), ("Dr. Who came.", "xx", 2),
]


@pytest.mark.parametrize(("text", "lang", "n"), BY_LANGUAGE)
def test_abbreviations_are_those_of_the_language(text, lang, n):
    assert len(sentences.sentence_spans(text, lang)) == n


def test_unclosed_marks_cost_one_pass():
    text = "(" * 30_000 + 'First. "Second. Third" goes on. Last.'
    assert [text[a:b] for a, b in sentences.sentence_spans(text)][1:] == ['"Second. Third" goes on.', "Last."]
    assert sentences.spans_of_pairs("a (b [c] «d ) e") == [(5, 7)] and sentences.spans_of_pairs("(a (b) c) (d)") == [(0, 8), (10, 12)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aA. \n\"!?«»()1。ก", max_size=60))
def test_units_cover_all_visible_characters(text):
    spans = sentences.sentence_spans(text)
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())
    assert all(a1 < b1 <= a2 for (a1, b1), (a2, _) in zip(spans, spans[1:]))


def brute_leaks(docs, items):
    return {(d, i) for d, t in docs for i, u in items if (w := leaks.words(u)) and leaks.shared_part(w, leaks.words(t)) >= leaks.LEAST_PART}


def test_items_that_share_their_text_leak_together(spark):
    r = random.Random(8)
    text = [f"w{r.randrange(500)}" for _ in range(83)]
    items = [(i, " ".join(text)) for i in range(60)] + [(100 + i, " ".join([*text[:80], f"x{i}", f"y{i}", f"z{i}"])) for i in range(60)]
    docs = [(1, "before " + " ".join(text) + " after"), (2, " ".join(text[:45])), (3, " ".join(text[:12]))]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = {(d, i) for d in (1, 2) for i, _ in items}
    assert brute_leaks(docs, items) == expected
    for most in (1000, 1):
        assert {(x.doc_id, x.item_id) for x in leaks.find_leaks(df, it, most_broadcast=most).collect()} == expected


def chain_by_hand(item, doc):
    """The best chain with every run held against every other."""
    cells = {(i, j) for i in range(len(item)) for j in range(len(doc)) if item[i] == doc[j]}
    runs = []
    for i, j in sorted(cells, key=lambda c: (c[1], c[0])):
        if (i - 1, j - 1) not in cells:
            n = 1
            while (i + n, j + n) in cells:
                n += 1
            if n >= leaks.RUN:
                runs.append((i, j, n))
    best = []
    for x, (i, j, n) in enumerate(runs):
        score = n
        for y in range(x):
            i0, j0, n0 = runs[y]
            a, b = i - i0 - n0, j - j0 - n0
            both = max(0, -a, -b)
            if i0 < i and j0 < j and both < n and a <= leaks.GAP and b <= leaks.GAP and abs(a - b) <= leaks.DRIFT:
                score = max(score, best[y] + n - both)
        best.append(score)
    return max(best, default=0) / max(1, len(item))


def test_chains_against_all_pairs_of_runs():
    r = random.Random(11)
    for _ in range(300):
        item = [r.choice("abcd") for _ in range(r.randrange(1, 25))]
        doc = [r.choice("abcd") for _ in range(r.randrange(0, 40))]
        k = r.randrange(0, 10)
        doc[k:k] = [w if r.random() > 0.1 else "x" for w in item]
        assert leaks.shared_part(item, doc) == pytest.approx(chain_by_hand(item, doc))


def test_both_ways_agree_on_repeated_ids_and_texts(spark):
    r = random.Random(12)
    one, two = ([f"{x}{r.randrange(400)}" for _ in range(60)] for x in "ab")
    items = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join(one)), (3, " ".join(two)), (3, " ".join(two)), *((10 + i, " ".join(one)) for i in range(50))]
    docs = [(1, " ".join(one[:40])), (2, " ".join(two[:40])), (3, "nothing of it"), (1, " ".join(two))]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ways = [{(x.doc_id, x.item_id, round(x.part, 6)) for x in leaks.find_leaks(df, it, **kw).collect()} for kw in ({}, {"most_broadcast": 1}, {"most_bytes": 10})]
    assert ways[0] == ways[1] == ways[2] and {(d, i) for d, i, _ in ways[0]} == {*((1, i) for i in (1, 2, 3, *range(10, 60))), (2, 1), (2, 3)}


def test_repetitive_texts_cost_no_square_of_runs():
    item, doc = ["a", "b"] * 60, ["a", "b"] * 3000
    assert leaks.shared_part(item, doc) == 1.0


def test_leaks_by_both_ways_and_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    stock = "the duty doctor writes down that nobody else fell ill at all".split()
    items = [(i, " ".join([r.choice(vocabulary) for _ in range(40)] + stock + [r.choice(vocabulary) for _ in range(20)])) for i in range(30)]
    docs = []
    for d in range(120):
        words = [r.choice(vocabulary) for _ in range(100)]
        if d % 3 == 0:
            source = items[d % 30][1].split()
            part = source[: int(len(source) * r.choice([0.2, 0.6, 1.0]))]
            if len(part) > 10 and d % 2:
                part[len(part) // 2] = "changed"
            words[30:30] = [w.upper() + "," for w in part]
        if d % 5 == 0:
            words += stock
        docs.append((d, "\n".join(words)))
    schema = "doc_id long, text string"
    df, it = spark.createDataFrame([*docs, (999, None), (998, "")], schema), spark.createDataFrame(items, "item_id long, text string")
    expected = brute_leaks(docs, items)
    assert expected and {(x.doc_id, x.item_id) for x in leaks.find_leaks(df, it).collect()} == expected
    assert {(x.doc_id, x.item_id) for x in leaks.find_leaks(df, it, most_broadcast=1).collect()} == expected


def test_winnowing_keeps_its_guarantee():
    r = random.Random(6)
    for _ in range(200):
        run = [f"r{r.randrange(50)}" for _ in range(leaks.GRAM + leaks.WINDOW - 1)]
        doc = [f"a{r.randrange(50)}" for _ in range(30)] + run + [f"b{r.randrange(50)}" for _ in range(30)]
        item = [f"c{r.randrange(50)}" for _ in range(30)] + run
        assert leaks.winnow(leaks.grams(doc)) & set(leaks.grams(item))
