"""Noise of scanned pages: furniture, broken words, misread letters; and reflow."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..session import small_side, spread, written

# Glyphs a scanner takes for others, as "true read" pairs.
CONFUSED = (
    "e c;o 0;s 5;h b;g q;i l;l 1;i 1;b 8;b 6;m rn;w vv;d cl;z 2;t 7;u v;"
    "о 0;и н;л п;т г;п н;з 3;б 6;ш щ;ц щ;е с;ч 4;в 8;ь b;й и"
)
#: Classes of glyphs that can stand for one another, each under one of its own.
#: Built by joining the pairs above; a word's skeleton is its glyphs' classes.
PAIRS = tuple(tuple(p.split(" ")) for p in CONFUSED.split(";"))


def _classes() -> dict[str, str]:
    of: dict[str, str] = {}

    def root(c: str) -> str:
        while of.get(c, c) != c:
            c = of[c]
        return c

    for a, b in PAIRS:
        if len(b) == 1:
            of[root(b)] = root(a)
            of.setdefault(root(a), root(a))
    return {c: root(c) for c in of}


CLASSES = _classes()
WIDE = tuple((b, a) for a, b in PAIRS if len(b) > 1)
WORD = r"[\p{L}\p{N}]+"
#: A form is misread if the scanner alone writes it, another form of its skeleton
#: is so many times as frequent, and that form is so frequent at least.
RATIO, LEAST = 8, 4
#: A broken word's whole form is seen so often, and so many times as often as a part.
WHOLE_LEAST, WHOLE_RATIO = 3, 3
#: Share of neighbouring pages that repeat a line for it to be a running one, and
#: the pages that must show it before it is believed of pages standing alone.
RUNNING_SHARE, RUNNING_LEAST = 0.5, 3
#: Lines from either end of a page that may be running ones.
DEPTH = 3
SCANNER = "tesseract"
BLOCK = 1024


def skeleton(word: Column) -> Column:
    """The word with every confusable glyph under the first of its class."""
    for wide, narrow in WIDE:
        word = F.replace(word, F.lit(wide), F.lit(narrow))
    return F.translate(word, "".join(CLASSES), "".join(CLASSES.values()))


#: Letters of the four languages that may stand as a letter and a combining mark.
COMPOSED = tuple((unicodedata.normalize("NFD", c), c) for c in "йїёäöü")


def clean(text: Column) -> Column:
    """Lower case without invisible characters, letters in one piece."""
    text = F.lower(F.regexp_replace(text, "[\\u00AD\\u200B-\\u200D\\u2060\\uFEFF]", ""))
    for apart, one in COMPOSED:
        text = F.replace(text, F.lit(apart), F.lit(one))
    return text


def word_counts(lines: DataFrame) -> DataFrame:
    """Forms of words: ``form, n, n_clean`` (not from the scanner) inside lines,
    and ``n_all, n_all_clean`` anywhere.

    First and last words of lines are left out of the former, as they may be
    parts of words.
    """
    placed = lines.select("w", (F.col("reader") != SCANNER).cast("long").alias("c"))
    placed = placed.select("c", F.explode(F.transform("w", lambda w, i: F.struct(w.alias("form"), ((i > 0) & (i < F.size("w") - 1)).cast("long").alias("inner")))).alias("t"))
    tokens = placed.select("t.form", F.col("t.inner").alias("i"), "c")
    return tokens.groupBy("form").agg(F.sum("i").alias("n"), F.sum(F.col("i") * F.col("c")).alias("n_clean"), F.count(F.lit(1)).alias("n_all"), F.sum("c").alias("n_all_clean"))


def whole_counts(counts: DataFrame, broken: DataFrame) -> DataFrame:
    """``counts`` with the parts of broken words taken out of words anywhere."""
    parts = broken.select(F.explode(F.array(F.struct(F.col("a").alias("form"), "c"), F.struct(F.col("b").alias("form"), F.col("next_c").alias("c")))).alias("p"))
    parts = parts.groupBy(F.col("p.form").alias("form")).agg(F.count(F.lit(1)).alias("_n"), F.sum("p.c").alias("_c"))
    left = counts.join(parts, "form", "left")
    fewer = {c: F.greatest(F.col(inner), F.col(c) - F.coalesce(part, F.lit(0))) for c, inner, part in (("n_all", "n", "_n"), ("n_all_clean", "n_clean", "_c"))}
    return left.withColumns(fewer).drop("_n", "_c").where(F.col("n_all") > 0)


def derivable(true: str, read: str) -> bool:
    """Whether ``read`` is ``true`` with one or two glyphs taken for others."""
    seen = {(0, 0, 0)}
    todo = [(0, 0, 0)]
    while todo:
        i, j, k = todo.pop()
        if i == len(true) and j == len(read):
            return k > 0
        steps = [(i + 1, j + 1, k)] if i < len(true) and j < len(read) and true[i] == read[j] else []
        if k < 3:
            steps += [(i + 1, j + len(b), k + 1) for a, b in PAIRS if true[i : i + 1] == a and read.startswith(b, j)]
        for s in steps:
            if s not in seen:
                seen.add(s)
                todo.append(s)
    return False


@F.pandas_udf(BooleanType())
def _can_be_read(true: pd.Series, read: pd.Series) -> pd.Series:
    return pd.Series([derivable(a, b) for a, b in zip(true, read, strict=True)])


def misread_forms(counts: DataFrame, lines: DataFrame) -> DataFrame:
    """``form, meant``: forms that are misreadings of a frequent form.

    Forms are grouped by skeleton (a group holds the readings of one word);
    frequent forms the rare one can be a misreading of are its candidates, and
    the one whose neighbours in the text also stand beside the rare form wins,
    then the most frequent. A rare form may stand anywhere, a frequent one must
    be frequent inside lines.
    """
    keyed = counts.withColumn("skeleton", skeleton(F.col("form")))
    true = keyed.where((F.col("n") >= LEAST) & F.col("form").rlike("^[\\p{L}\\p{N}]*\\p{L}[\\p{L}\\p{N}]*$") & ~F.col("form").rlike("[\\p{L}]\\p{N}|\\p{N}[\\p{L}]"))
    true = true.select("skeleton", F.col("form").alias("meant"), F.col("n_all").alias("n_meant"), F.col("n_clean").alias("clean_meant"))
    pairs = keyed.join(true, "skeleton").where((F.col("form") != F.col("meant")) & (F.col("n_meant") >= RATIO * F.col("n_all")) & (F.col("clean_meant") > 0) & (F.col("n_all_clean") * 100 <= F.col("n_all")))
    rows = pairs.select("form", "meant", F.col("n_all").alias("n"), "n_meant").where(F.col("form").rlike("\\p{L}") | (F.length("form") > 2))
    rows = written(rows.where(_can_be_read("meant", "form")), "scan-pairs")
    wanted = rows.select("form").union(rows.select("meant")).distinct()
    contexts = written(neighbour_counts(lines, wanted), "scan-contexts")
    a = contexts.select("form", "beside", F.col("n").alias("n_a"))
    b = contexts.select(F.col("form").alias("meant"), "beside")
    needed = rows.select("form", "meant")
    support = needed.join(a, "form").join(b, ["meant", "beside"]).groupBy("form", "meant").agg(F.sum("n_a").alias("support"))
    rows = rows.join(support, ["form", "meant"], "left").withColumn("support", F.coalesce("support", F.lit(0)))
    # without any shared neighbour the form must be much rarer still
    rows = rows.where((F.col("support") > 0) | (F.col("n_meant") >= 4 * RATIO * F.col("n")))
    return rows.groupBy("form").agg(F.max_by("meant", F.struct("support", "n_meant", "meant")).alias("meant"))


def neighbour_counts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``form, beside, n``: the wanted forms with the word before (``<``) or after (``>``)."""
    words = F.col("w")
    pairs = F.transform(F.when(F.size(words) > 1, F.sequence(F.lit(0), F.size(words) - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(words[i].alias("a"), words[i + 1].alias("b")))
    both = lines.select(F.explode(pairs).alias("p"))
    sides = both.select(F.explode(F.array(F.struct(F.col("p.a").alias("form"), F.concat(F.lit(">"), F.col("p.b")).alias("beside")), F.struct(F.col("p.b").alias("form"), F.concat(F.lit("<"), F.col("p.a")).alias("beside")))).alias("s"))
    return sides.select("s.form", "s.beside").join(small_side(wanted), "form").groupBy("form", "beside").agg(F.count(F.lit(1)).alias("n"))


def page_edges(lines: DataFrame) -> DataFrame:
    """The first and last ``DEPTH`` lines of every page, one row each with its
    ``edge`` and ``depth``; one window per page numbers its lines."""
    page = Window.partitionBy("content_hash", "unit_number")
    number = F.row_number().over(page.orderBy("span_index", "span_id"))
    rows = lines.select("content_hash", "unit_number", "span_index", "span_id", "text").withColumns({"first": number, "last": F.count(F.lit(1)).over(page)})
    rows = rows.withColumn("last", F.col("last") - F.col("first") + 1)
    # a line in the middle of a short page counts to its nearer end
    first = (F.col("first") <= DEPTH) & (F.col("first") <= F.col("last"))
    last = (F.col("last") <= DEPTH) & ~first
    rows = rows.where(first | last)
    return rows.select("content_hash", "unit_number", F.when(first, "first").otherwise("last").alias("edge"), F.when(first, F.col("first")).otherwise(F.col("last")).alias("depth"), "span_id", "text")


# Dates with a month name, or digits only; no running lines.
MONTH_WORD = r"янв|фев|мар|апр|ма[йя]|июн|июл|авг|сен|окт|ноя|дек|січ|лют|берез|квіт|трав|черв|лип|серп|верес|жовт|листоп|груд|jan|feb|mär|mar|apr|may|mai|jun|jul|aug|sep|oct|okt|nov|dec|dez"
DATED = rf"^\s*(?:\d{{1,2}}[.\s]*)?(?:{MONTH_WORD})\p{{L}}*\.?\s+(?:\d{{1,2}},?\s+)?\d{{4}}|^\s*\d{{1,4}}[./-]\d{{1,2}}[./-]\d{{2,4}}\b"


#: Numbers that stand alone; digits inside words may be misread letters.
NUMBER = r"(?<![\p{L}\p{N}])\d{1,5}(?![\p{L}\p{N}])"
FIRST_NUMBER = rf"^((?:[^\d]|(?<=\p{{L}})\d|\d(?=\p{{L}}))*?){NUMBER}"
LAST_NUMBER = rf"{NUMBER}(?!.*{NUMBER})"


def furniture(lines: DataFrame) -> DataFrame:
    """``span_id`` of running headers, footers and page numbers.

    Lines at a page's ends get keys: their text as it is, and for each number in
    it the text with that number masked plus how far it is from the page's place.
    A key that the page before or after shares at the same place makes a running
    line. How often a line's form is shared that way over all contents tells
    titles, which stand at the same place but are not repeated, from headers, and
    judges pages that have no neighbour. A line further in is a running one only
    where all lines between it and the page's end are.
    """
    edges = page_edges(lines)
    text = clean(F.col("text"))
    numbers = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    edges = edges.withColumns({"form": skeleton(F.regexp_replace(text, NUMBER, "9")), "plain": skeleton(text), "_t": text, "_n": numbers})
    edges = edges.where(~F.lower(F.col("text")).rlike(DATED))
    # a line that its page repeats is text where it is not the outermost
    repeated = F.count(F.lit(1)).over(Window.partitionBy("content_hash", "unit_number", "form")) > 1
    edges = edges.withColumn("_again", repeated).where((F.col("depth") == 1) | ~F.col("_again"))
    none = F.array().cast("array<struct<key:string,offset:int>>")
    own = F.array(F.struct(F.col("plain").alias("key"), F.lit(None).cast("int").alias("offset")))
    ends = ((FIRST_NUMBER, "$1#", F.col("_n")[0]), (LAST_NUMBER, "#", F.element_at("_n", -1)))
    counted = F.array(*[F.struct(skeleton(F.regexp_replace("_t", pattern, mask)).alias("key"), (F.col("unit_number") - n.cast("int")).alias("offset")) for pattern, mask, n in ends])
    keys = F.concat(F.when(F.col("text").rlike(r"\p{L}{3}"), own).otherwise(none), F.when(F.size("_n") > 0, counted).otherwise(none))
    telling = (F.length(F.regexp_replace("text", r"[^\p{L}]", "")) >= 8) | F.col("text").rlike(r"(?<!\d)1(?!\d)")
    place = ["content_hash", "unit_number", "edge", "depth", "span_id", "form", "telling"]
    # keys and forms are only compared, so their hashes travel
    keyed = edges.withColumns({"form": F.xxhash64("form"), "telling": telling}).select(*place, F.explode(keys).alias("k")).select(*place, F.xxhash64("k.key", "k.offset").alias("key"))
    keyed = written(keyed, "scan-edges")
    around = keyed.select("content_hash", "unit_number", "edge", "depth", "key").distinct()
    around = around.withColumn("unit_number", F.explode(F.array(F.col("unit_number") - 1, F.col("unit_number") + 1))).distinct()
    shared = keyed.join(around.withColumn("_shared", F.lit(True)), ["content_hash", "unit_number", "edge", "depth", "key"], "left")
    lines_ = shared.groupBy(*place).agg(F.max(F.col("_shared").isNotNull()).alias("shared"))
    # A page has a neighbour to share with unless its content is one page.
    pages = lines.groupBy("content_hash").agg((F.min("unit_number") != F.max("unit_number")).alias("several"))
    lines_ = written(lines_.join(pages, "content_hash"), "scan-judged")
    forms = lines_.groupBy("edge", "depth", "form").agg(F.sum(F.col("shared").cast("long")).alias("n_shared"), F.sum(F.col("several").cast("long")).alias("n"))
    forms = small_side(forms.where(F.col("n_shared") > 0))
    judged = lines_.join(forms, ["edge", "depth", "form"], "left").withColumn("share", F.coalesce(F.col("n_shared") / F.col("n"), F.lit(0.0)))
    alone = (F.col("n_shared") >= RUNNING_LEAST) & F.col("telling")
    # further in stock sentences meet by chance, so more pages must show the line
    often = (F.col("depth") == 1) | (F.col("n_shared") >= 2 * RUNNING_LEAST)
    running = judged.where((F.col("share") >= RUNNING_SHARE) & (F.col("shared") | alone) & often).select("content_hash", "unit_number", "edge", "depth", "span_id").distinct()
    outer = F.row_number().over(Window.partitionBy("content_hash", "unit_number", "edge").orderBy("depth", "span_id"))
    return running.withColumn("_outer", outer).where(F.col("_outer") == F.col("depth")).select("span_id").distinct()


def next_lines(text_lines: DataFrame) -> DataFrame:
    """Every line with ``next_text`` and ``next_reader``, of the line of text that
    follows it in its content, on this page or a later one; ``text_lines`` holds
    no furniture.

    Within a page a window finds it; from page to page two levels of windows do,
    over one row per page and one per block of pages, so a binder holding a
    third of all rows is no single window.
    """
    page = Window.partitionBy("content_hash", "unit_number").orderBy("span_index", "span_id")
    lines = text_lines.withColumn("_next", F.lead(F.struct("text", "reader")).over(page))
    pages = text_lines.groupBy("content_hash", "unit_number").agg(F.min_by(F.struct("text", "reader"), F.struct("span_index", "span_id")).alias("_text"))
    pages = pages.withColumn("_block", F.floor(F.col("unit_number") / BLOCK)).withColumn("_later", F.lead("_text").over(Window.partitionBy("content_hash", "_block").orderBy("unit_number")))
    blocks = pages.groupBy("content_hash", "_block").agg(F.min_by("_text", "unit_number").alias("_b"))
    blocks = blocks.withColumn("_after", F.lead("_b").over(Window.partitionBy("content_hash").orderBy("_block"))).select("content_hash", "_block", "_after")
    pages = pages.join(blocks, ["content_hash", "_block"]).select(F.col("content_hash").alias("_h"), F.col("unit_number").alias("_u"), F.coalesce("_later", "_after").alias("_page"))
    lines = lines.join(pages, (F.col("content_hash") == F.col("_h")) & (F.col("unit_number") == F.col("_u")), "left")
    following = F.coalesce("_next", "_page")
    return lines.withColumns({"next_text": following["text"], "next_reader": following["reader"]}).drop("_next", "_page", "_h", "_u")


MARK = r"(\p{L})[-¬\x{AD}‐‑]$"
LAST = r"([\p{L}\p{N}]+)[-¬\x{AD}‐‑]?$"
FIRST = r"^([\p{L}\p{N}]+)"


def broken_words(text_lines: DataFrame, counts: DataFrame) -> DataFrame:
    """``span_id, a, b, c, next_c``: lines whose last word goes on in the next
    line, its two parts and whether each is not from the scanner (1 or 0).

    A mark after a letter before a line that goes on in lower case is enough.
    Without one, the two parts joined must be a frequent word (by skeleton, so
    misread parts count), and one of the parts much rarer as a word.
    """
    lines = next_lines(text_lines)
    trimmed = F.rtrim(F.regexp_replace(F.col("text"), "[\\u200B-\\u200D\\u2060\\uFEFF]", ""))
    start = F.ltrim(F.col("next_text"))
    not_scanned = [(F.col(x) != SCANNER).cast("long").alias(c) for x, c in (("reader", "c"), ("next_reader", "next_c"))]
    lines = lines.select("span_id", *not_scanned, trimmed.alias("_t"), start.alias("_s")).where(F.col("_s").rlike(r"^[\p{Ll}0-9]") & F.col("_t").rlike(rf"{LAST}"))
    marked = F.col("_t").rlike(MARK)
    lines = lines.select("span_id", "c", "next_c", marked.alias("marked"), F.lower(F.regexp_extract("_t", LAST, 1)).alias("a"), F.lower(F.regexp_extract("_s", FIRST, 1)).alias("b"), F.col("_s").rlike(r"^\p{N}*\p{Ll}").alias("goes_on"))
    lines = lines.where(F.col("goes_on") & (F.col("marked") | (F.col("a").rlike(r"\p{L}$") & ~F.col("a").rlike(r"^\p{N}"))))
    lines = written(lines, "scan-ends")
    table = counts.withColumn("k", skeleton(F.col("form"))).groupBy("k").agg(F.sum("n").alias("n"), F.max_by("form", F.struct("n", "form")).alias("form"))
    plain = spread(lines.where(~F.col("marked")), "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))
    wholes = table.where(F.col("n") >= WHOLE_LEAST).select(F.col("k").alias("kw"), F.col("n").alias("n_whole"), F.col("form").alias("whole"))
    known = plain.join(wholes, skeleton(F.concat("a", "b")) == F.col("kw")).where(F.length("whole") > 3)
    parts = counts.select(F.col("form"), F.col("n"))
    known = known.join(parts.select(F.col("form").alias("a"), F.col("n").alias("n_a")), "a", "left").join(parts.select(F.col("form").alias("b"), F.col("n").alias("n_b")), "b", "left")
    rare = F.least(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))) * WHOLE_RATIO < F.col("n_whole")
    known = known.where(rare).select("a", "b").distinct()
    out = ["span_id", "a", "b", "c", "next_c"]
    return lines.where(~F.col("marked")).join(known, ["a", "b"]).select(*out).unionByName(lines.where("marked").select(*out))


def _lines(spans: DataFrame) -> DataFrame:
    """Lines of text with their words ``w`` in clean form; cut into words once."""
    lines = spans.select("span_id", "content_hash", "unit_number", "span_index", "text", "reader", "x0").where(F.col("span_id").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != ""))
    return written(lines.withColumn("w", F.regexp_extract_all(clean(F.col("text")), F.lit(WORD), F.lit(0))), "scan-lines")


def _noise(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Furniture, lines of text without it, broken words, and misread forms."""
    edge = written(furniture(lines), "scan-furniture")
    text_lines = lines.join(small_side(edge), "span_id", "left_anti")
    counts = written(word_counts(lines), "scan-counts")
    broken = written(broken_words(text_lines, counts), "scan-broken")
    forms = small_side(written(misread_forms(whole_counts(counts, broken), lines), "scan-forms"))
    return edge, text_lines, broken, forms


#: A digit that letters are taken for, inside a word that is no name of a thing.
ODD = r"(?<![\p{L}\p{N}@._-])\p{L}{2,}[0135]\p{Ll}{2,}(?![\p{L}\p{N}@_])|(?<![\p{L}\p{N}@._-])\p{Lu}\p{Ll}+[0135]\p{Ll}+(?![\p{L}\p{N}@_])"


def scan_noise(spans: DataFrame) -> DataFrame:
    """``span_id, noise_kind`` for furniture, broken words and misread letters.

    Method: words are grouped by confusable-glyph skeleton and the contextually
    supported frequent form is chosen; running lines are found with numbers
    masked; the order of lines is followed by SQL windows. Statistics are over
    all spans. Beside them a digit inside a word of the scanner is a misread
    letter however rare the word. Defined results: null and blank spans have no
    noise and are skipped as lines; a span may have several kinds; repeated span
    ids give one row a kind; letter-free tokens are never misread.
    """
    lines = _lines(spans)
    edge, _, broken, forms = _noise(lines)
    scanned = lines.where(F.col("reader") == SCANNER)
    misread = scanned.select("span_id", F.explode(F.array_distinct("w")).alias("form")).join(forms.select("form"), "form").select("span_id")
    misread = misread.union(scanned.where(F.col("text").rlike(ODD)).select("span_id"))
    kinds = {"furniture": edge, "misread": misread, "broken_word": broken}
    out = None
    for kind, df in kinds.items():
        part = df.select(F.col("span_id").cast("long"), F.lit(kind).alias("noise_kind"))
        out = part if out is None else out.union(part)
    return out.distinct()


def _starts(line: Column, before: Column) -> Column:
    """1 where a line starts a paragraph after the line before it, else 0."""
    same_edge = F.coalesce(F.abs(line["x0"] - before["x0"]) < 5, F.lit(True))
    goes_on = F.coalesce(before["broken"], F.lit(False)) | (before["_is_text"] & line["_is_text"] & same_edge)
    return F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)


def paragraph_bases(pages: DataFrame) -> DataFrame:
    """``_h, _u, _base``: per page the number, in its content, of the paragraph
    its first line belongs to. ``pages`` holds first and last lines and the
    starts ``_n`` among the other lines.

    Both steps carry over in two levels: within blocks of pages, then over one
    row per block.
    """
    block = Window.partitionBy("content_hash", "_block").orderBy("unit_number")
    content = Window.partitionBy("content_hash").orderBy("_block")
    pages = pages.withColumn("_block", F.floor(F.col("unit_number") / BLOCK))

    def with_blocks(df: DataFrame, of: Column, over: Column) -> DataFrame:
        blocks = df.groupBy("content_hash", "_block").agg(of.alias("_of")).select(F.col("content_hash").alias("_h"), F.col("_block").alias("_k"), over.alias("_ahead"))
        return df.join(blocks, F.col("content_hash").eqNullSafe(F.col("_h")) & F.col("_block").eqNullSafe(F.col("_k"))).drop("_h", "_k")

    ahead = with_blocks(pages, F.max_by("_last", F.struct("unit_number")), F.lag("_of").over(content))
    before = F.coalesce(F.lag("_last").over(block), F.col("_ahead"))
    starts = ahead.withColumn("_before", before).withColumn("_new", F.when(F.col("_before").isNull(), 1).otherwise(_starts(F.col("_first"), F.col("_before"))))
    starts = written(starts.select("content_hash", "unit_number", "_block", "_n", "_new"), "scan-starts")
    sums = with_blocks(starts, F.sum(F.col("_n") + F.col("_new")), F.sum("_of").over(content) - F.col("_of"))
    base = F.col("_ahead") + F.sum(F.col("_n") + F.col("_new")).over(block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    return sums.select(F.col("content_hash").alias("_h"), F.col("unit_number").alias("_u"), base.alias("_base"))


def _repaired(text: Column, repairs: Column) -> Column:
    """The text with its misread forms written as what they mean, in their case."""
    meant_of = F.map_from_entries(repairs)

    def word(token: Column) -> Column:
        meant = F.try_element_at(meant_of, clean(token))
        first = F.substring(token, 1, 1)
        return F.when(meant.isNull(), token).when(token == F.upper(token), F.upper(meant)).when(first == F.upper(first), F.initcap(meant)).otherwise(meant)

    tokens = F.regexp_extract_all(text, F.lit(rf"{WORD}|[^\p{{L}}\p{{N}}]+"), F.lit(0))
    return F.array_join(F.transform(tokens, word), "")


def paragraphs(spans: DataFrame) -> DataFrame:
    """``content_hash, unit_number, paragraph, text``: running text, repaired.

    Furniture is dropped, broken words are joined, misread forms are replaced
    by what they mean, and lines are reflowed: a paragraph goes on while lines
    of text follow at the same left edge; it may run over pages and is numbered
    within the page it starts on. Short lines that end no sentence (titles,
    dates, table cells) stand alone. Paragraph starts are found by windows
    within pages, and from page to page by two levels of windows over one row
    per page, so no content is collected as a whole, only each paragraph.
    """
    lines = _lines(spans)
    _, text_lines, broken, forms = _noise(lines)
    broken = broken.groupBy("span_id").agg(F.lit(True).alias("broken"))
    # Only lines with a misread form are cut into tokens; the forms of one line are few.
    scanned = lines.where(F.col("reader") == SCANNER).select("span_id", "content_hash", F.explode(F.array_distinct("w")).alias("form"))
    repairs = scanned.join(forms, "form").groupBy("span_id").agg(F.collect_set(F.struct("form", "meant")).alias("repairs"))
    rows = text_lines.select("span_id", "content_hash", "unit_number", "span_index", "text", "x0").join(small_side(broken), "span_id", "left")
    rows = rows.join(repairs, "span_id", "left").withColumn("text", F.when(F.col("repairs").isNull(), F.col("text")).otherwise(_repaired(F.col("text"), F.col("repairs")))).drop("repairs")
    is_text = (F.length("text") >= 30) | F.col("text").rlike(r"[.!?…»“\"]\s*$")
    rows = written(rows.withColumn("_is_text", is_text), "scan-rows")
    at = F.struct("span_index", "span_id")
    line = F.struct("x0", "broken", "_is_text")
    page = Window.partitionBy("content_hash", "unit_number").orderBy("span_index", "span_id")
    # the first line of a page is judged below, where the page before is known
    rows = rows.withColumn("_before", F.lag(line).over(page))
    rows = rows.withColumn("_starts", F.when(F.col("_before").isNull(), 0).otherwise(_starts(line, F.col("_before")))).withColumn("_p", F.sum("_starts").over(page))
    pages = rows.groupBy("content_hash", "unit_number").agg(F.min_by(line, at).alias("_first"), F.max_by(line, at).alias("_last"), F.sum("_starts").alias("_n"))
    rows = rows.join(paragraph_bases(pages), F.col("content_hash").eqNullSafe(F.col("_h")) & F.col("unit_number").eqNullSafe(F.col("_u"))).withColumn("_p", F.col("_p") + F.col("_base"))
    part = F.when(F.col("broken"), F.regexp_replace("text", r"[-¬\x{AD}]$", "")).otherwise(F.concat("text", F.lit(" ")))
    grouped = rows.groupBy("content_hash", "_p").agg(
        F.min("unit_number").alias("unit_number"), F.array_sort(F.collect_list(F.struct("unit_number", "span_index", "span_id", part.alias("t")))).alias("l"))
    out = grouped.select("content_hash", "unit_number", "_p", F.trim(F.array_join(F.transform("l", lambda s: s["t"]), "")).alias("text"))
    number = F.row_number().over(Window.partitionBy("content_hash", "unit_number").orderBy("_p"))
    return out.select("content_hash", "unit_number", number.alias("paragraph"), "text")
