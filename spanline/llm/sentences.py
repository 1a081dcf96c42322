"""Sentence units of documents in any script."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that no sentence ends with, per language.
NEVER_LAST = {
    "en": "dr mr mrs ms prof st vs i.e e.g cf approx fig figs tab temp dept resp incl",
    "de": "dr prof hr fr ca ggf bzw z.b d.h u.a nr evtl inkl vgl str abs bd min max med",
    "fr": "dr pr mme mlle m mm env p.ex cf fig sem av apr",
    "ru": "д-р проф т.е ок см рис табл каб ул д кв стр пер гр им акад напр",
    "uk": "д-р проф тобто бл див мал табл каб вул буд кв стор пров напр ім акад",
    "hi": "डॉ श्री प्रो कि.ग्रा कि.मी से.मी",
    "th": "ดร นพ พญ กก ซม มม",
}
# Abbreviations that stand before a number and otherwise are words.
BEFORE_NUMBER = "no nos nr p pp vol ch sec ref item pt art abb seite s fig tab рис табл мал с стр п пп гл табл № ст каб т н від"
# German words before an ordinal, and month names that follow one.
BEFORE_ORDINAL = "am im der die das den dem des vom zum zur bis ab seit jeder jeden und"
MONTHS_DE = "januar februar märz april mai juni juli august september oktober november dezember"

NEVER = {lang: frozenset(words.split()) for lang, words in NEVER_LAST.items()}
#: For texts whose language is not known.
NEVER_ANY = frozenset().union(*NEVER.values())
NUMBERED = frozenset(BEFORE_NUMBER.split())
ORDINAL = frozenset(BEFORE_ORDINAL.split())
MONTHS = frozenset(MONTHS_DE.split())

BLANK = regex.compile(r"\n[^\S\n]*(?:\n\s*)+|[\p{Zp}]+")
TERMINATOR = regex.compile(r"[\p{SB=STerm}\p{SB=ATerm}…]+(?:[^\S\n]*[?!]+)*")
STRONG = regex.compile(r"[\p{SB=STerm}]")
CLOSERS = regex.compile(r"(?:[^\S\n]?»|[\p{Pe}\p{Pf}\"”“’'\]）」』】》])*")
UPPER, LOWER, OTHER = (regex.compile(rf"\p{{SB={x}}}") for x in ("Upper", "Lower", "OLetter"))
WORD_BEFORE = regex.compile(r"((?:[\p{L}\p{M}]+[.-])*[\p{L}\p{M}]+)$")
SPACED_BEFORE = regex.compile(r"(?<![\p{L}\p{M}.])(\p{L}{1,2}\.[^\S\n]?\p{L}{1,3})$")
NUMBER_BEFORE = regex.compile(r"(?:([\p{L}]+)\s+|^|,\s*)(\d{1,3})$")
ITEM = regex.compile(r"\s*(\d{1,3})[.)](?=[^\S\n])")
CONTINUES = regex.compile(r"\s*(?:[,;:—–-]|\p{SB=Lower})")
SOLID = regex.compile(r"\S")
#: Characters about a full stop in which its word and its follower are looked at:
#: more than any listed word has, so what lies beyond cannot change the answer.
NEAR = 8 + max(len(w) for w in (*NEVER_ANY, *NUMBERED, *ORDINAL, *MONTHS))
WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
THAI = r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}&&[\p{L}\p{M}]]"
THAI_SPACE = regex.compile(rf"(?V1)(?<={THAI})[^\S\n]+(?={THAI})|(?V1)(?<={THAI})\n(?={THAI})")
PAIRS = {"«": "»", "„": "“”", "“": "”", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "《": "》"}
MARKS = regex.compile("[" + regex.escape("".join({*PAIRS, *"".join(PAIRS.values()), '"'})) + "]")


def spans_of_pairs(text: str) -> list[tuple[int, int]]:
    """Outermost quotations and brackets as (first, last) positions; a mark that
    is not closed holds nothing back. One pass over the text."""
    stack: list[tuple[int, str]] = []
    pairs = []
    for m in MARKS.finditer(text):
        i, c = m.start(), m[0]
        if stack and c in stack[-1][1]:
            pairs.append((stack.pop()[0], i))
        elif c in PAIRS or c == '"':
            stack.append((i, PAIRS.get(c, c)))
    out: list[tuple[int, int]] = []
    for first, last in sorted(pairs):
        if not out or first > out[-1][1]:
            out.append((first, last))
    return out


def _abbreviated(before: str, after: str, never: frozenset[str]) -> bool:
    """Whether the full stop between ``before`` and ``after`` only shortens a word;
    ``never`` are the language's abbreviations that end no sentence."""
    m = WORD_BEFORE.search(before)
    nxt = after.lstrip()
    if m:
        word = m[1]
        spaced = SPACED_BEFORE.search(before)
        key = word.casefold()
        if key in never and not (len(key) == 1 and word.islower() and nxt[:1].isupper() and key in "дпс"):
            return True
        if spaced and regex.sub(r"\s", "", spaced[1].casefold()) in never:
            return True
        if key in NUMBERED and nxt[:1].isdigit():
            return True
        single = len(word) == 1 and UPPER.match(word)
        if single and (len(before) == 1 or before[-2] in " \n\t.(«\"„“ ") and UPPER.match(nxt):
            return True
        return False
    n = NUMBER_BEFORE.search(before)
    if n:
        follower = regex.match(r"\p{L}+", nxt)
        if follower and follower[0].casefold() in MONTHS:
            return True
        if n[1] and n[1].casefold() in ORDINAL and follower and int(n[2]) <= 31:
            return True
    return False


def _block(text: str, base: int, out: list[tuple[int, int]], never: frozenset[str]) -> None:
    """Units of a text without blank lines."""
    pairs = spans_of_pairs(text)
    firsts = [a for a, _ in pairs]
    cuts: set[int] = set()
    skip: set[int] = set()
    item = ITEM.match(text)
    if item:
        expected = int(item[1]) + 1
        skip.add(item.end() - 1)
        for line in regex.finditer(r"\n", text):
            m = ITEM.match(text, line.end())
            if m and int(m[1]) == expected:
                cuts.add(line.end())
                skip.add(m.end() - 1)
                expected += 1
    start = 0
    ordered = sorted(cuts)
    for m in TERMINATOR.finditer(text):
        if m.start() in skip:
            continue
        k = bisect_right(ordered, m.start())
        if k and ordered[k - 1] > start:
            start = ordered[k - 1]
        end = CLOSERS.match(text, m.end()).end()
        seen = SOLID.search(text, end)
        if not seen:
            continue
        after = text[end : seen.start() + NEAR]
        i = bisect_right(firsts, m.start()) - 1
        inside = pairs[i] if i >= 0 and pairs[i][0] < m.start() <= pairs[i][1] else None
        closed = end > m.end()
        if inside and end <= inside[1]:  # within a quotation or bracket
            led = bool(SOLID.search(text, start, inside[0]))
            rest = inside[1] + 1
            on = bool(CONTINUES.match(text, rest)) or bool(WIDE.match(text, rest)) or (text[inside[0]] in "([（" and bool(SOLID.search(text, rest)))
            if led or on:
                continue
        nxt = after.lstrip()
        spaced = len(nxt) < len(after)
        strong = bool(STRONG.search(m[0]))
        if closed and inside:
            led = bool(SOLID.search(text, start, inside[0]))
            if CONTINUES.match(after) or (not spaced and WIDE.match(nxt)) or (text[inside[0]] in "([（" and led and not spaced):
                continue
        if not strong:
            if not spaced and not (UPPER.match(nxt) or nxt[0] in "«„“\"(「"):
                continue
            if LOWER.match(nxt) or nxt[0] in ",;:)":
                continue
            if m[0] == "." and not closed and _abbreviated(text[max(start, m.start() - NEAR) : m.start()], after, never):
                continue
            if not spaced:
                word = WORD_BEFORE.search(text[max(start, m.start() - NEAR) : m.start()])
                short = word and len(word[1].rpartition(".")[2]) == 1
                if short and (UPPER.match(word[1][-1]) or not regex.match(r"\p{Lu}[\p{Ll}.]", nxt)) and m[0] == ".":
                    continue
        elif nxt[0] in ",;:)":
            continue
        cuts.add(end)
        start = end
    for m in THAI_SPACE.finditer(text):
        cuts.add(m.end())
    last = 0
    for cut in [*sorted(cuts), len(text)]:
        piece = text[last:cut]
        lead = len(piece) - len(piece.lstrip())
        body = piece.strip()
        if body:
            out.append((base + last + lead, base + last + lead + len(body)))
        last = cut


def sentence_spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """Start and end of every sentence unit, without surrounding white space.

    ``lang`` names whose abbreviations hold; a language without a list has none,
    and for an unknown one those of all hold."""
    never = NEVER.get(lang, frozenset()) if lang else NEVER_ANY
    out: list[tuple[int, int]] = []
    if not text:
        return out
    last = 0
    for m in BLANK.finditer(text):
        _block(text[last : m.start()], last, out, never)
        last = m.end()
    _block(text[last:], last, out, never)
    return out


OUT = "doc_id long, start_pos long, end_pos long"


def split_sentences(documents: DataFrame) -> DataFrame:
    """One row per sentence unit: ``doc_id, start_pos, end_pos`` (exclusive).

    Method: the standard sentence-break character properties find terminators in
    every script, followed by suppression for the language's abbreviations, initials
    and ordinals, closing marks, quotations and lists; blank lines always end a
    unit, and a space between Thai letters does. A narrow map: no shuffle.

    Defined results: null, empty and blank texts have no units; a text without
    terminator is one unit per block; repeated documents each give their rows;
    texts of any length are scanned whole; extra columns are ignored.
    """

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            langs = [x if isinstance(x, str) else None for x in f["lang"]]
            rows = [(k, a, b) for k, t, lang in zip(f["doc_id"], f["text"], langs, strict=True) for a, b in sentence_spans(t, lang)]
            yield pd.DataFrame(rows, columns=["doc_id", "start_pos", "end_pos"]).astype("int64")

    return documents.select(F.col("doc_id").cast("long"), "text", "lang").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).mapInPandas(split, OUT)
