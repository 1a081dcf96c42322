"""String operators of the engine as Column expressions, with Python twins where
the driver needs them too."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Invisible characters, apostrophes, twelve look-alike letters,
# minus signs and endings that results depend on.
INVISIBLE = "​‌‍⁠﻿­"
APOSTROPHES = "’‘ʼʹ`´′"
ALIKE_LATIN = "abekmopctyxi"
ALIKE_CYRILLIC = "авекморстухі"
MINUS = "−﹣"
ENDINGS = (
    "ової евої",
    "ами ями ого его ому ему ова ева ові еві",
    "ий ый ой ей ою ею ую юю ая яя ое ее ые ие ых их ым им ом ем ах ях ів ов ев ам ям ої ім",
    "у ю а я ы и і е є о ь й",
)
WORD = r"[\p{L}\p{N}_']+(?:[-/.][\p{L}\p{N}_']+)*"


def _one_script(match: re.Match) -> str:
    """A run of letters of both scripts in the one most of its letters have."""
    run = match[0]
    latin = sum("a" <= c <= "z" for c in run)
    cyrillic = sum("Ѐ" <= c <= "ӿ" for c in run)
    if not (latin and cyrillic):
        return run
    pair = (ALIKE_LATIN, ALIKE_CYRILLIC) if cyrillic >= latin else (ALIKE_CYRILLIC, ALIKE_LATIN)
    return run.translate(str.maketrans(*pair))


def normalise_text(text: str | None) -> str | None:
    """Comparable form: compatibility forms, case, apostrophes, scripts, decimal
    commas and white space are unified. Null stays null."""
    if text is None:
        return None
    text = unicodedata.normalize("NFKC", text)
    table = dict.fromkeys(map(ord, INVISIBLE)) | dict.fromkeys(map(ord, APOSTROPHES), "'")
    text = text.translate(table).casefold().replace("ё", "е")
    text = re.sub(r"[^\W\d_]+", _one_script, text)
    return " ".join(re.sub(r"(?<=\d),(?=\d)", ".", text).split())


@F.pandas_udf(StringType())
def _normalise(texts: pd.Series) -> pd.Series:
    return texts.map(normalise_text, na_action="ignore")


#: Text that needs no Python to be normalised: ASCII and Cyrillic letters, the
#: scripts not mixed in a word.
SIMPLE = r"^[\x00-\x7FЀ-џҐґ]*$"
MIXED = r"[A-Za-z][Ѐ-џҐґ]|[Ѐ-џҐґ][A-Za-z]"


def normalise(text: Column) -> Column:
    """Comparable form; plain ASCII and Cyrillic never leave the JVM."""
    lower = F.translate(F.lower(F.replace(text, F.lit("`"), F.lit("'"))), "ё", "е")
    plain = F.trim(F.regexp_replace(F.regexp_replace(lower, r"(?<=\d),(?=\d)", "."), r"\s+", " "))
    simple = text.rlike(SIMPLE) & ~text.rlike(MIXED)
    return F.when(~simple, _normalise(F.when(~simple, text))).otherwise(plain)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def fold_signs(text: Column) -> Column:
    """Minus signs as hyphens."""
    return F.translate(text, MINUS, "--")


def edges(text: Column) -> Column:
    """Normalised text with plain signs, no space between a comparator and its
    number, and no punctuation at its edges."""
    return F.regexp_replace(F.regexp_replace(fold_signs(text), r"([<>≤≥]=?)\s+(?=[+-]?\d)", "$1"), r"^[ :;,.|]+|[ :;,.|]+$", "")


def clean(text: Column) -> Column:
    """The form in which claims and rows are compared; null stays null."""
    return edges(normalise(text))


def tokens(text: Column) -> Column:
    """Words with their inner hyphens, slashes, stops and apostrophes."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def contains_token(text: Column, needle: Column) -> Column:
    """Whether ``needle`` stands in ``text`` as a token of its own."""
    return F.rlike(text, F.concat(F.lit(r"(?U)(?<![\w.])\Q"), needle, F.lit(r"\E(?!\w|\.\d)")))


def stem(word: Column) -> Column:
    """The word without its ending, as far as plain rules tell."""
    n = F.length(word)
    by_ascii = F.when(F.endswith(word, F.lit("ies")), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y")))
    by_ascii = by_ascii.when(F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("ss")), F.substring(word, F.lit(1), n - 1)).otherwise(word)
    by_ending = None
    for group in ENDINGS:
        k = len(group.split()[0])
        hit = F.right(word, F.lit(k)).isin(group.split()) & (n - k >= 4)
        cut = F.substring(word, F.lit(1), n - k)
        by_ending = F.when(hit, cut) if by_ending is None else by_ending.when(hit, cut)
    result = F.when(word.rlike(r"^[\x00-\x7F]*$"), by_ascii).when(word.rlike(r"[Ѐ-ӿ]"), by_ending.otherwise(word)).otherwise(word)
    return F.when(n >= 5, result).otherwise(word)


def stems(words: Column) -> Column:
    """Stems of an array of words."""
    return F.transform(words, stem)


def label_key(label: Column) -> Column:
    """Normalised words of a label joined by single spaces."""
    return F.array_join(tokens(normalise(label)), " ")


def stem_key(label: Column) -> Column:
    """Stems of the label's words joined by single spaces."""
    return F.array_join(stems(tokens(normalise(label))), " ")


def contains_phrase(words: Column, phrase: Column) -> Column:
    """Whether the words of ``phrase`` follow one another in ``words``.

    An empty phrase is in nothing."""
    sep = F.lit("\u0001")
    return (F.size(phrase) > 0) & F.contains(F.concat(sep, F.array_join(words, "\u0001"), sep), F.concat(sep, F.array_join(phrase, "\u0001"), sep))


def fragments(phrases: list[str]) -> list[str]:
    """For each phrase (stems joined by spaces) a substring that every normalised
    text with the phrase holds: its longest stem less the last letter, three
    letters at least."""
    longest = [max(p.split(" "), key=len) for p in phrases if p]
    return sorted({w[: max(3, len(w) - 1)] for w in longest})


def safe(text: Column) -> Column:
    """Control and format characters replaced, for output on a terminal."""
    return F.regexp_replace(text, r"\p{C}", "�")
