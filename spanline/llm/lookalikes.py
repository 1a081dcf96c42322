"""One consistent form for text that looks alike but differs in its characters."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import canonical_terms

# Letters of two scripts that look the same, side by side.
LATIN_CYRILLIC = "AА BВ CС EЕ HН IІ JЈ KК MМ OО PР SЅ TТ XХ YУ aа cс eе iі jј oо pр sѕ xх yу kк mм tт hн bв hһ"
LATIN_GREEK = "AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ YΥ XΧ oο vν pρ iι aα uυ yγ kκ xχ"
CYRILLIC_GREEK = "АΑ ВΒ ЕΕ НΗ ІΙ КΚ МΜ ОΟ РΡ ТΤ ХΧ УΥ оο рρ іι аα кκ хχ"
INVISIBLE = "­​‌‍‎‏⁠⁡⁢⁣⁤﻿᠎"
HYPHENS = "‐‑⁃﹣－"
#: Plain in ordinary writing although they have a compatibility form, and the
#: Thai and Lao vowels whose decomposition is not how they are written.
PLAIN = "…№µ™ªº²³¹ำຳ¼½¾´¨¯¸"
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")
MICRO = regex.compile(r"μ(?=g\b|mol\b|kat\b|l\b|L\b|IU\b|U\b)")


def _closed(pairs: dict[str, str]) -> dict[str, str]:
    """The mapping checked: no output holds an input, so one pass is final."""
    for key, value in pairs.items():
        if any(k in value for k in pairs if len(k) == 1 and k in value):
            raise ValueError(f"conflict at {key!r}")
    return pairs


@lru_cache(maxsize=1)
def width_table() -> dict[str, str]:
    """Clusters that are written otherwise in plain text: built from the character
    properties, not listed."""
    pairs: dict[str, str] = {}
    for cp in range(0x80, min(sys.maxunicode, 0x1FFFF) + 1):
        c = chr(cp)
        if c in PLAIN or unicodedata.category(c) in ("Cs", "Co", "Cn"):
            continue
        if c in INVISIBLE:
            pairs[c] = ""
        elif c in HYPHENS:
            pairs[c] = "-"
        elif unicodedata.category(c) == "Zs":
            pairs[c] = " "
        else:
            form = unicodedata.decomposition(c)
            if form.startswith("<"):
                plain = unicodedata.normalize("NFKC", c)
                if plain != c and not plain.startswith(" "):
                    pairs[c] = plain
            elif form and unicodedata.normalize("NFC", c) != c:
                pairs[c] = unicodedata.normalize("NFC", c)  # another sign for the same letter
            elif form.count(" ") == 1:
                base, mark = (chr(int(x, 16)) for x in form.split())
                for b in (base, unicodedata.normalize("NFD", base)) if unicodedata.combining(mark) else ():
                    pairs[b + mark] = c
    for key, value in list(pairs.items()):  # values that hold inputs are rewritten until none does
        while True:
            new = "".join(pairs.get(ch, ch) for ch in value)
            if new == value:
                break
            value = new
        pairs[key] = value
    return _closed(pairs)


def _table(pairs: str, forward: bool) -> dict[str, str]:
    out: dict[str, str] = {}
    for pair in pairs.split():
        a, b = pair if forward else pair[::-1]
        out.setdefault(a, b)
    return out


@lru_cache(maxsize=1)
def script_tables() -> dict[str, dict[str, str]]:
    """For each script, look-alike letters of the other scripts and their own form."""
    return {
        "LATIN": _closed(_table(LATIN_CYRILLIC, False) | _table(LATIN_GREEK, False)),
        "CYRILLIC": _closed(_table(LATIN_CYRILLIC, True) | _table(CYRILLIC_GREEK, False)),
        "GREEK": _closed(_table(LATIN_GREEK, True) | _table(CYRILLIC_GREEK, True)),
    }


@lru_cache(maxsize=4096)
def script_of(c: str) -> str:
    """LATIN, CYRILLIC, GREEK, or empty for all else."""
    name = unicodedata.name(c, "").split(" ", 1)[0] if c.isalpha() else ""
    return name if name in SCRIPTS else ""


class Transducer:
    """Longest-match transducer over grapheme clusters.

    A text falls into clusters; from each on, a tree of the table's keys is
    walked and the longest key that ends there is written as its value. What a
    cluster becomes has its marks in their canonical order and composed. Letters
    gather into runs as they are written; a run is written in the script most of
    its letters have, if the others have look-alikes there. ``terms`` are listed
    Latin terms: a text whose letters all look Latin and that then is such a term
    is that term.
    """

    def __init__(self, terms: frozenset[str] = frozenset()) -> None:
        self.root: dict = {}
        for key, value in width_table().items():
            node = self.root
            for c in key:
                node = node.setdefault(c, {})
            node[""] = value
        self.tables = script_tables()
        self.terms = terms
        self.cluster = lru_cache(maxsize=50_000)(self._cluster)

    def _cluster(self, cluster: str) -> str:
        """What one cluster is written as."""
        out: list[str] = []
        i, n = 0, len(cluster)
        while i < n:
            node, value, end, j = self.root, cluster[i], i + 1, i
            while j < n and cluster[j] in node:
                node = node[cluster[j]]
                j += 1
                if "" in node:
                    value, end = node[""], j
            out.append(value)
            i = end
        made = "".join(out)
        # rewritten parts may compose, or need their marks in order
        return made if len(made) < 2 else unicodedata.normalize("NFC", made)

    def _run(self, run: list[str]) -> str:
        scripts = [script_of(c) for c in run]
        counts = {s: scripts.count(s) for s in SCRIPTS if s in scripts}
        if len(counts) < 2:
            return "".join(run)
        # A script whose table rewrites all strangers; of those the majority's, then Cyrillic.
        def rank(s: str) -> tuple:
            strangers = [c for c, x in zip(run, scripts, strict=True) if x and x != s]
            return all(c in self.tables[s] for c in strangers), counts[s], s == "CYRILLIC"

        table = self.tables[max(counts, key=rank)]
        return unicodedata.normalize("NFC", "".join(table.get(c, c) for c in run))

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        out: list[str] = []
        run: list[str] = []
        latin = bool(self.terms)
        for cluster in CLUSTER.findall(text):
            for c in cluster if cluster.isascii() else self.cluster(cluster):
                if c.isalpha() or unicodedata.combining(c):
                    run.append(c)
                    latin = latin and (c in self.tables["LATIN"] or not c.isalpha())
                else:
                    if run:
                        out.append(self._run(run))
                        run = []
                    out.append(c)
        if run:
            out.append(self._run(run))
        made = MICRO.sub("µ", "".join(out)) if "μ" in text else "".join(out)
        if latin:
            as_latin = "".join(self.tables["LATIN"].get(c, c) for c in made)
            return as_latin if as_latin.casefold() in self.terms else made
        return made


CLUSTER = regex.compile(r"\X")
#: Beyond ASCII, what stands in ordinary writing and no key of the table begins with.
ORDINARY = "À-ÖØ-öø-žЀ-ӿ°«»„“”‘’—–¬§№…µ×±"


@lru_cache(maxsize=1)
def suspect() -> str:
    """JVM-side test for text that the transducer may change: any character outside
    ASCII and ordinary writing, or that a key of the table begins with, or letters
    of two scripts side by side."""
    ordinary = regex.compile(f"[{ORDINARY}]")
    plain = [c for c in map(chr, range(0x80, 0x2200)) if ordinary.match(c) and c not in width_table() and unicodedata.normalize("NFC", c) == c]
    ranges: list[list[str]] = []
    for c in plain:
        if ranges and ord(c) == ord(ranges[-1][1]) + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    kept = "".join(a if a == b else f"{a}-{b}" for a, b in ranges)
    latin, other = "[A-Za-zÀ-ÖØ-öø-ž]", "[Ѐ-ӿ]"
    return f"[^\\x00-\\x7F{kept}]|{latin}{other}|{other}{latin}"


@lru_cache(maxsize=4)
def transducer(terms: frozenset[str] = frozenset()) -> Transducer:
    """The compiled transducer, one per worker."""
    return Transducer(terms)


def plain_text(text: str | None, terms: frozenset[str] = frozenset()) -> str | None:
    """``text`` in its one consistent form."""
    return text if text is None or text.isascii() else transducer(terms)(text)


def latin_terms(terms: DataFrame | None) -> frozenset[str]:
    """The listed terms in Latin letters, case-folded."""
    if terms is None:
        return frozenset()
    return frozenset(t.casefold() for kind in ("analyte", "specialty") for _, t in canonical_terms(terms, kind) if t.isascii())


def _changeable(column: str, latin: frozenset[str]) -> Column:
    """JVM-side: whether the transducer may change the text. No row it could
    change is passed by."""
    out = F.col(column).rlike(suspect())
    if latin:
        table = script_tables()["LATIN"]
        seen = F.lower(F.translate(F.col(column), "".join(table), "".join(table.values())))
        out = out | (seen.isin(sorted(latin)) & (seen != F.lower(F.col(column))))
    return out


def normalise_text(df: DataFrame, column: str, out: str = "plain_text", terms: DataFrame | None = None) -> DataFrame:
    """``df`` with ``column`` in its one consistent form in ``out``.

    Method: a compiled longest-match transducer over grapheme clusters, in one
    pass. With ``terms`` a text that as a whole looks like a listed Latin term is
    that term. Rows that the JVM-side test clears are copied without reaching
    Python. Null stays null, empty stays empty; texts of any length are read whole.
    """
    latin = latin_terms(terms)

    @F.pandas_udf("string")
    def fixed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: plain_text(t, latin), na_action="ignore")

    test = _changeable(column, latin)
    return df.withColumn(out, F.when(test, fixed(F.when(test, F.col(column)))).otherwise(F.col(column)))


def changed_rows(df: DataFrame, key: str, column: str, terms: DataFrame | None = None) -> DataFrame:
    """Keys of rows whose text is not in its consistent form, as ``row_id``.

    Rows the JVM-side test clears never reach Python; there is no shuffle. Null
    and empty texts never count; null keys are left out; repeated rows stay repeated.
    """
    latin = latin_terms(terms)

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.loc[[plain_text(t, latin) != t for t in f["_t"]], ["row_id"]]

    rows = df.where(F.col(key).isNotNull() & _changeable(column, latin)).select(F.col(key).cast("long").alias("row_id"), F.col(column).alias("_t"))
    return rows.mapInPandas(test, "row_id long")
