"""Resolving free labels to concepts of the term list, inside the core.

Works on *distinct* labels: a label is cleaned (width forms, look-alikes,
qualifiers), then looked up by deletion neighbourhoods, so the cost per label
does not depend on the number of terms.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import deal

# Look-alike letters, Latin to Cyrillic, and Greek to Latin.
LATIN = "abceikmhoptxyjsABCEIKMHOPTXYJS"
CYRILLIC = "аьсеікмнортхујѕАВСЕІКМНОРТХУЈЅ"
GREEK = "οΟΑΒΕΖΗΙΚΜΝΡΤΥΧαινρτυχ"
GREEK_AS_LATIN = "oOABEZHIKMNPTYXaivptux"
TO_CYRILLIC = str.maketrans(LATIN, CYRILLIC) | {ord("b"): "в", ord("g"): "г"}
TO_LATIN = str.maketrans(CYRILLIC, LATIN) | str.maketrans(GREEK, GREEK_AS_LATIN) | {ord("в"): "b"}

INVISIBLE = dict.fromkeys((0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF), None)
QUALIFIER = re.compile(r"\([^)]*\)|\[[^\]]*\]|\*")
LEAD = re.compile(r"^(?:ser\.|[ps]-|исслед\.:|дослідж\.:|каб\.|clinic,|dept\. of|referral:|test:)\s*", re.I)
TAIL = re.compile(r"(?:[,\s]+(?:venous|венозная|венозна|level|dept\.?|unit|clinic|отделение|кабинет))\s*$", re.I)


def _script(ch: str) -> str:
    name = unicodedata.name(ch, "")
    return name.split(" ", 1)[0] if ch.isalpha() else ""


def plain(text: str) -> str:
    """Compatibility forms, invisible characters and mixed-script words made plain."""
    text = unicodedata.normalize("NFKC", text).translate(INVISIBLE).replace("‐", "-").replace("‑", "-")
    out = []
    for part in re.split(r"(\w+)", text):
        scripts = [s for s in map(_script, part) if s]
        if len(set(scripts)) > 1 or "GREEK" in scripts:
            latin, cyrillic = scripts.count("LATIN"), scripts.count("CYRILLIC")
            part = part.translate(TO_CYRILLIC if cyrillic > latin and "GREEK" not in scripts else TO_LATIN)
        out.append(part)
    return " ".join("".join(out).casefold().split())


def squash(text: str) -> str:
    """Only letters and digits, so spacing and hyphens do not matter."""
    return "".join(ch for ch in text if ch.isalnum())


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with neighbour swaps, or ``most + 1`` when larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return row[-1]


def allowed(length: int) -> int:
    """Edits a key of this length may be away."""
    return 0 if length < 3 else 1 if length < 6 else 2


def _deletions(key: str, most: int) -> set[str]:
    return {"".join(c for i, c in enumerate(key) if i not in gone) for n in range(min(most, len(key)) + 1) for gone in map(set, combinations(range(len(key)), n))}


class LabelIndex:
    """Terms of one kind, indexed by exact key, deletion neighbourhood and prefix."""

    def __init__(self, terms: Iterable[tuple[str, str]]) -> None:
        self.exact: dict[str, set[str]] = defaultdict(set)
        self.near: dict[str, set[str]] = defaultdict(set)
        for concept, label in terms:
            words = plain(label).split()
            for w in {tuple(words), tuple(words[1:] + words[:1]), tuple(words[-1:] + words[:-1])}:
                self.exact[squash(" ".join(w))].add(concept)
        for key in self.exact:
            for d in _deletions(key, allowed(len(key))):
                self.near[d].add(key)

    def _best(self, key: str) -> tuple[int, set[str]]:
        if key in self.exact:
            return 0, self.exact[key]
        most = allowed(len(key))
        found: dict[int, set[str]] = defaultdict(set)
        for term in {t for d in _deletions(key, most) for t in self.near.get(d, ())}:
            n = edits(key, term, min(most, allowed(len(term))))
            if n <= min(most, allowed(len(term))):
                found[n] |= self.exact[term]
        return min(found.items(), default=(9, set()))

    def _prefix(self, key: str) -> set[str]:
        if len(key) < 4:
            return set()
        hits = {t for t in self.exact if t.startswith(key)} or {t for t in self.exact if len(t) >= len(key) and edits(t[: len(key)], key, 1) <= 1}
        return set().union(*(self.exact[t] for t in hits)) if hits else set()

    def match(self, label: str | None) -> str | None:
        """The one concept a label means, or ``None``."""
        if not label or len(label) > 200:
            return None
        base = plain(label)
        forms = [base]
        bare = QUALIFIER.sub(" ", base).strip()
        for _ in range(3):
            forms.append(bare)
            bare = TAIL.sub("", LEAD.sub("", bare)).strip(" ,:;")
        forms.append(bare)
        keys = [squash(f) for f in dict.fromkeys(forms)]
        keys += [k for f in forms for t in (TO_LATIN, TO_CYRILLIC) if (k := squash(f.translate(t))) not in keys]
        results = [self._best(k) for k in keys]
        if any(f.rstrip().endswith(".") for f in forms):
            results += [(1, self._prefix(squash(f))) for f in forms]
        results = [r for r in results if r[1]]
        if not results:
            return None
        least = min(n for n, _ in results)
        concepts = set().union(*(c for n, c in results if n == least))
        return min(concepts) if len(concepts) == 1 else None


def resolve_labels(df: DataFrame, label: str, terms: DataFrame, kind: str, out: str = "concept_id") -> DataFrame:
    """``df`` with the concept each ``label`` means, null where none.

    Labels are first made distinct (a map-side combined aggregate), looked up
    once each, and joined back.  ``terms`` is the fixed canonical list; its size
    is checked against ``MOST_TERMS`` before it is sent to the executors.
    """
    pairs = canonical_terms(terms, kind)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(pairs)

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = LabelIndex(shared.value)
        for frame in frames:
            yield pd.DataFrame({"_label": frame["_label"], out: [index.match(x) for x in frame["_label"]]})

    distinct = deal(df.select(F.col(label).alias("_label")).where(F.col(label).isNotNull()).distinct(), "_label")
    found = distinct.mapInPandas(look_up, f"_label string, {out} string").where(F.col(out).isNotNull())
    return df.join(found, df[label] == found["_label"], "left").drop("_label")


#: The canonical list is fixed; beyond this it is refused, not silently sent.
MOST_TERMS = 100_000


def canonical_terms(terms: DataFrame, kind: str) -> list[tuple[str, str]]:
    """The bounded term list of a kind as pairs (concept, label)."""
    rows = terms.where(F.col("kind") == kind).select("concept_id", "term_label").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError("the canonical list exceeds MOST_TERMS")
    return sorted((r[0], r[1]) for r in rows if r[0] and r[1])
