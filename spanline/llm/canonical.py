"""Free-entered values mapped to the closest entries of a reference list."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import canonical_terms
from ..session import deal
from .lookalikes import plain_text, script_tables

# What is written around a term without changing what it means.
LEADS = r"ser\.|[ps]-|исслед\.:|досл\.:|каб\.|кабинет|clinic,|clinic:|dept\.? of|department of|referral:|referred to|test:|serum"
TAILS = r"venous|венозная|венозна|serum|кровь|кров|level|levels|dept\.?|department|unit|clinic|приём|прийом|repeat|повторно"
QUALIFIER = re.compile(r"\([^)]*\)|\[[^\]]*\]|[*†#]")
LEAD = re.compile(rf"^(?:{LEADS})\s*[-:]?\s*")
TAIL = re.compile(rf"[,;\s]+(?:{TAILS})\s*$")
UNMATCHED = "unmatched"


def distance_for(length: int) -> int:
    """Edits that an entry of this many letters and digits may be away."""
    return 0 if length < 3 else 1 if length < 6 else 2 if length < 13 else 3


def squash(text: str) -> str:
    """Letters and digits only, case-folded, ё as е."""
    return "".join(c for c in text.casefold().replace("ё", "е") if c.isalnum())


class Trie:
    """Reference entries with their alias paths, searched by a Levenshtein automaton."""

    def __init__(self, terms: Iterable[tuple[str, str]]) -> None:
        self.root: dict = {}
        self.longest = 0
        for concept, label in terms:
            words = [w for w in re.split(r"[\s,]+", plain_text(label).casefold()) if w]
            turned = {tuple(words[i:] + words[:i]) for i in range(len(words))}
            for order in turned:
                self._add(squash("".join(order)), concept, label)

    def _add(self, key: str, concept: str, label: str) -> None:
        if not key:
            return
        node = self.root
        for c in key:
            node = node.setdefault(c, {})
        node.setdefault("", set()).add((concept, label, len(key)))
        self.longest = max(self.longest, len(key))

    def search(self, query: str, most: int) -> list[tuple[int, str, str]]:
        """All entries within ``most`` edits (insert, drop, change, swap neighbours)
        that their own length allows too: ``(distance, concept, label)``.

        The automaton's states are bit sets: bit i of row j means that the first
        i characters of the query can be read with j edits.
        """
        n = len(query)
        if not n or n > self.longest + most:
            return []
        masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(query):
            masks[c] |= 1 << i
        start, reach = [], 1
        for _ in range(most + 1):
            start.append(reach)
            reach |= reach << 1
        full, accept = (1 << (n + 1)) - 1, 1 << n
        found: dict[tuple[str, str], int] = {}
        stack = [(self.root, [x & full for x in start], None, None)]
        while stack:
            node, rows, before, last = stack.pop()
            for c, child in node.items():
                if c == "":
                    if rows[most] & accept:
                        least = next(j for j, r in enumerate(rows) if r & accept)
                        for concept, label, length in child:
                            if least <= distance_for(length):
                                key = (concept, label)
                                found[key] = min(found.get(key, 99), least)
                    continue
                mask = masks.get(c, 0)
                new = [(rows[0] & mask) << 1]
                for j in range(1, most + 1):
                    r = ((rows[j] & mask) << 1) | rows[j - 1] | (rows[j - 1] << 1) | (new[j - 1] << 1)
                    if last is not None:
                        r |= ((((before[j - 1] & mask) << 1) & masks.get(last, 0)) << 1)
                    new.append(r & full)
                if new[most]:
                    stack.append((child, new, rows, c))
        return sorted((d, concept, label) for (concept, label), d in found.items())

    def complete(self, prefix: str) -> list[tuple[str, str, int]]:
        """Entries that begin with ``prefix``, one edit in it allowed: (concept, label, length)."""
        out: dict[int, list] = {0: [], 1: []}
        n, most = len(prefix), 1
        stack = [(self.root, "")]
        while stack:
            node, read = stack.pop()
            if len(read) == n:
                wrong = sum(a != b for a, b in zip(read, prefix, strict=True))
                if wrong <= most:
                    below = [node]
                    while below:
                        x = below.pop()
                        for c, child in x.items():
                            if c == "":
                                out[wrong] += list(child)
                            else:
                                below.append(child)
                continue
            for c, child in node.items():
                if c and sum(a != b for a, b in zip(read + c, prefix, strict=False)) <= most:
                    stack.append((child, read + c))
        return out[0] or out[1]


def forms(value: str) -> list[str]:
    """The value as it is and without what is written around a term, as keys."""
    base = " ".join(plain_text(value).casefold().split())
    out = [base, QUALIFIER.sub(" ", base).strip()]
    for _ in range(3):
        x = out[-1]
        for cut in (LEAD.sub("", x), TAIL.sub("", x), TAIL.sub("", LEAD.sub("", x))):
            cut = cut.strip(" ,;:-_")
            if cut and cut not in out:
                out.append(cut)
    return [x for x in dict.fromkeys(out) if x]


def keys_of(value: str) -> list[str]:
    """The keys a value is looked up by, in either script."""
    tables = script_tables()
    shapes = forms(value)
    keys = dict.fromkeys(squash(x) for x in shapes)
    for x in shapes:
        for s in ("LATIN", "CYRILLIC"):
            keys.setdefault(squash("".join(tables[s].get(c, c) for c in x)))
    return [k for k in keys if k]


def entries(trie: Trie, value: str | None) -> list[tuple[int, str, str]]:
    """All entries near a value, by any of its keys: ``(distance, concept, label)``,
    nearest first. Keys of one and two letters must be equal to an entry."""
    found: dict[tuple[str, str], int] = {}
    for key in keys_of(value) if value else ():
        for d, concept, label in trie.search(key, distance_for(len(key))):
            found[concept, label] = min(d, found.get((concept, label), d))
    return sorted((d, concept, label) for (concept, label), d in found.items())


def resolve(trie: Trie, value: str | None) -> str:
    """The concept a value means, or ``unmatched``."""
    if not value or not value.strip():
        return UNMATCHED
    best: dict[int, set[str]] = defaultdict(set)
    for d, concept, _ in entries(trie, value):
        best[d].add(concept)
    cut = [squash(x) for x in forms(value) if x.endswith(".") and len(squash(x)) >= 4]
    if 0 not in best and cut:
        ends = {e for key in cut for e in trie.complete(key)}
        concepts = {c for c, _, _ in ends}
        if len(concepts) > 1:  # cut off about half way is likelier than cut off late
            size = len(cut[-1])
            near = min(abs(size / length - 0.6) for _, _, length in ends)
            concepts = {c for c, _, length in ends if abs(size / length - 0.6) == near}
        best[0] |= concepts
    if not best:
        return UNMATCHED
    least = best[min(best)]
    return next(iter(least)) if len(least) == 1 else UNMATCHED


def _looked_up(df: DataFrame, value: str, terms: DataFrame, kind: str, look_up: Callable[[Trie, pd.Series], pd.DataFrame], schema: str) -> DataFrame:
    """``look_up`` over the distinct values, which are combined before they move."""
    shared = df.sparkSession.sparkContext.broadcast(canonical_terms(terms, kind))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(shared.value)
        for f in frames:
            yield look_up(trie, f["_v"])

    distinct = deal(df.select(F.col(value).alias("_v")).where(F.col(value).isNotNull()).distinct(), "_v")
    return distinct.mapInPandas(run, schema)


def near_entries(df: DataFrame, value: str, terms: DataFrame, kind: str) -> DataFrame:
    """``value, concept_id, term_label, distance``: for each distinct value all
    entries within the distance its length allows, ties included. Values without
    any, null and empty ones have no rows."""
    def look_up(trie: Trie, values: pd.Series) -> pd.DataFrame:
        rows = [(v, c, t, d) for v in values for d, c, t in entries(trie, v)]
        return pd.DataFrame(rows, columns=["value", "concept_id", "term_label", "distance"]).astype({"distance": "int64"})

    return _looked_up(df, value, terms, kind, look_up, "value string, concept_id string, term_label string, distance long")


def map_to_list(df: DataFrame, value: str, terms: DataFrame, kind: str, out: str = "concept_id") -> DataFrame:
    """``df`` with the concept of ``terms`` each ``value`` means, or ``unmatched``.

    Method: a tree of the reference entries and their alias paths (turned word
    orders, spacing left out) is walked by a Levenshtein automaton of the value;
    all entries within a distance that grows with their length are returned and
    the nearest concept wins. Values cut off with a full stop complete along the
    tree. Distinct values are looked up once and joined back.

    Defined results: null, empty and tied values are ``unmatched``; values of
    any length are read whole; values of one or two letters must equal an entry; repeated
    rows stay repeated; a column named as ``out`` in ``df`` is replaced.
    """
    def look_up(trie: Trie, values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"_v": values, out: [resolve(trie, v) for v in values]})

    df = df.drop(out)
    found = _looked_up(df, value, terms, kind, look_up, f"_v string, {out} string")
    return df.join(found, df[value] == found["_v"], "left").drop("_v").withColumn(out, F.coalesce(out, F.lit(UNMATCHED)))


def not_listed(df: DataFrame, value: str, terms: DataFrame, kind: str) -> DataFrame:
    """Rows whose value equals no term of its kind, letter case ignored."""
    listed = sorted({t.lower() for _, t in canonical_terms(terms, kind)})
    return df.where(~F.coalesce(F.lower(F.col(value)).isin(listed), F.lit(False)))
