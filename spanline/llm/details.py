"""Personal details in free text: found, and replaced by typed placeholders."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tagger
from .lookalikes import plain_text, suspect
from .pii_training import WEIGHTS

#: What ``plausible`` asks of every detail: a capital letter, an at-sign in some
#: writing, or a digit. Plain texts without any would be left without details anyhow.
POSSIBLE = r"\p{Lu}|@|at[\)\]]|\p{Nd}"


def plausible(kind: str, text: str) -> bool:
    """A last exact check of what the model found."""
    digits = sum(c.isdigit() for c in text)
    if kind == "email":
        return "@" in text or "at)" in text or "at]" in text
    if kind == "phone":
        return digits >= 7
    if kind == "id_number":
        return digits >= 5
    if kind == "address":
        return digits >= 1 and any(c.isalpha() for c in text)
    return sum(c.isalpha() for c in text) >= 3 and any(c.isupper() for c in text)


def possible(column: str) -> Column:
    """Whether the plain form of a text could hold a plausible detail; a text that is
    not plain yet may, whatever its characters look like."""
    return F.col(column).rlike(POSSIBLE) | F.col(column).rlike(suspect())


def snapped(text: str, a: int, b: int, kind: str) -> tuple[int, int, str]:
    """A detail without punctuation at its edges and with its words whole."""
    inside = ".+_-" if kind == "email" else ""
    while a < b and not text[a].isalnum() and text[a] not in "+(":
        a += 1
    while b > a and not text[b - 1].isalnum() and text[b - 1] not in ")":
        b -= 1
    while a > 0 and a < b and text[a].isalnum() and (text[a - 1].isalnum() or text[a - 1] in inside and a > 1 and text[a - 2].isalnum()):
        a -= 1
    while b < len(text) and b > a and text[b - 1].isalnum() and (text[b].isalnum() or text[b] in inside and b + 1 < len(text) and text[b + 1].isalnum()):
        b += 1
    return a, b, kind


def details(texts: list[str], weights: str = WEIGHTS) -> list[list[tuple[int, int, str]]]:
    """Details of every text as (start, end, type); equal texts are tagged once."""
    distinct = list(dict.fromkeys(texts))
    found = dict(zip(distinct, tagger.tag(tagger.load_weights(weights), distinct), strict=True))
    out = []
    for t in texts:
        spans: list[tuple[int, int, str]] = []
        for d in found[t]:
            a, b, kind = snapped(t, *d)
            if b > a and plausible(kind, t[a:b]) and (not spans or a >= spans[-1][1]):
                spans.append((a, b, kind))
        out.append(spans)
    return out


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each detail replaced by its type, the rest as it was."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find_details(df: DataFrame, key: str, column: str, weights: str = WEIGHTS) -> DataFrame:
    """``row_id, pii_type`` for every kind of detail a text holds.

    Method: a character-level bidirectional LSTM with CRF transitions, trained
    in numpy (see ``pii_training``), tags the text in its plain form. Long
    texts are tagged in overlapping windows whose scores are reconciled before
    one global decoding. A narrow map: no shuffle. Defined results: null and
    empty texts hold nothing; texts of any length are read whole; repeated rows
    stay repeated; extra columns are ignored.
    """

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [plain_text(t) for t in f["t"]]
            rows = [(k, kind) for k, spans in zip(f["row_id"], details(texts, weights), strict=True) for kind in dict.fromkeys(s[2] for s in spans)]
            yield pd.DataFrame(rows, columns=["row_id", "pii_type"])

    rows = df.where(F.col(key).isNotNull() & possible(column)).select(F.col(key).cast("long").alias("row_id"), F.col(column).alias("t"))
    return rows.mapInPandas(find, "row_id long, pii_type string")


def redact(df: DataFrame, column: str, out: str = "redacted", weights: str = WEIGHTS) -> DataFrame:
    """``df`` with ``column`` free of details in ``out``; null stays null.

    Placeholders are ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` and
    ``[PERSON]``; everything else keeps its place in the plain form of the text.
    """

    def replace(texts: pd.Series) -> pd.Series:
        plain = [plain_text(t) if isinstance(t, str) else "" for t in texts]
        return pd.Series([redacted(t, s) if isinstance(o, str) else None for o, t, s in zip(texts, plain, details(plain, weights), strict=True)], dtype="object")

    fixed = F.pandas_udf(replace, "string")
    can = possible(column)
    return df.withColumn(out, F.when(can, fixed(F.when(can, F.col(column)))).otherwise(F.col(column)))
