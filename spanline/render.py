"""Answers as fixed-width text for a terminal."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame

#: Rows of a section that a terminal shows; the rest is counted.
MOST_SHOWN = 30


def safe(value: object) -> str:
    """Text without control, format or private characters."""
    text = "" if value is None else str(value)
    return "".join(f"\\u{ord(c):04x}" if unicodedata.category(c).startswith("C") else c for c in text)


def table(df: DataFrame, columns: list[str], most: int = MOST_SHOWN) -> str:
    """The first rows of ``df`` as a table, and how many more there are."""
    rows = df.select(*columns).limit(most + 1).collect()
    shown = [[safe(v) for v in r] for r in rows[:most]]
    widths = [max([len(c), *(len(r[i]) for r in shown)]) for i, c in enumerate(columns)]
    lines = ["  ".join(c.ljust(w) for c, w in zip(columns, widths, strict=True)).rstrip()]
    lines += ["  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in shown]
    if len(rows) > most:
        lines.append("… and more")
    return "\n".join(lines)
