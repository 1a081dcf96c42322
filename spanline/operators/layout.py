"""Page geometry: visual rows, merged words, windows of rows, neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import small_side
from .grouped import map_groups

PAGE = ["content_hash", "unit_number"]
_PAGE_TYPES = "content_hash string, unit_number int"


def position(df: DataFrame, at: str) -> Column:
    """A column on a number line: timestamps in microseconds, numbers as they are."""
    return F.unix_micros(F.col(at).cast("timestamp")) if dict(df.dtypes)[at].startswith("timestamp") else F.col(at)


def _row_numbers(page: dict) -> dict:
    """Rows of one page's spans, boxed ones first and in order of their centre."""
    ys, hs, boxed = page["yc"].astype(float), page["h"].astype(float), page["boxed"].astype(bool)
    number = np.empty(len(ys), dtype=np.int64)
    row, total, count, height = -1, 0.0, 0, 0.0
    for k in range(len(ys)):
        if boxed[k] and count and abs(ys[k] - total / count) <= 0.5 * max(height, hs[k]):
            total, count, height = total + ys[k], count + 1, max(height, hs[k])
        else:
            row += 1
            total, count, height = (ys[k], 1, hs[k]) if boxed[k] else (0.0, 0, 0.0)
        number[k] = row
    return {c: page[c] for c in (*PAGE, "span_index", "text", "norm", "x0", "xc")} | {"yc": np.where(boxed, ys, np.nan), "h": np.where(boxed, hs, np.nan), "row": number}


def cluster_rows(spans: DataFrame, normalised: bool = False) -> DataFrame:
    """Visual rows of every page: ``row, y, height, text, members``.

    Spans in order of their centre join the last row while they stay within half
    the larger height of the row's mean centre; the mean and the largest height
    move with each one, so this is a fold over the sorted page, not a gap rule:
    one pass over Arrow batches, linear in the page. Spans without box follow as
    rows of their own; empty ones are dropped. With ``normalised`` the text is in
    the form claims are compared in, and ``parts`` holds each span's index, text
    in that form and centre, ``said`` the row as written."""
    boxed = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("y1").isNotNull()
    told = F.coalesce("text", F.lit(""))
    items = spans.where(boxed | (F.trim(told) != "")).select(
        *PAGE, "span_index", told.alias("text"), (T.normalise(told) if normalised else told).alias("norm"), "x0", ((F.col("x0") + F.col("x1")) / 2).alias("xc"),
        ((F.col("y0") + F.col("y1")) / 2).alias("yc"), (F.col("y1") - F.col("y0")).alias("h"), boxed.alias("boxed"), (~boxed).alias("_last"))
    rows = map_groups(items, PAGE, ["_last", "yc", "x0", "span_index"], _row_numbers, f"{_PAGE_TYPES}, span_index int, text string, norm string, x0 double, xc double, yc double, h double, row long")
    part = F.struct("x0", F.col("span_index").alias("i"), "text", "norm", "xc")
    made = rows.groupBy(*PAGE, "row").agg(F.avg("yc").alias("y"), F.max("h").alias("height"), F.array_sort(F.collect_list(part)).alias("m"))
    joined = lambda field: F.array_join(F.transform("m", lambda m: m[field]), " ")
    parts = F.transform("m", lambda m: F.struct(m["i"].alias("i"), T.edges(m["norm"]).alias("t"), m["xc"].alias("x")))
    said = F.array_join(F.filter(F.transform("m", lambda m: F.trim(m["text"])), lambda t: t != ""), " ")
    text = T.edges(joined("norm")) if normalised else joined("text")
    out = made.select(*PAGE, F.col("row").cast("int").alias("row"), "y", "height", text.alias("text"), F.transform("m", lambda m: m["i"]).alias("members"), *([parts.alias("parts"), said.alias("said")] if normalised else []))
    return out.where(F.trim("text") != "")


def merge_words(words: DataFrame) -> DataFrame:
    """Recognised words of a line merged into spans where the gap is small.

    A word starts a new span when its gap to the word before exceeds 1.2 times
    the larger height. Words are ``block_num, par_num, line_num, left, top,
    width, height, text``; unreadable rows were dropped on reading."""
    line = ["block_num", "par_num", "line_num"]
    w = Window.partitionBy(*line).orderBy("left", "top", "text")
    before = F.lag(F.struct((F.col("left") + F.col("width")).alias("right"), "height")).over(w)
    rows = words.withColumn("_b", before)
    start = F.col("_b").isNull() | (F.col("left") - F.col("_b.right") > 1.2 * F.greatest(F.col("_b.height"), F.col("height")))
    rows = rows.withColumn("_s", start.cast("int")).withColumn("_g", F.sum("_s").over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("left", "top", "text"))), lambda s: s["text"])
    spans = rows.groupBy(*line, "_g").agg(
        F.array_join(parts, " ").alias("text"), F.min("left").cast("double").alias("x0"), F.min("top").cast("double").alias("y0"),
        F.max(F.col("left") + F.col("width")).cast("double").alias("x1"), F.max(F.col("top") + F.col("height")).cast("double").alias("y1"))
    # centres are rounded half to even, so that rows of equal height sort alike
    return spans.drop("_g").withColumn("line", F.bround((F.col("y0") + F.col("y1")) / 2 / 8, 0)).orderBy("line", "x0")


def row_windows(rows: DataFrame, text: str = "text", longest: int = 3) -> DataFrame:
    """All runs of one to ``longest`` rows of a page: ``row, rows`` and ``text``,
    which may be an array."""
    w = Window.partitionBy(*PAGE).orderBy("row")
    ahead = rows.withColumns({f"_{k}": F.lead(text, k).over(w) for k in range(1, longest)})
    texts = [F.col(text), *[F.col(f"_{k}") for k in range(1, longest)]]
    join = F.concat if dict(rows.dtypes)[text].startswith("array") else lambda *parts: F.concat_ws(" ", *parts)
    runs = F.array(*[F.when(texts[k].isNotNull(), F.struct(F.lit(k + 1).alias("rows"), join(*texts[: k + 1]).alias("t"))) for k in range(longest)])
    return ahead.select(*PAGE, "row", F.explode(F.array_compact(runs)).alias("r")).select(*PAGE, "row", "r.rows", F.col("r.t").alias(text))


def latest_before(df: DataFrame, keys: list[str], order: list[str], keep: Column, value: Column, out: str) -> DataFrame:
    """``value`` of the latest earlier row for which ``keep`` holds: a backward
    as-of join done as one window, without a join."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(F.when(keep, value), ignorenulls=True).over(w))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """For each left row the right value whose ``at`` is nearest, ties to the
    earlier one. Two windows over the union of both sides find the neighbours
    before and after, so no pairs are formed."""
    right = right.withColumn("_at", position(right, at))
    b = right.select(*keys, "_at", F.struct(F.col("_at").alias("at"), F.col(value).alias("v")).alias("_r"))
    a = left.withColumn("_at", position(left, at)).select(*keys, "_at", F.lit(None).cast(b.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))
    both = a.unionByName(b.withColumn("_l", F.lit(None).cast(a.schema["_l"].dataType)))
    w = Window.partitionBy(*keys)
    both = both.withColumn("_p", F.last("_r", ignorenulls=True).over(w.orderBy(F.col("_at"), F.col("_l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("_n", F.last("_r", ignorenulls=True).over(w.orderBy(F.col("_at").desc(), F.col("_l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)))

    def span(c: Column) -> Column:
        return F.abs(c - F.col("_at"))

    later = F.col("_p").isNull() | (F.col("_n").isNotNull() & (span(F.col("_n.at")) < span(F.col("_p.at"))))
    return both.where(F.col("_l").isNotNull()).select("_l.*", F.when(later, F.col("_n.v")).otherwise(F.col("_p.v")).alias(f"nearest_{value}"))


def band_counts(df: DataFrame, keys: list[str], at: str, width: int) -> DataFrame:
    """How many other rows of the same keys lie within ``width`` (microseconds for
    timestamps) before and after: a range window instead of a band self-join, so
    no pairs form."""
    w = Window.partitionBy(*keys).orderBy(position(df, at)).rangeBetween(-width, width)
    return df.withColumn("near", F.count(F.lit(1)).over(w) - 1)


def mentions(windows: DataFrame, phrases: list[str]) -> DataFrame:
    """Windows of rows (``stems``) that hold a phrase (stems joined by spaces).

    Windows are exploded to their runs of stems of the phrases' sizes, whatever
    sizes these are, and met with the phrases; the number of phrases does not
    multiply the rows."""
    sizes = sorted({len(p.split(" ")) for p in phrases})
    spark = windows.sparkSession
    wanted = spark.createDataFrame([(p,) for p in sorted(set(phrases))], "phrase string")
    def runs_of(n: int) -> Column:
        return F.when(F.size("stems") >= n, F.transform(F.sequence(F.lit(1), F.size("stems") - n + 1), lambda i: F.array_join(F.slice("stems", i, n), " ")))

    none = F.array().cast("array<string>")
    grams = F.array_distinct(F.concat(none, *[F.coalesce(runs_of(n), none) for n in sizes]))
    return windows.withColumn("phrase", F.explode(grams)).join(small_side(wanted), "phrase")
