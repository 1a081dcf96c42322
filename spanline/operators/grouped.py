"""Bounded groups: chunking long series and mapping sorted groups in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side, spread, written


def map_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Calls ``fn`` once for every group of rows equal in ``keys``, sorted by ``order``.

    ``fn`` takes and gives columns as numpy arrays. One shuffle and one sort that
    spills; Python then sees the groups in turn, so a worker holds one Arrow
    batch and the group at its end, never a partition. Callers bound the
    groups' sizes (see ``chunked``).
    """

    def groups(frames: Iterator[pd.DataFrame]) -> Iterator[dict]:
        held: list[dict] = []
        last = None
        for frame in frames:
            if not len(frame):
                continue
            cols = {c: frame[c].to_numpy() for c in frame.columns}
            codes = [["\0" if x is None or x != x else x for x in cols[k]] for k in keys]
            change = np.zeros(len(frame), dtype=bool)
            for k in codes:
                values = np.array(k, dtype=object)
                change[1:] |= values[1:] != values[:-1]
            cuts = [0, *np.flatnonzero(change), len(frame)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(k[a] for k in codes)
                if held and key != last:
                    yield _joined(held)
                    held = []
                held.append({c: v[a:b] for c, v in cols.items()})
                last = key
        if held:
            yield _joined(held)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[dict] = []
        size = 0
        for group in groups(frames):
            made = fn(group)
            n = len(next(iter(made.values())))
            if n:
                out.append(made)
                size += n
            if size >= 8192:
                yield pd.DataFrame(_joined(out))
                out, size = [], 0
        if out:
            yield pd.DataFrame(_joined(out))

    return spread(df, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _joined(parts: list[dict]) -> dict:
    return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def _same(keys: list[str], names: list[str]) -> Column:
    out = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        out = out & F.col(k).eqNullSafe(F.col(n))
    return out


def chunked(df: DataFrame, keys: list[str], day: str, order: str, size: int, halo: int = 0) -> DataFrame:
    """Adds ``chunk`` and ``own`` so that no (keys, chunk) group exceeds ``size + 2 * halo`` rows.

    The rows of a group are numbered by ``day`` (null days first) and ``order``
    (an integer), and cut every ``size`` rows. With ``halo`` each chunk also gets
    copies of exactly that many rows before and after it, as far as there are
    any, marked ``own`` false.

    Numbers come from two levels: rows per day are counted before they move, and
    rows are numbered inside their day only. A day of more than ``size`` rows is
    first cut into consecutive ranges of ``order``, so no task numbers more
    than a range. The numbering depends on the rows alone, so a task that runs
    again gives the same chunks.
    """
    at = F.coalesce(F.col(day), F.lit("0001-01-01").cast("date"))
    group = Window.partitionBy(*keys)
    days = df.groupBy(*keys, at.alias("_day")).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    days = days.withColumns({"_before": F.sum("_n").over(group.orderBy("_day")) - F.col("_n"), "_total": F.sum("_n").over(group)})
    names = [f"_k{i}" for i in range(len(keys))]
    days = written(days.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_day").alias("_at"), "_n", "_lo", "_hi", "_before", "_total"), "chunk-days")
    rows = df.withColumn("_day", at)
    same = _same([*keys, "_day"], [*names, "_at"])
    hot = days.where(F.col("_n") > size)
    if not hot.limit(1).count():
        numbered = rows.join(days, same)
        within = F.row_number().over(Window.partitionBy(*names, "_at").orderBy(order))
        numbered = numbered.withColumn("_pos", F.col("_before") + within - 1)
    else:
        hot = small_side(hot)
        usual = rows.join(days.where(F.col("_n") <= size), same)
        usual = usual.withColumn("_pos", F.col("_before") + F.row_number().over(Window.partitionBy(*names, "_at").orderBy(order)) - 1)
        ranges = F.ceil(F.col("_n") * 4 / size)
        part = F.floor((F.col(order) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(1.0)) * ranges).cast("int")
        heavy = rows.join(hot, same).withColumn("_part", part)
        parts = heavy.groupBy(*names, "_at", "_part").agg(F.count(F.lit(1)).alias("_m"))
        ahead = F.sum("_m").over(Window.partitionBy(*names, "_at").orderBy("_part")) - F.col("_m")
        parts = parts.select(*[F.col(c).alias(f"_p{c}") for c in (*names, "_at", "_part")], ahead.alias("_ahead"))
        heavy = spread(heavy, *names, "_at", "_part")
        heavy = heavy.withColumn("_pos", F.row_number().over(Window.partitionBy(*names, "_at", "_part").orderBy(order)))
        heavy = heavy.join(small_side(parts), _same([*names, "_at", "_part"], [f"_p{c}" for c in (*names, "_at", "_part")]))
        heavy = heavy.withColumn("_pos", F.col("_before") + F.col("_ahead") + F.col("_pos") - 1)
        numbered = usual.unionByName(heavy.select(*usual.columns))
    c = F.floor(F.col("_pos") / size).cast("long")
    place = lambda n, own: F.struct(n.alias("c"), F.lit(own).alias("own"))
    places = F.array(place(c, True))
    if halo:
        # short chunks lend rows to more than the next one
        reach = math.ceil(halo / size)
        others = [place(c + k, False) for k in range(-reach, reach + 1) if k]
        first, last = lambda p: p["c"] * size - halo, lambda p: (p["c"] + 1) * size + halo
        within = lambda p: (p["c"] >= 0) & (p["c"] * size < F.col("_total")) & (F.col("_pos") >= first(p)) & (F.col("_pos") < last(p))
        places = F.concat(places, F.filter(F.array(*others), within))
    out = numbered.withColumn("_place", F.explode(places)).withColumns({"chunk": F.col("_place.c"), "own": F.col("_place.own")})
    return out.drop("_day", "_at", "_n", "_lo", "_hi", "_before", "_total", "_pos", "_place", *names)
