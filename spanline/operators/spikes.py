"""Implausible readings: spikes, stuck values and impossible numbers per source."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .grouped import chunked, map_groups
from .units import normalise_units

#: Measurements one wavelet pass judges at most, and its context on both sides.
CHUNK, HALO = 4096, 32
#: A measurement whose details add up to so many robust deviations, and to so
#: much at least, is a spike.
DETAIL_LIMIT, DETAIL_LEAST = 6.5, 0.18
LEVELS = 3
#: From so many measurements on, a series' own details tell its noise.
ENOUGH = 24
#: Equal measurements in a row that count as stuck.
STUCK = 5
#: Readings so many times above or below the analyte's median over all sources
#: cannot occur in a body; nor can zero and negative ones.
IMPOSSIBLE_RATIO = 50.0
SPLINE = np.array([1, 4, 6, 4, 1]) / 16


def details(series: np.ndarray, known: np.ndarray | None = None, levels: int = LEVELS) -> list[np.ndarray]:
    """Undecimated wavelet details (B3 spline, with holes) of a series.

    Only ``known`` places carry weight in the smooth parts, so a place that is
    not has details against what its neighbours say."""
    n = len(series)
    weight = np.ones(n) if known is None else known.astype(float)
    out, before = [], series
    held = np.where(weight > 0, series, 0.0)
    for j in range(levels):
        step = 2**j
        if n <= 2 * step:
            break
        w, x = (np.pad(a, 2 * step, mode="reflect") for a in (weight, held * weight))
        total = sum(c * w[i * step : i * step + n] for i, c in enumerate(SPLINE))
        smooth = np.divide(sum(c * x[i * step : i * step + n] for i, c in enumerate(SPLINE)), total, out=np.array(before, dtype=float), where=total > 1e-12)
        out.append(before - smooth)
        before = held = smooth
        weight = np.minimum(total, 1.0)
    return out


def noise(found: list[np.ndarray], known: np.ndarray, usual: float) -> float:
    """Deviation of a series' noise: from its own details where there are
    enough of them, though no more than its ``usual`` spread."""
    if len(found) and known.sum() >= ENOUGH:
        own = 1.4826 * float(np.median(np.abs(sum(found)[known])))
        return max(min(own, usual), 0.01)
    return max(usual, 0.01)


def spikes(series: np.ndarray, spread: float) -> np.ndarray:
    """Marks spikes of a log series.

    The details of all levels add up to what a measurement has beyond the
    smooth part of its series. The largest are taken out of the smooth part and
    the series is decomposed again, until none is beyond the limit; what was
    taken out is then judged once more against the smooth part without it, so
    neither echoes nor neighbours hide or fake a spike. ``spread`` is the usual
    spread of the source. Of fewer than three measurements none can be told to
    be the spike."""
    n = len(series)
    marks = np.zeros(n, dtype=bool)
    if n < 3:
        return marks
    for _ in range(n):
        found = details(series, ~marks)
        rest = np.abs(sum(found))
        limit = max(DETAIL_LIMIT * noise(found, ~marks, spread), DETAIL_LEAST)
        beyond = ~marks & (rest > limit)
        if not beyond.any() or 2 * (marks.sum() + 1) > n:
            break
        # in short series a spike's echo is as large; the median tells them apart
        score = rest + np.abs(series - np.median(series[~marks])) if n < ENOUGH else rest
        marks |= beyond & (score >= 0.6 * score[beyond].max())
    return marks & (rest > limit) if marks.any() else marks


def zero_runs(values: np.ndarray, least: int) -> np.ndarray:
    """Marks runs of ``least`` or more equal values: runs of zero Haar details."""
    marks = np.zeros(len(values), dtype=bool)
    if len(values) < least:
        return marks
    same = np.abs(np.diff(values)) <= 1e-9 * np.abs(values[1:])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(int), [0]])))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if b - a + 1 >= least:
            marks[a : b + 1] = True
    return marks


def _mark(rows: dict) -> dict:
    value, bound = rows["value_common"].astype(float), rows["analyte_level"].astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.log(value)
    impossible = (value <= 0) | (np.abs(logs - bound) > np.log(IMPOSSIBLE_RATIO))
    usable = np.isfinite(logs)
    spike = np.zeros(len(value), dtype=bool)
    if usable.any():
        spread = float(rows["spread"].astype(float)[0])
        spike[usable] = spikes(logs[usable], 0.0 if math.isnan(spread) else spread)
    dated = rows["exact_day"].astype(bool)
    stuck = np.zeros(len(value), dtype=bool)
    stuck[dated] = zero_runs(value[dated], STUCK)
    kept = rows["own"].astype(bool) & (spike | stuck | impossible)
    out = {c: rows[c][kept] for c in ("source_id", "concept_id", "delivery", "day")}
    return out | {"spike": spike[kept], "stuck": stuck[kept], "impossible": impossible[kept]}


MARKED = "source_id string, concept_id string, delivery long, day date, spike boolean, stuck boolean, impossible boolean"


def implausible(facts: DataFrame, concepts: DataFrame, terms: DataFrame) -> DataFrame:
    """Facts with implausible readings: ``fact_id, spike, stuck, impossible``.

    Method: numbers are brought to the common unit, repeated deliveries are
    counted once, and each source's and analyte's log series, by day, is
    decomposed into undecimated wavelet details. A measurement whose details
    exceed ``DETAIL_LIMIT`` robust deviations of the series' details is a spike;
    runs of zero detail over ``STUCK`` or more days' measurements are stuck;
    bounds mark what cannot be: numbers that are not positive, and those
    ``IMPOSSIBLE_RATIO`` times off the analyte's median over all sources.

    The usual spread of a source and the bounds are aggregates over all its
    rows; the decomposition runs in chunks with exact context around them.
    Defined results: facts without number or listed analyte are never flagged;
    undated facts can be spikes, never stuck; of one or two measurements of an
    analyte only impossible ones are found; measurements of one day follow one
    another by fact_id; an empty input gives an empty result.
    """
    units = normalise_units(facts, concepts, terms).where(F.col("value_common").isNotNull())
    units = written(units.select("fact_id", "source_id", "concept_id", "day", "exact_day", "delivery", "value_common"), "spikes-units")
    once = units.groupBy("source_id", "concept_id", "delivery").agg(F.min("fact_id").alias("fact_id"), F.min("day").alias("day"), F.min("exact_day").alias("exact_day"), F.min("value_common").alias("value_common"))
    logs = F.log(F.when(F.col("value_common") > 0, F.col("value_common")))
    quarters = F.percentile_approx(logs, [0.25, 0.5, 0.75], 10000)
    usual = once.groupBy("source_id", "concept_id").agg(quarters.alias("_q"))
    # a quarter range of white noise is 1.349 deviations
    usual = usual.select(F.col("source_id").alias("_s"), F.col("concept_id").alias("_c"), F.col("_q")[1].alias("level"), ((F.col("_q")[2] - F.col("_q")[0]) / 1.349).alias("spread"))
    usual = written(usual, "spikes-usual")
    analyte = usual.groupBy(F.col("_c").alias("_a")).agg(F.percentile_approx("level", 0.5, 10000).alias("analyte_level"))
    usual = usual.join(analyte, F.col("_c") == F.col("_a"), "left").select("_s", "_c", "spread", "analyte_level")
    rows = chunked(written(once, "spikes-once"), ["source_id", "concept_id"], "day", "fact_id", CHUNK, HALO)
    rows = rows.join(usual, F.col("source_id").eqNullSafe(F.col("_s")) & (F.col("concept_id") == F.col("_c")), "left").drop("_s", "_c")
    marked = map_groups(rows, ["source_id", "concept_id", "chunk"], ["day", "fact_id"], _mark, MARKED)
    marked = marked.select(F.col("source_id").alias("_s"), F.col("concept_id").alias("_c"), F.col("delivery").alias("_d"), "spike", "stuck", "impossible")
    same = F.col("source_id").eqNullSafe(F.col("_s")) & (F.col("concept_id") == F.col("_c")) & (F.col("delivery") == F.col("_d"))
    return units.join(marked, same).select("fact_id", "spike", "stuck", "impossible")
