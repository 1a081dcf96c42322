"""Measurements recorded in different units, brought to each analyte's common unit."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import MOST_TERMS, resolve_labels
from ..functions.units import factor, read_interval, read_unit, read_value
from ..session import written
from .grouped import chunked, map_groups

#: Rows of one source and analyte that one Viterbi pass decodes at most.
CHUNK = 4096
#: Chance that a source keeps its unit from one measurement to the next.
STAY = 0.9
#: Rows before and after a part that is decoded, for the level and the path.
HALO = 48
#: Spread of log interval middles, and of log values, about the smooth level,
#: and of log values from one row to the next.
SPREAD_INTERVAL, SPREAD_VALUE, SPREAD_JUMP = 0.15, 0.5, 0.3
#: What one jump, or one distance from the level, can say at most: a reading
#: that is wrong must not change the unit of all that follow.
MOST_JUMP, MOST_LEVEL = 8.0, 30.0
#: The level is drawn through the decoded rows again so often at most.
ROUNDS = 4
FAR = -60.0
#: What a repeated delivery of a fact shares with the first one.
DELIVERED = {
    "content_hash", "file_format", "unit_number", "source_id", "raw_label", "raw_value", "comparator", "value_number", "qualitative", "unit",
    "reference_interval", "flag", "specimen", "timeline_role", "alternatives", "verification", "evidence", "notes",
}

READ = (
    "fact_id long, source_id string, concept_id string, day date, exact_day boolean, delivery long, value double, low double, high double, "
    "stated double, interval_stated double, basis string"
)


def _read(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """Numbers, stated factors and their basis; one pass in Arrow batches."""
    rows = concepts.where("kind = 'analyte'").select("concept_id", "common_unit", "molar_mass").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError("the concept list exceeds MOST_TERMS")
    known = {r[0]: (read_unit(r[1]), r[2]) for r in rows}

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for fact, source, concept, day, exact, delivery, number, raw, unit, interval in zip(f.fact_id, f.source_id, f.concept_id, f.day, f.exact_day, f.delivery, f.number, f.raw_value, f.unit, f.reference_interval, strict=True):
                common, mass = known.get(concept, (None, None))
                value, tail = read_value(raw)
                if number is not None and not math.isnan(number):
                    value = number
                low, high, interval_unit = read_interval(interval)
                by_interval = factor(read_unit(interval_unit), common, mass)
                stated, basis = None, None
                for name, text in (("unit", unit), ("raw_value", tail), ("interval", interval_unit)):
                    stated = factor(read_unit(text), common, mass)
                    if stated is not None:
                        basis = name
                        break
                out.append((fact, source, concept, day, exact, delivery, value, low, high, stated, by_interval, basis))
            frame = pd.DataFrame(out, columns=["fact_id", "source_id", "concept_id", "day", "exact_day", "delivery", "value", "low", "high", "stated", "interval_stated", "basis"])
            yield frame.astype({k: "float64" for k in ("value", "low", "high", "stated", "interval_stated")})

    return facts.mapInPandas(read, READ)


def viterbi(emit: np.ndarray, stay: float = STAY, jumps: np.ndarray | None = None) -> np.ndarray:
    """Most likely state path; ``emit`` holds log emission by row and state,
    ``jumps[t, j, k]`` what going from state j at row t - 1 to k at row t adds."""
    n, k = emit.shape
    if k == 1 or n == 0:
        return np.zeros(n, dtype=int)
    move = np.full((k, k), math.log((1 - stay) / (k - 1)))
    np.fill_diagonal(move, math.log(stay))
    score, back = emit[0].copy(), np.zeros((n, k), dtype=np.int32)
    for t in range(1, n):
        reach = score[:, None] + (move if jumps is None else move + jumps[t])
        back[t] = reach.argmax(axis=0)
        score = reach.max(axis=0) + emit[t]
    path = np.empty(n, dtype=int)
    path[-1] = int(score.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def smooth_level(known: np.ndarray, start: float, weight: float = 0.1) -> np.ndarray:
    """A slowly moving level under a series with gaps: forward and backward
    exponential means of the known logs, robust against single jumps."""
    def run(series: np.ndarray, level: float) -> np.ndarray:
        out = np.empty(len(series))
        for i, x in enumerate(series):
            if not math.isnan(x):
                level += weight * max(-0.5, min(0.5, x - level))
            out[i] = level
        return out

    ahead = run(known, start)
    return (ahead + run(known[::-1], ahead[-1] if len(ahead) else start)[::-1]) / 2


def jump_scores(states: np.ndarray, series: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """What the log jump from each row to the next says about a change of unit:
    brought to the common unit, a smooth level hardly jumps."""
    change = states[None, :] - states[:, None]
    out = np.zeros((len(series[0][0]), len(states), len(states)))
    for x, spread in series:
        jump = np.concatenate([[np.nan], np.diff(x)])
        score = np.maximum(-((jump[:, None, None] + change[None]) ** 2) / (2 * spread**2), -MOST_JUMP)
        out += np.where(np.isnan(jump)[:, None, None], 0.0, score)
    return out


def _decoded_states(rows: dict, states: np.ndarray, fixed: np.ndarray, free: np.ndarray, state: np.ndarray, middle: np.ndarray, log_value: np.ndarray) -> np.ndarray:
    """States of the ``free`` rows, the others' as they stand."""
    levels = rows["level"].astype(float)
    start = float(levels[0]) if not math.isnan(levels[0]) else 0.0
    # the interval tells more than the value; where both stand it alone is held against the level
    seen = [(middle, SPREAD_INTERVAL), (np.where(np.isnan(middle), log_value, np.nan), SPREAD_VALUE)]
    x = np.where(np.isnan(middle), log_value, middle)
    # A row whose state is fixed cuts the chain; parts between such rows are
    # decoded with the fixed row on either side.
    near = free.copy()
    near[1:] |= free[:-1]
    near[:-1] |= free[1:]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], near.astype(int), [0]])))
    parts = [(a, b, jump_scores(states, [(middle[a:b], SPREAD_INTERVAL), (log_value[a:b], SPREAD_JUMP)])) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    for turn in range(ROUNDS):
        # The first path follows the jumps; the level of what is known, which may
        # have drifted since, only places each part as a whole.
        level = smooth_level(x + state, start)
        emit = fixed.copy()
        emit[free] = 0.0
        for of, spread in seen:
            off = np.maximum(-((of[:, None] + states - level[:, None]) ** 2) / (2 * spread**2), -MOST_LEVEL)
            emit[free] += np.where(np.isnan(of)[:, None], 0.0, off)[free]
        new = state.copy()
        for a, b, jumps in parts:
            part = emit[a:b] if turn else np.where(free[a:b, None], emit[a:b] / (b - a), emit[a:b])
            path = states[viterbi(part, jumps=jumps)]
            new[a:b] = np.where(free[a:b], path, state[a:b])
        if np.array_equal(new, state, equal_nan=True):
            break
        state = new
    return state


def decode(rows: dict, infer_bare: bool = False) -> dict:
    """Viterbi over the unit states of one source's and analyte's series.

    States are the units the analyte's facts state anywhere; stated rows stand
    in theirs. The log jumps between neighbouring rows and the distance from the
    smooth level score the rest, and the level is drawn again through what was
    decoded."""
    factors = rows["factors"][0]
    states = np.array(sorted({0.0, *(factors if factors is not None else ())}))
    stated, value, of_interval = (rows[c].astype(float) for c in ("stated", "value", "interval_stated"))
    low, high = rows["low"].astype(float), rows["high"].astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        middle = (np.log(low) + np.log(high)) / 2
        log_value, own = np.log(value), np.log(stated)
        interval_own = np.where(np.isnan(of_interval), own, np.log(of_interval))
    middle[~np.isfinite(middle)] = np.nan
    log_value[~np.isfinite(log_value)] = np.nan
    decoded = own.copy()
    unstated = np.isnan(own)
    if unstated.any():
        bare = unstated & np.isnan(middle)
        fixed = np.where(np.abs(states - own[:, None]) < 1e-6, 0.0, FAR)
        if not infer_bare:
            fixed = np.where(bare[:, None], np.where(states == 0.0, 0.0, FAR), fixed)
        free = unstated & (np.full(len(bare), infer_bare) | ~bare)
        state = np.where(bare & ~free, 0.0, interval_own)
        if free.any():
            state = _decoded_states(rows, states, fixed, free, state, middle, log_value)
        decoded = np.where(unstated, np.where(free, state, 0.0), own)
        decoded[np.isnan(decoded)] = 0.0
    scale = np.exp(decoded)
    apart = np.where(np.isnan(of_interval), scale, of_interval)
    basis = rows["basis"].astype(object)
    blank = np.array([x is None or x != x for x in basis], dtype=bool)
    basis = np.where(blank, np.where(np.isnan(middle), "values" if infer_bare else "common", "scale"), basis)
    kept = rows["own"].astype(bool)
    out = {c: rows[c] for c in ("fact_id", "source_id", "concept_id", "day", "exact_day", "delivery")}
    out |= {
        "value_common": value * scale, "low_common": low * apart, "high_common": high * apart, "unit_factor": scale, "unit_basis": basis,
        "number_changes": ~np.isnan(value) & (np.abs(decoded) > 1e-6),
    }
    return {c: v[kept] for c, v in out.items()}


OUT = (
    "fact_id long, source_id string, concept_id string, day date, exact_day boolean, delivery long, value_common double, low_common double, high_common double, "
    "unit_factor double, unit_basis string, number_changes boolean"
)


def normalise_units(facts: DataFrame, concepts: DataFrame, terms: DataFrame, infer_bare: bool = False) -> DataFrame:
    """Every fact with a listed analyte, its number and interval in the common unit.

    Method: per source and analyte the unit is the hidden state of a Markov
    chain over the dated series. A unit stated in the unit, in the value's text
    or (with neither) in the interval fixes the state. Elsewhere the log jumps
    from row to row, of values and of interval middles, score changes of unit
    against a smooth underlying level, and Viterbi decodes the path; the level
    starts from the source's own rows and is drawn again through the path. A
    fact with neither unit nor interval takes the common unit, as the rules of
    the data say, or with ``infer_bare`` the state that the chain decodes.

    Defined results: facts without a listed analyte are left out; no readable
    number gives null ``value_common`` and ``number_changes`` false; unreadable
    units count as absent; facts without fact_id are left out; null source ids form one source; undated facts come
    first in their series; repeated fact ids give repeated rows; an empty input
    gives an empty result; further columns of the input are ignored.

    Long series are cut into chunks of ``CHUNK`` rows, so a source holding a
    third of all rows is decoded by many tasks; each chunk is decoded with
    ``HALO`` rows around it and starts from the level of its whole source, which
    is aggregated over all rows beforehand.
    """
    first = F.try_element_at("alternatives", F.lit(1))
    certain = F.coalesce(F.size("alternatives") == 1, F.lit(False))
    day = F.when(certain, first["start_date"]).alias("day")
    exact = F.coalesce(certain & (first["date_precision"] == "day"), F.lit(False)).alias("exact_day")
    # A repeated delivery equals its original in all but fact_id and loaded_at.
    delivery = F.xxhash64(*[F.col(f.name) for f in facts.schema if f.name in DELIVERED]).alias("delivery")
    slim = facts.where(F.col("fact_id").isNotNull()).select("fact_id", "source_id", "raw_label", "raw_value", F.col("value_number").cast("double").alias("number"), "unit", "reference_interval", day, exact, delivery)
    named = resolve_labels(slim, "raw_label", terms, "analyte").where(F.col("concept_id").isNotNull())
    read = written(_read(named, concepts), "units-read")
    log_middle = (F.log(F.when(F.col("low") > 0, F.col("low"))) + F.log(F.when(F.col("high") > 0, F.col("high")))) / 2 + F.log(F.coalesce("interval_stated", "stated"))
    value = F.log(F.when(F.col("value") > 0, F.col("value"))) + F.log("stated")
    by_source = read.groupBy("source_id", "concept_id").agg(F.percentile_approx(log_middle, 0.5, 1000).alias("l1"), F.percentile_approx(value, 0.5, 1000).alias("l2"))
    # One row a concept: the concept list is fixed, and so is the set of factors its units can have.
    by_concept = read.groupBy("concept_id").agg(
        F.percentile_approx(log_middle, 0.5, 1000).alias("l3"), F.percentile_approx(value, 0.5, 1000).alias("l4"),
        F.array_sort(F.collect_set(F.round(F.log("stated"), 9))).alias("factors"),
    )
    rows = chunked(read, ["source_id", "concept_id"], "day", "fact_id", CHUNK, HALO)
    rows = rows.join(by_concept.withColumnRenamed("concept_id", "_c"), F.col("concept_id") == F.col("_c"), "left").drop("_c")
    by_source = by_source.select(F.col("source_id").alias("_s"), F.col("concept_id").alias("_c"), "l1", "l2")
    rows = rows.join(by_source, F.col("source_id").eqNullSafe(F.col("_s")) & (F.col("concept_id") == F.col("_c")), "left")
    rows = rows.withColumn("level", F.coalesce("l1", "l2", "l3", "l4")).drop("_s", "_c", "l1", "l2", "l3", "l4")
    return map_groups(rows, ["source_id", "concept_id", "chunk"], ["day", "fact_id"], lambda f: decode(f, infer_bare), OUT)
