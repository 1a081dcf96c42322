"""Mixing sources to target shares of the total size in tokens."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Ranks of the public tokenizer that sizes are counted in; a parameter everywhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Sources that a target table may name; it is refused beyond.
MOST_SOURCES = 10_000
# Fixed value: the pattern that splits text before the merges of the public
# byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows of a slice of a source's shuffled order, about; prefix sums run over
#: slices, then inside them.
SLICE_ROWS = 50_000


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = PATTERN):
    """The tokenizer whose ranks lie at ``path``, loaded once a worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens`` for every document; null texts have 0 tokens."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode_ordinary
        for f in frames:
            sizes = [len(encode(t)) if isinstance(t, str) else 0 for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "source": f["source"], "tokens": sizes})

    return documents.select("doc_id", "source", "text").mapInPandas(count, "doc_id long, source string, tokens long")


def _last_time(rows: list, budget: float) -> float:
    """Virtual time at which the tokens admitted so far reach the budget; sources
    that have run out admit no more."""
    ends = sorted((r["tokens"] * r["max_repeats"] / r["target_share"], r["target_share"]) for r in rows if r["target_share"] > 0 and r["tokens"] > 0)
    time, spent, weight = 0.0, 0.0, sum(w for _, w in ends)
    for end, w in ends:
        if weight <= 0 or spent + (end - time) * weight >= budget:
            break
        spent, time, weight = spent + (end - time) * weight, end, weight - w
    return time + (budget - spent) / weight if weight > 1e-12 else time


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    """The mix in its order: ``doc_id, source, repeat, tokens, finish``.

    Method: weighted fair queueing. Each source's documents are shuffled (by a
    keyed hash, anew for each repetition) and get a virtual finish time, their
    cumulative tokens over the target share; the mix is all documents in order
    of that time until ``budget`` tokens (default: the size of all documents).
    A source that has been used ``max_repeats`` times is out and the others go
    on in proportion, so the budget is met while any source lasts.

    Cumulative sums run in two levels over slices of the shuffled order, as many
    as a source's counted documents need, so a source of a third of all rows is
    many windows; the end of the mix follows from the sources' sizes alone.
    Defined results: documents without a target are left out; empty texts have
    size 0 and come along for free; repeated document ids are separate rows.
    """
    return queued(documents, targets, budget, seed, tokenizer).orderBy("finish", "source", "doc_id")


def queued(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    """The rows of the mix with their finish times, in no order."""
    return _queued(written(with_tokens(documents, tokenizer), "mix-tokens"), targets, budget, seed)


def _queued(sized: DataFrame, targets: DataFrame, budget: int | None, seed: int = 7) -> DataFrame:
    sizes = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    plan = targets.select("source", "target_share", "max_repeats").where(F.col("source").isNotNull() & (F.col("target_share") > 0)).join(sizes, "source").limit(MOST_SOURCES + 1).collect()
    if len(plan) > MOST_SOURCES:
        raise ValueError("more targets than MOST_SOURCES")
    budget = sized.agg(F.sum("tokens").alias("n")).first()["n"] or 0 if budget is None else budget
    last = _last_time(plan, budget)
    spark = sized.sparkSession
    # One row a source, at most MOST_SOURCES; repetitions are spread on the executors.
    schema = "source string, share double, repeats int, size long, slices int"
    by_source = spark.createDataFrame([(r["source"], float(r["target_share"]), r["max_repeats"], r["tokens"], max(1, -(-r["rows"] // SLICE_ROWS))) for r in plan], schema)
    needed = F.least(F.col("repeats"), F.floor(F.lit(last) * F.col("share") / F.greatest("size", F.lit(1))).cast("int") + 1)
    rows = sized.join(F.broadcast(by_source), "source").where(F.col("repeats") > 0).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.greatest(needed, F.lit(1)))))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "repeat", "doc_id"))
    # equal parts of the hash's range, in its order
    rows = rows.withColumn("_slice", F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * F.col("slices")).cast("int"))
    slices = rows.groupBy("source", "repeat", "_slice").agg(F.sum("tokens").alias("_n"))
    # A window over the slices of one source and repetition.
    slices = slices.withColumn("_base", F.sum("_n").over(Window.partitionBy("source", "repeat").orderBy("_slice")) - F.col("_n")).drop("_n")
    within = F.sum("tokens").over(Window.partitionBy("source", "repeat", "_slice").orderBy("_h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_within", within).join(slices, ["source", "repeat", "_slice"])
    rows = rows.withColumn("finish", ((F.col("repeat") - 1) * F.col("size") + F.col("_base") + F.col("_within")) / F.col("share"))
    return rows.where(F.col("finish") <= last).select("doc_id", "source", "repeat", "tokens", "finish")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, tokens, repeats, actual_share`` of a mix: what
    it holds of each source, and how often it goes through it. The mix is read once."""
    used = written(mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("repeat").alias("repeats")), "mix-used")
    rows = targets.where(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").join(used, "source", "left")
    total = float(used.agg(F.sum("tokens").alias("total")).first()["total"] or 0)
    rows = rows.withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "repeats": F.coalesce("repeats", F.lit(0))})
    return rows.withColumn("actual_share", F.col("tokens") / F.lit(total) if total else F.lit(0.0))


def short_sources(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``source, target_share, actual_share`` of the sources that cannot reach
    their target of the size of all documents.

    The mix to that size is queued; a source is short if it has run out there,
    all its repetitions being in the mix, below its share of the size. Of a
    source with a share and no documents at all nothing is in the mix. Defined
    results: a share of 0 is always reached; with no documents nothing is short."""
    sized = written(with_tokens(documents, tokenizer), "mix-tokens")
    sizes = sized.groupBy(F.col("source").alias("_s")).agg(F.sum("tokens").alias("size"))
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    rows = shares(_queued(sized, targets, total), targets).join(sizes, F.col("source") == F.col("_s"), "left")
    out = F.col("tokens") == F.coalesce("size", F.lit(0)) * F.greatest("max_repeats", F.lit(0))
    return rows.where(out & (F.col("tokens") < F.col("target_share") * F.lit(total))).select("source", "target_share", "actual_share")
