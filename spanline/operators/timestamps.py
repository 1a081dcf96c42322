"""Dates and moments in mixed formats and zones, brought to one form."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.moments import read_moment
from ..session import deal, exists, kept_folder, spread

#: Raise when the grammar changes: an older dictionary is then not used.
GRAMMAR = 1
ENTRY = "raw string, site_zone string, grammar int, kind string, moment string"


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        zones = [z if isinstance(z, str) else None for z in f["site_zone"]]
        read = [read_moment(r, z) for r, z in zip(f["raw"], zones, strict=True)]
        yield pd.DataFrame({"raw": f["raw"], "site_zone": zones, "grammar": GRAMMAR, "kind": [k for k, _ in read], "moment": [m for _, m in read]})


def extend_dictionary(claims: DataFrame, path: str) -> DataFrame:
    """The dictionary of distinct (raw, site_zone) at ``path``, with every pair of
    ``claims`` in it. Only pairs that are not there yet are parsed and appended,
    so each distinct string is parsed once however often it occurs or is loaded.
    Each load writes a folder of its own, so two writers at once can at worst
    add equal entries, which are merged on reading.
    """
    spark = claims.sparkSession
    wanted = claims.where(F.col("raw").isNotNull()).select("raw", "site_zone").distinct()
    if exists(spark, path):
        k = _known(spark, path).select(F.col("raw").alias("_r"), F.col("site_zone").alias("_z")).distinct()
        wanted = wanted.join(k, (F.col("raw") == F.col("_r")) & F.col("site_zone").eqNullSafe(F.col("_z")), "left_anti")
    deal(wanted, "raw", "site_zone").mapInPandas(_parse, ENTRY).write.parquet(f"{path}/load={uuid.uuid4().hex}")
    return _known(spark, path).select("raw", "site_zone", "kind", "moment").distinct()


def _known(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRY).parquet(path).where(F.col("grammar") == GRAMMAR)


def normalise_moments(claims: DataFrame, dictionary: str | None = None) -> DataFrame:
    """``claims`` with ``kind`` (minute, day, month, year, unsettled) and ``moment``.

    Method: distinct strings with their zone go into a dictionary that is parsed
    exhaustively once, kept at ``dictionary`` (by default a named folder in the
    shared folder, which later loads extend) and joined back. ``moment`` is the UTC minute, the day, month or year in ISO
    form, or why a claim is unsettled. Defined results: null or empty ``raw`` is
    unsettled (``no reading``); strings are read whole, so a date inside a longer
    text is no reading; repeated rows stay repeated; columns named ``kind`` or
    ``moment`` in the input are replaced; an empty table gives an empty result.
    """
    claims = claims.drop("kind", "moment")
    d = extend_dictionary(claims, dictionary or kept_folder(claims.sparkSession, "moments"))
    d = d.select(F.col("raw").alias("_r"), F.col("site_zone").alias("_z"), "kind", "moment")
    joined = claims.join(d, (F.col("raw") == F.col("_r")) & F.col("site_zone").eqNullSafe(F.col("_z")), "left").drop("_r", "_z")
    return joined.withColumns({"kind": F.coalesce("kind", F.lit("unsettled")), "moment": F.coalesce("moment", F.lit("no reading"))})


def same_moments(moments: DataFrame) -> DataFrame:
    """Pairs of one page's claims written differently that mean the same.

    An equi-join on page, kind and moment, so only pairs that belong to the
    result are formed; the join key is spread over all tasks.
    """
    settled = moments.where(F.col("kind") != "unsettled").select("date_id", "content_hash", "unit_number", "raw", "kind", "moment")
    settled = spread(settled, "content_hash", "unit_number", "kind", "moment")
    b = settled.select(F.col("date_id").alias("date_id_b"), F.col("content_hash").alias("_h"), F.col("unit_number").alias("_u"), F.col("kind").alias("_k"), F.col("moment").alias("_m"), F.col("raw").alias("_raw"))
    at = (F.col("content_hash") == F.col("_h")) & (F.col("unit_number") == F.col("_u")) & (F.col("kind") == F.col("_k")) & (F.col("moment") == F.col("_m"))
    pairs = settled.join(b, at & (F.col("date_id") < F.col("date_id_b")) & (F.col("raw") != F.col("_raw")))
    return pairs.select(F.col("date_id").alias("date_id_a"), "date_id_b").distinct()
