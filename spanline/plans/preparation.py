"""The queries of the general training-data operators (problems 1, 3 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spikes import implausible
from ..operators.timestamps import normalise_moments, same_moments
from ..operators.units import normalise_units
from ..session import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lab facts whose number changes when brought to the common unit."""
    units = normalise_units(load(spark, sf_dir, "lab_facts"), load(spark, sf_dir, "concepts"), load(spark, sf_dir, "concept_terms"))
    return units.where("number_changes").select("fact_id").distinct()


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fact of a listed analyte with number and interval in the common unit."""
    units = normalise_units(load(spark, sf_dir, "lab_facts"), load(spark, sf_dir, "concepts"), load(spark, sf_dir, "concept_terms"))
    return units.select("fact_id", "concept_id", "unit_basis", *[F.round(c, 6).alias(c) for c in ("value_common", "low_common", "high_common")])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lab facts with implausible readings."""
    marked = implausible(load(spark, sf_dir, "lab_facts"), load(spark, sf_dir, "concepts"), load(spark, sf_dir, "concept_terms"))
    return marked.select("fact_id").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one page's date claims that mean the same."""
    return same_moments(normalise_moments(load(spark, sf_dir, "date_claims")))


def p4_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date claim in its one form."""
    return normalise_moments(load(spark, sf_dir, "date_claims")).select("date_id", "kind", "moment")


QUERIES = {f.__name__: f for f in (p1_found, p1_values, p3_found, p4_found, p4_moments)}
