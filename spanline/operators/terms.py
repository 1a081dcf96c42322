"""The dictionary: which concept a label means, and with what confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written

# States of a match, strongest first.
RANKS = {"mapped": 0, "raw": 0, "inflected": 1, "auto-mapped": 2, "ambiguous": 3}


def dictionary(terms: DataFrame) -> DataFrame:
    """Terms with their comparable key and stem key."""
    return terms.select("concept_id", "kind", T.label_key(F.col("term_label")).alias("key"), T.stem_key(F.col("term_label")).alias("stem_key")).distinct()


def decided(log: DataFrame) -> DataFrame:
    """Current verdicts of a decision log; reversed decisions are gone."""
    last = log.groupBy("key", "concept_id").agg(F.max_by("verdict", "seq").alias("verdict"))
    return last.where(F.col("verdict") != "reversed")


def match(labels: DataFrame, label: str, words: DataFrame, scope: list[str] | None = None, decisions: DataFrame | None = None, proposals: DataFrame | None = None) -> DataFrame:
    """Distinct labels with ``concept_id, status`` per concept in scope.

    Rejected pairs (by exact key) are out first. An exact key is mapped, or
    ambiguous if several concepts of any kind have it; an equal stem key is
    inflected; a proposal is auto-mapped. The strongest state of a concept wins.
    Both joins are equi-joins on keys of distinct labels."""
    d = labels.select(F.col(label).alias("label")).where(F.col(label).isNotNull()).distinct()
    # keyed once, for all joins
    d = written(d.select("label", T.label_key(F.col("label")).alias("key"), T.stem_key(F.col("label")).alias("stem_key")).where(F.col("key") != ""), "match-labels")
    if decisions is not None:
        accepted = decisions.where("verdict = 'accepted'")
        words = words.unionByName(accepted.select("concept_id", F.lit(None).cast("string").alias("kind"), "key", F.col("key").alias("stem_key")))
    holders = words.groupBy("key").agg(F.count_distinct("concept_id").alias("holders"))
    exact = words.select("key", "concept_id").distinct().join(holders, "key")
    hits = d.join(exact, "key").select("label", "key", "concept_id", F.when(F.col("holders") > 1, "ambiguous").otherwise("mapped").alias("status"))
    by_stem = words.select("stem_key", "concept_id").distinct()
    hits = hits.unionByName(d.join(by_stem, "stem_key").select("label", "key", "concept_id", F.lit("inflected").alias("status")))
    if proposals is not None:
        hits = hits.unionByName(d.join(proposals.select("key", "concept_id").distinct(), "key").select("label", "key", "concept_id", F.lit("auto-mapped").alias("status")))
    if decisions is not None:
        hits = hits.join(decisions.where("verdict = 'rejected'").select("key", "concept_id"), ["key", "concept_id"], "left_anti")
    if scope is not None:
        hits = hits.where(F.col("concept_id").isin(scope))
    return best(hits, ["label", "concept_id"])


def best(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The strongest state per key."""
    rank = F.coalesce(*[F.when(F.col("status") == s, r) for s, r in RANKS.items()])
    return hits.groupBy(*keys).agg(F.min_by("status", F.struct(rank, "status")).alias("status"))


def propose(labels: DataFrame, label: str, words: DataFrame) -> DataFrame:
    """``label, concept_id`` for labels that contain a term without being it.

    Labels are exploded to their runs of stems and joined to the terms' stem
    keys, instead of testing every label against every term."""
    d = labels.select(F.col(label).alias("label")).where(F.col(label).isNotNull()).distinct()
    d = d.withColumn("_w", T.stems(T.tokens(T.normalise(F.col("label"))))).where(F.size("_w") > 1)
    n = F.size("_w")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(6))), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice("_w", i, k), " "))))
    d = d.withColumn("_all", F.array_join("_w", " ")).withColumn("stem_key", F.explode(F.array_distinct(runs)))
    hits = d.join(words.select("stem_key", "concept_id").distinct(), "stem_key")
    equal = words.select(F.col("stem_key").alias("_all"), "concept_id").distinct()
    return hits.join(equal, ["_all", "concept_id"], "left_anti").select("label", "concept_id").distinct()


@dataclass(frozen=True)
class Scope:
    """What a query term means: its concepts, the group that named them, and the
    stem keys of all their terms and of the term itself. Bounded by the dictionary."""

    concepts: tuple[str, ...]
    group: str | None
    phrases: tuple[str, ...]


def resolve(words: DataFrame, groups: DataFrame, kind: str, term: str, proposals: DataFrame | None = None) -> Scope:
    """The scope of a query term.

    Concepts are the members of groups of the kind whose name (letter case and
    underscores aside) or term it is, the concepts of the kind with such a term,
    exactly or inflected, with hyphens as they are or as spaces, and those of
    equal proposals of whatever kind. ``groups`` holds ``kind, name, member`` and
    may hold ``group_term``. A term nobody knows has no concepts."""
    spark = words.sparkSession
    typed = spark.createDataFrame([(term,), (term.replace("-", " "),)], "t string")
    keys = typed.select(T.label_key(F.col("t")).alias("key"), T.stem_key(F.col("t")).alias("stem_key")).distinct().collect()
    exact, stems = sorted({r["key"] for r in keys if r["key"]}), sorted({r["stem_key"] for r in keys if r["stem_key"]})
    named = F.replace(F.lower("name"), F.lit("_"), F.lit("-")) == term.lower().replace("_", "-")
    if "group_term" in groups.columns:
        named = named | F.coalesce(T.stem_key(F.col("group_term")).isin(stems), F.lit(False))
    of_group = groups.where((F.col("kind") == kind) & named).select("name", "member").distinct().collect()
    same = words.where((F.col("kind") == kind) & (F.col("key").isin(exact) | F.col("stem_key").isin(stems))).select("concept_id")
    if proposals is not None:
        keyed = proposals.select("concept_id", "key", T.stem_key(F.col("key")).alias("stem_key"))
        same = same.union(keyed.where(F.col("key").isin(exact) | F.col("stem_key").isin(stems)).select("concept_id"))
    concepts = tuple(sorted({r["member"] for r in of_group} | {r[0] for r in same.distinct().collect()}))
    terms = words.where(F.col("concept_id").isin(list(concepts))).select("stem_key").distinct().collect() if concepts else []
    return Scope(concepts, max((r["name"] for r in of_group), default=None), tuple(sorted({*stems, *(r[0] for r in terms if r[0])})))


def members_of(groups: DataFrame, name: str = "name", member: str = "member") -> DataFrame:
    """``name, members, n``: groups with their distinct members in order."""
    g = groups.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.sort_array(F.collect_set(member)).alias("members"))
    return g.withColumn("n", F.size("members").cast("long"))


def with_verdicts(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals with the verdict in force on each, null while pending; rejected
    and accepted ones stay listed."""
    verdicts = decisions.select("key", "concept_id", "verdict")
    return proposals.join(verdicts, ["key", "concept_id"], "left")


def snapshot(seed: DataFrame, decisions: DataFrame) -> DataFrame:
    """The dictionary in force: the seed's terms and the accepted ones."""
    words = dictionary(seed)
    accepted = decisions.where("verdict = 'accepted'").select("concept_id", "key")
    kinds = seed.select("concept_id", "kind").distinct()
    more = accepted.join(kinds, "concept_id").select("concept_id", "kind", "key", T.stem_key(F.col("key")).alias("stem_key"))
    return words.unionByName(more).distinct()
