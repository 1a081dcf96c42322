"""The snapshot store: generations on Parquet, published by a pointer.

Layout: ``root/<table>/generation_id=<id>/`` for derived tables, append-only
logs for states, decisions, checks and the seed, and ``_ACTIVE.json`` written
last and renamed into place. ``root`` is any folder Spark can write; every
change takes the lock, so one operation runs at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import text as T
from ..operators import inventory as I
from ..operators import terms
from ..operators.facts import latest
from ..session import exists, read_text, remove, write_text

#: Raise when a table's layout changes; older stores are then refused.
SCHEMA_VERSION = 2
STATES = "generation_id string, seq long, state string, reason string, kind string, forced boolean"
DECISIONS = "key string, concept_id string, verdict string, label string, seq long"
CHECKS = "check_id string, content_hash string, location string, verdict string, note string, result_id string, summary string, seq long"
SEEDS = "digest string, seq long"
PROPOSALS = "key string, concept_id string, label string"
#: Which states a generation may go to from each.
MOVES = {"running": {"staged", "invalid", "interrupted"}, "staged": {"active", "invalid"}, "active": {"superseded"}, "superseded": set(), "invalid": set(), "interrupted": set()}
DERIVED = ("sources", "contents", "reads", "units", "spans", "warnings", "labs", "events", "proposals")
# What a check can say, and the longest note that is kept.
VERDICTS = ("correct", "wrong", "missed", "wrong_date", "wrong_unit", "other")
LONGEST_NOTE = 2000
UNIT = ["content_hash", "file_format", "unit_number"]


def changing(method: Callable) -> Callable:
    """A method that changes the store: it holds the lock while it runs, or belongs
    to the operation that does."""
    @wraps(method)
    def run(self, *args, **kwargs):
        if self._held:
            return method(self, *args, **kwargs)
        with self.lock():
            return method(self, *args, **kwargs)

    return run


class Store:
    """Snapshots of one collection below ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self._held = spark, root.rstrip("/"), False
        path = f"{self.root}/_SCHEMA.json"
        known = read_text(spark, path)
        if known is None:
            write_text(spark, path, json.dumps({"version": SCHEMA_VERSION}))
        elif json.loads(known)["version"] != SCHEMA_VERSION:
            raise EngineError("STORE_SCHEMA_INCOMPATIBLE")

    @contextmanager
    def lock(self) -> Iterator[None]:
        """One operation at a time; a second is refused, not queued. Methods called
        while it is held belong to the same operation."""
        path = f"{self.root}/_LOCK"
        if not write_text(self.spark, path, "", new=True):
            raise EngineError("OPERATION_BUSY")
        self._held = True
        try:
            yield
        finally:
            self._held = False
            remove(self.spark, path)

    def _append(self, table: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{table}")

    def _read(self, table: str, schema: str) -> DataFrame:
        path = f"{self.root}/{table}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _write(self, table: str, generation: str, df: DataFrame, mode: str = "overwrite") -> None:
        df.drop("generation_id").write.mode(mode).parquet(f"{self.root}/{table}/generation_id={generation}")

    # generations

    def state_of(self, generation: str) -> str | None:
        """Current state, or ``None`` for an unknown generation."""
        row = self.generations().where(F.col("generation_id") == generation).first()
        return row["state"] if row else None

    def generations(self) -> DataFrame:
        """Current state of all generations."""
        return latest(self._read("state_log", STATES), ["generation_id"], ["seq"])

    def _log(self, generation: str, state: str, reason: str | None = None, kind: str | None = None, forced: bool = False) -> None:
        self._append("state_log", [(generation, time.time_ns(), state, reason, kind, forced)], STATES)

    def _kind(self, generation: str) -> str | None:
        row = self._read("state_log", STATES).where((F.col("generation_id") == generation) & (F.col("state") == "running")).first()
        return row["kind"] if row else None

    def _require(self, generation: str, state: str, code: str) -> None:
        if self.state_of(generation) != state:
            raise EngineError(code)

    @changing
    def begin(self, generation: str, kind: str = "scan") -> None:
        """Opens a generation."""
        if self.state_of(generation):
            raise EngineError("GENERATION_EXISTS")
        self._log(generation, "running", None, kind)

    @changing
    def move(self, generation: str, state: str, reason: str | None = None, forced: bool = False) -> None:
        """Moves a generation on; moves that are not allowed are refused."""
        now = self.state_of(generation)
        if now is None or state not in MOVES[now]:
            raise EngineError("GENERATION_STATE_BLOCKED")
        self._log(generation, state, reason, self._kind(generation), forced)

    @changing
    def save(self, table: str, generation: str, df: DataFrame) -> None:
        """Writes a table of a running generation; a repeat replaces it whole."""
        self._require(generation, "running", "GENERATION_NOT_RUNNING")
        self._write(table, generation, df)

    @changing
    def save_inventory(self, generation: str, inventory: DataFrame, finish: bool = False) -> None:
        """Writes the sources of a running generation and its distinct contents.
        ``finish`` stages it as an inventory alone; else its readers are to run."""
        self._require(generation, "running", "GENERATION_NOT_RUNNING")
        self._write("sources", generation, inventory)
        known = self.load("sources", generation).where(F.col("content_hash").isNotNull())
        self._write("contents", generation, known.select("content_hash").distinct())
        if finish:
            self.move(generation, "staged", "INVENTORY_ONLY")
        else:
            self._log(generation, "running", "READER_PROCESSING", self._kind(generation))

    def load_inventory(self, generation: str | None = None) -> DataFrame:
        """The sources of a generation in the order of their paths."""
        return self.load("sources", generation).orderBy("relative_path")

    def unit_spans(self, content_hash: str, file_format: str, unit_number: int, indices: list[int] | None = None, generation: str | None = None) -> DataFrame:
        """The spans of one page in order, or those with the given indices."""
        rows = self.load("spans", generation).where((F.col("content_hash") == content_hash) & (F.col("file_format") == file_format) & (F.col("unit_number") == unit_number))
        return (rows if indices is None else rows.where(F.col("span_index").isin(indices))).orderBy("span_index")

    def load(self, table: str, generation: str | None = None) -> DataFrame:
        """A table of a generation, the active one by default; only its folder is read."""
        generation = generation or self.active()
        if generation is None:
            raise EngineError("NO_ACTIVE_GENERATION")
        return self.spark.read.parquet(f"{self.root}/{table}/generation_id={generation}").withColumn("generation_id", F.lit(generation))

    def source_entries(self, generation: str | None = None) -> DataFrame:
        """Files of a generation with what they hold."""
        return self.load("sources", generation).where("kind = 'file'").select("relative_path", "content_hash", "file_format", "status")

    # reading

    @changing
    def record_reads(self, generation: str, reads: DataFrame) -> int:
        """Appends outcomes of contents (``content_hash, file_format, status,
        warnings, page_count, unit_count``); those the generation has no source of
        are refused: their number is returned."""
        self._require(generation, "running", "GENERATION_NOT_RUNNING")
        listed = self.load("sources", generation).select("content_hash", "file_format").distinct()
        known = reads.join(listed, ["content_hash", "file_format"], "left_semi")
        refused = reads.join(listed, ["content_hash", "file_format"], "left_anti").count()
        self._write("reads", generation, known, "append")
        return refused

    @changing
    def record_units(self, generation: str, units: DataFrame) -> None:
        """Fans pages out into their tables: ``units`` holds the page's key, its
        ``status`` and ``warnings``, and arrays ``spans``, ``labs``, ``events`` and
        ``noted`` of structs. It is written once, then each table reads it back."""
        self._require(generation, "running", "GENERATION_NOT_RUNNING")
        path = f"{self.root}/_staging/{uuid.uuid4().hex}"
        units.write.parquet(path)
        kept = self.spark.read.schema(units.schema).parquet(path)
        nested = {"spans": "spans", "labs": "labs", "events": "events", "warnings": "noted"}
        self._write("units", generation, kept.drop(*[c for c in nested.values() if c in kept.columns]), "append")
        for table, column in nested.items():
            if column in kept.columns:
                rows = kept.select(*UNIT, F.posexplode(column).alias("_i", "_r")).select(*UNIT, *([F.col("_i").alias("span_index")] if table == "spans" else []), "_r.*")
                self._write(table, generation, rows, "append")
        remove(self.spark, path)

    @changing
    def finish_scan(self, generation: str) -> bool:
        """Stages a running scan if every ready content of it has been read, else
        makes it invalid; whether it was staged."""
        self._require(generation, "running", "GENERATION_NOT_RUNNING")
        wanted = I.work_list(self.load("sources", generation)).select("content_hash", "file_format").distinct()
        path = f"{self.root}/reads/generation_id={generation}"
        read = self.load("reads", generation).select("content_hash", "file_format").distinct() if exists(self.spark, path) else wanted.limit(0)
        whole = not wanted.join(read, ["content_hash", "file_format"], "left_anti").limit(1).count()
        self.move(generation, "staged" if whole else "invalid", None if whole else "READS_INCOMPLETE")
        return whole

    @changing
    def revalidate(self, generation: str, now: DataFrame) -> str | None:
        """Compares a generation with the sources as they are ``now``. One that no
        longer holds becomes invalid if it is running or staged; the reason."""
        reason = I.consistency(I.difference(self.load("sources", generation), now)).first()["reason"]
        if reason and self.state_of(generation) in ("running", "staged"):
            self.move(generation, "invalid", reason)
        return reason

    # publishing

    def active(self) -> str | None:
        """The published generation."""
        text = read_text(self.spark, f"{self.root}/_ACTIVE.json")
        return json.loads(text)["generation_id"] if text else None

    @changing
    def activate(self, generation: str, findings: DataFrame | None = None, force: bool = False, now: DataFrame | None = None) -> bool:
        """Publishes a staged generation unless the guard has findings; whether it
        was published. ``force`` overrides only the guard, never sources (``now``)
        that have changed.

        The states are logged before the pointer moves: after a crash between the
        two, ``recover`` moves the pointer."""
        self._require(generation, "staged", "GENERATION_STATE_BLOCKED")
        if now is not None and self.revalidate(generation, now):
            raise EngineError("SOURCE_CHANGED")
        blocked = findings is not None and bool(findings.limit(1).count())
        if blocked and not force:
            return False
        self.move(generation, "active", None, forced=blocked)
        self._point_to(generation)
        return True

    def _point_to(self, generation: str) -> None:
        write_text(self.spark, f"{self.root}/_ACTIVE.json", json.dumps({"generation_id": generation}))
        for r in self.generations().where((F.col("state") == "active") & (F.col("generation_id") != generation)).select("generation_id").collect():
            self.move(r[0], "superseded")

    @changing
    def recover(self) -> list[str]:
        """Marks generations left running as interrupted, and finishes a publication
        that was cut off; the interrupted ones' names. Called when no other
        operation can be running; a lock a crash left is removed by ``unlock``."""
        left = sorted(r[0] for r in self.generations().where("state = 'running'").select("generation_id").collect())
        for g in left:
            self.move(g, "interrupted", "RECOVERED")
        last = self.generations().where("state = 'active'").orderBy(F.col("seq").desc()).first()
        if last and (last["generation_id"] != self.active() or self.generations().where("state = 'active'").count() > 1):
            self._point_to(last["generation_id"])
        return left

    def unlock(self) -> None:
        """Removes the lock of an operation that is known to have died."""
        remove(self.spark, f"{self.root}/_LOCK")

    @changing
    def prune(self) -> list[str]:
        """Deletes the tables of superseded generations; their names."""
        old = sorted(r[0] for r in self.generations().where("state = 'superseded'").select("generation_id").collect())
        for g in old:
            for t in DERIVED:
                remove(self.spark, f"{self.root}/{t}/generation_id={g}")
        return old

    # dictionary

    @changing
    def sync_seed(self, seed: DataFrame, digest: str) -> bool:
        """Takes a dictionary seed in, unless its digest is the one in force;
        whether it was taken. The dictionary's revision moves with it."""
        last = self._read("seed_log", SEEDS).orderBy(F.col("seq").desc()).first()
        if last and last["digest"] == digest:
            return False
        seed.write.mode("overwrite").parquet(f"{self.root}/seed/digest={digest}")
        self._append("seed_log", [(digest, time.time_ns())], SEEDS)
        return True

    def seed(self) -> DataFrame:
        """The terms of the seed in force."""
        last = self._read("seed_log", SEEDS).orderBy(F.col("seq").desc()).first()
        if last is None:
            raise EngineError("NO_SEED")
        return self.spark.read.parquet(f"{self.root}/seed/digest={last['digest']}")

    def concept_exists(self, concept_id: str) -> bool:
        """Whether the seed knows a concept."""
        return bool(self.seed().where(F.col("concept_id") == concept_id).limit(1).count())

    @changing
    def decide(self, key: str, concept_id: str, verdict: str, label: str) -> int:
        """Records accepted or rejected; the new revision. The first label text stays."""
        if verdict not in ("accepted", "rejected"):
            raise EngineError("VERDICT_UNKNOWN")
        log = self._read("decisions", DECISIONS)
        first = log.where((F.col("key") == key) & (F.col("concept_id") == concept_id)).orderBy("seq").first()
        self._append("decisions", [(key, concept_id, verdict, first["label"] if first else label, time.time_ns())], DECISIONS)
        return self.revision()

    @changing
    def reverse(self, key: str, concept_id: str) -> bool:
        """Takes a decision back; false if there is none."""
        if not self.decisions().where((F.col("key") == key) & (F.col("concept_id") == concept_id)).limit(1).count():
            return False
        self._append("decisions", [(key, concept_id, "reversed", None, time.time_ns())], DECISIONS)
        return True

    def decisions(self) -> DataFrame:
        """Decisions in force."""
        return latest(self._read("decisions", DECISIONS), ["key", "concept_id"], ["seq"]).where("verdict <> 'reversed'")

    def revision(self) -> int:
        """Changes to the dictionary so far, plus one; the first seed is none."""
        return self._read("decisions", DECISIONS).count() + max(1, self._read("seed_log", SEEDS).count())

    @changing
    def store_proposals(self, generation: str, proposals: DataFrame) -> None:
        """Replaces a generation's proposals (``label, concept_id``), each key and
        concept once with its least label."""
        keyed = proposals.select(T.label_key(F.col("label")).alias("key"), "concept_id", "label").where(F.col("key") != "")
        self._write("proposals", generation, keyed.groupBy("key", "concept_id").agg(F.min("label").alias("label")))

    def proposals(self, generation: str | None = None) -> DataFrame:
        """A generation's proposals with the verdict on each, null while pending."""
        generation = generation or self.active()
        known = self._read(f"proposals/generation_id={generation}", PROPOSALS)
        return terms.with_verdicts(known, self.decisions())

    def snapshot(self) -> DataFrame:
        """The dictionary in force: the seed and what was accepted."""
        return terms.snapshot(self.seed(), self.decisions())

    # checks and memory

    @changing
    def record_check(self, content_hash: str, location: str, verdict: str, note: str = "", result_id: str | None = None, summary: str = "") -> str:
        """Appends what someone found on checking a result, or one that is missed;
        the check's id. Only a missed result has no id; long notes are cut."""
        if verdict not in VERDICTS or (result_id is None and verdict != "missed"):
            raise EngineError("CHECK_INVALID")
        check_id = uuid.uuid4().hex
        self._append("checks", [(check_id, content_hash, location, verdict, note[:LONGEST_NOTE], result_id, summary, time.time_ns())], CHECKS)
        return check_id

    def checks(self) -> DataFrame:
        """All checks, latest first."""
        return self._read("checks", CHECKS).orderBy(F.col("seq").desc())

    def check_counts(self) -> DataFrame:
        """Checks by verdict."""
        return self._read("checks", CHECKS).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))

    @changing
    def memoise(self, table: str, keys: list[str], wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], schema: str | None = None) -> DataFrame:
        """``wanted`` with computed columns; what is known is not computed again.

        Keys that are missing are computed, appended and then read back, so an
        interrupted run loses only what it had not written. What ``compute`` gives
        no row for is not remembered and stays null."""
        path = f"{self.root}/{table}"
        missing = wanted.select(*keys).distinct()
        if exists(self.spark, path):
            missing = missing.join(self.spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
        compute(missing).write.mode("append").parquet(path)
        known = self.spark.read.schema(schema).parquet(path) if schema else self.spark.read.parquet(path)
        return wanted.join(known.dropDuplicates(keys), keys, "left")

    @changing
    def erase(self, phrase: str | None = None) -> None:
        """Deletes derived data; with the phrase ``erase all`` decisions, checks and
        the seed too."""
        if phrase not in (None, "erase all"):
            raise EngineError("ERASE_PHRASE_MISMATCH")
        for t in (*DERIVED, "state_log", "_ACTIVE.json", *(("decisions", "checks", "seed", "seed_log") if phrase else ())):
            remove(self.spark, f"{self.root}/{t}")
