"""File sources: folders of documents, word tables of recognisers, claims, seeds."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inventory import source_format
from ..session import spread, written

# What a file's state is made of, and what alone never matters.
STAT_FIELDS = ("device", "inode", "mode", "size", "modified", "changed")
HARMLESS_FIELDS = ("modified", "changed")
#: Folders below the root that are followed.
DEEPEST = 64


LISTED = f"relative_path string, kind string, status string, reason string, state struct<{', '.join(f'{f}:long' for f in STAT_FIELDS)}>"


def _state(path: str) -> tuple[int, ...]:
    s = os.stat(path, follow_symlinks=False)
    return s.st_dev, s.st_ino, s.st_mode, s.st_size, s.st_mtime_ns, s.st_ctime_ns


def _entries(root: str, folder: str) -> Iterator[tuple]:
    """Rows of one folder, by name; links are rows and never followed."""
    try:
        found = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
    except OSError:
        yield folder, "directory", "failed", "UNREADABLE", None
        return
    for e in found:
        path = os.path.relpath(e.path, root)
        try:
            state = _state(e.path)
        except OSError:
            yield path, "unknown", "failed", "UNREADABLE", None
            continue
        mode = state[2]
        if stat.S_ISLNK(mode):
            yield path, "symlink", "skipped", "SYMLINK", state
        elif stat.S_ISDIR(mode):
            yield path, "directory", "ready", None, state
        elif stat.S_ISREG(mode):
            yield path, "file", "ready", None, state
        else:
            yield path, "special", "skipped", "SPECIAL", state


def list_folder(spark: SparkSession, root: str) -> DataFrame:
    """Rows ``relative_path, kind, file_format, status, reason, state`` of a folder tree.

    The folders of each level are listed on the executors and written to the
    shared folder; the driver only counts how many are left for the next level,
    at most ``DEEPEST`` times. Folders below that are failed rows."""
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for folder in f["relative_path"] for r in _entries(root, folder)]
            yield pd.DataFrame(rows, columns=["relative_path", "kind", "status", "reason", "state"])

    level = spark.createDataFrame([(".",)], "relative_path string")
    parts = []
    for _ in range(DEEPEST + 1):
        found = written(level.mapInPandas(scan, LISTED), "listing")
        parts.append(found.where((F.col("kind") != "directory") | (F.col("status") == "failed")))
        level = found.where("kind = 'directory' and status = 'ready'").select("relative_path")
        n = level.count()
        if not n:
            break
        level = level.repartition(min(n, 1000), "relative_path")
    else:
        parts.append(level.select("relative_path", F.lit("directory").alias("kind"), F.lit("failed").alias("status"), F.lit("DEPTH_LIMIT").alias("reason"), F.lit(None).cast(found.schema["state"].dataType).alias("state")))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    fmt = F.when(F.col("kind") == "file", source_format(F.col("relative_path")))
    return df.withColumn("file_format", fmt).withColumn("status", F.when((F.col("kind") == "file") & F.col("file_format").isNull(), "unsupported").otherwise(F.col("status")))


def fingerprints(listed: DataFrame, root: str) -> DataFrame:
    """``relative_path, content_hash, after`` of all regular files of a listing,
    hashed in pieces where they are read, with their state once read; a file that
    cannot be read has neither."""
    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path in f["relative_path"]:
                full = os.path.join(root, path)
                try:
                    with open(full, "rb") as data:
                        code = hashlib.file_digest(data, "sha256").hexdigest()
                    rows.append((path, code, _state(full)))
                except OSError:
                    rows.append((path, None, None))
            yield pd.DataFrame(rows, columns=["relative_path", "content_hash", "after"])

    files = spread(listed.where("kind = 'file'").select("relative_path"), "relative_path")
    return files.mapInPandas(digest, f"relative_path string, content_hash string, after struct<{', '.join(f'{f}:long' for f in STAT_FIELDS)}>")


def inventory(spark: SparkSession, root: str, generation: str) -> DataFrame:
    """The inventory table of a folder, one all executors see, as one generation.

    A file that became another while it was read has failed; one of which only
    the times moved is kept with a warning."""
    listed = written(list_folder(spark, root), "listed")
    rows = listed.join(fingerprints(listed, root), "relative_path", "left")
    moved = identity_state(stat_changes(F.col("state"), F.col("after")))
    lost = (F.col("kind") == "file") & (F.col("content_hash").isNull() | (moved == "SOURCE_CHANGED"))
    lost = F.coalesce(lost, F.lit(False))
    warnings = F.array_compact(F.array(F.when(~lost & (moved == "METADATA_TOUCHED"), "METADATA_TOUCHED")))
    return rows.select(F.lit(generation).alias("generation_id"), "relative_path", "kind", "file_format", F.when(lost, "failed").otherwise(F.col("status")).alias("status"), F.when(~lost, F.col("content_hash")).alias("content_hash"), F.when(F.col("kind") == "file", warnings).otherwise(F.array().cast("array<string>")).alias("warnings"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of a recogniser's tab-separated output; rows that are no words,
    unsure or malformed are skipped."""
    names = ["level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text"]
    schema = ", ".join(f"{n} string" for n in names)
    raw = spark.read.csv(path, sep="\t", header=True, quote="", schema=schema, mode="PERMISSIVE")
    ints = {n: F.col(n).try_cast("int") for n in names[1:10]}
    rows = raw.where((F.col("level").try_cast("int") == 5) & (F.col("conf").try_cast("double") >= 0) & (F.trim("text") != "")).withColumns(ints)
    return rows.dropna(subset=["left", "top", "width", "height"]).select(*names[1:10], F.col("conf").try_cast("double").alias("conf"), "text")


CLAIMS = (
    "document_class string, handwriting boolean, context_missing boolean, dates array<struct<raw:string,role:string>>, "
    "lab_rows array<struct<label:string,value:string,unit:string,reference_interval:string,flag:string,specimen:string,dates:array<struct<raw:string,role:string>>>>, "
    "events array<struct<specialty:string,event_type:string,wording:string,planned:boolean,recommendation:boolean,dates:array<struct<raw:string,role:string>>>>"
)
# Values that stand for no value, and how many rows, events and
# dates a page may claim and how long a text may be.
PLACEHOLDERS = ("", "-", "—", "–", "na", "n/a", "pending", "cancelled", "canceled", "x", "xx", "xxx", "tbd", "none")
MOST_ROWS, MOST_EVENTS, MOST_DATES, LONGEST = 400, 50, 20, 300


def parse_claims(pages: DataFrame, column: str) -> DataFrame:
    """Claims of pages from JSON under a fixed schema, with ``dropped``.

    Rows without label or with a placeholder value and events without wording are
    dropped and counted; texts are cut at ``LONGEST`` characters, as the contract
    of claims says. A page that does not parse, or claims more rows, events or
    dates than the contract allows, is ``invalid`` as a whole."""
    c = F.from_json(F.col(column), CLAIMS, {"mode": "PERMISSIVE"})
    df = pages.withColumn("_c", c).withColumn("invalid", F.col("_c").isNull() | (F.col("_c.lab_rows").isNull() & F.col("_c.events").isNull()))

    def cut(x):
        return F.substring(F.trim(x), 1, LONGEST)

    labs = F.coalesce("_c.lab_rows", F.array().cast(_type("lab_rows")))
    kept = F.filter(labs, lambda r: (F.coalesce(F.trim(r["label"]), F.lit("")) != "") & ~F.lower(F.trim(F.coalesce(r["value"], F.lit("")))).isin(*PLACEHOLDERS))
    kept = F.transform(kept, lambda r: r.withField("value", F.regexp_replace(cut(r["value"]), r"^(\d+)\.$", "$1")).withField("label", cut(r["label"])))
    events = F.coalesce("_c.events", F.array().cast(_type("events")))
    told = F.filter(events, lambda e: F.coalesce(F.trim(e["wording"]), F.lit("")) != "")
    out = df.withColumns({"lab_rows": kept, "event_rows": told, "page_dates": F.coalesce("_c.dates", F.array().cast("array<struct<raw:string,role:string>>")), "document_class": F.coalesce("_c.document_class", F.lit("other"))})
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    out = out.withColumn("invalid", F.col("invalid") | (size("_c.lab_rows") > MOST_ROWS) | (size("_c.events") > MOST_EVENTS) | (size("_c.dates") > MOST_DATES))
    return out.withColumn("dropped", F.size(labs) + F.size(events) - F.size("lab_rows") - F.size("event_rows")).drop("_c")


def _type(field: str) -> str:
    start = CLAIMS.index(field + " ") + len(field) + 1
    depth, end = 0, start
    while end < len(CLAIMS) and not (CLAIMS[end] == "," and depth == 0):
        depth += (CLAIMS[end] == "<") - (CLAIMS[end] == ">")
        end += 1
    return CLAIMS[start:end]


def read_seed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str]:
    """Dictionary seed: its terms (one row each), its groups (``kind, name, member``)
    and a digest of the file.

    The file is a JSON object of ``concepts`` (``concept_id, kind, terms: {lang:
    [label]}``) and ``groups`` (``name, kind, members``)."""
    schema = "concepts array<struct<concept_id:string,kind:string,terms:map<string,array<string>>>>, groups array<struct<name:string,kind:string,members:array<string>>>"
    seed = spark.read.json(path, schema=schema, multiLine=True)
    terms = seed.select(F.explode("concepts").alias("c")).select("c.concept_id", "c.kind", F.explode("c.terms").alias("lang", "labels")).select("concept_id", "kind", "lang", F.explode("labels").alias("term_label"))
    groups = seed.select(F.explode("groups").alias("g")).select("g.kind", "g.name", F.explode("g.members").alias("member"))
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    return terms, groups, digest


def stat_changes(before: F.Column, after: F.Column) -> F.Column:
    """Names of the fields in which two states of a file (structs) differ."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), before[f].cast("string").alias("b"), after[f].cast("string").alias("a")) for f in STAT_FIELDS])
    return F.transform(F.filter(pairs, lambda p: ~p["b"].eqNullSafe(p["a"])), lambda p: p["field"])


def identity_state(changes: F.Column) -> F.Column:
    """``SOURCE_CHANGED`` when a file became another while it was read,
    ``METADATA_TOUCHED`` when only its times moved, else null."""
    blocking = F.array_except(changes, F.array(*[F.lit(f) for f in HARMLESS_FIELDS]))
    return F.when(F.size(blocking) > 0, "SOURCE_CHANGED").when(F.size(changes) > 0, "METADATA_TOUCHED")
