"""Sessions, table access and the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import suppress
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError

#: Settings every engine session wants; a cluster's own values win where set.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; production sessions come from outside."""
    builder = SparkSession.builder.master(f"local[{cpus}]")
    base = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": str(cpus)}
    for key, value in (DEFAULTS | base | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """A temporary folder of this process, for local sessions only."""
    folder = tempfile.mkdtemp(prefix="spanline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file:" + folder


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. A local session may
    leave it unset and gets a temporary folder; a cluster may not."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise EngineError("NO_SHARED_FOLDER")
    return _own_folder()


def run_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared folder, for one run of one operator; it goes
    when the application's driver ends."""
    base = f"{shared_folder(spark)}/spanline/{spark.sparkContext.applicationId}"
    _cleaned_at_exit(spark.sparkContext, base)
    return f"{base}/{label}-{uuid.uuid4().hex}"


def kept_folder(spark: SparkSession, label: str) -> str:
    """A folder in the shared folder that outlives the application."""
    return f"{shared_folder(spark)}/spanline/kept/{label}"


def _hadoop(context, path: str):
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(context._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, on whatever file system."""
    at, files = _hadoop(spark.sparkContext, path)
    return files.exists(at)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or ``None`` if there is none."""
    at, files = _hadoop(spark.sparkContext, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, new: bool = False) -> bool:
    """Writes a small file at once: under another name first, then renamed over
    the old one. With ``new`` it is created instead, and ``False`` tells that it
    was there already."""
    context = spark.sparkContext
    at, files = _hadoop(context, path)
    files.mkdirs(at.getParent())
    if new:
        try:
            stream = files.create(at, False)
        except Exception as e:  # noqa: BLE001 - each file system has its own class for this
            if files.exists(at):
                return False
            raise e
        stream.write(text.encode())
        stream.close()
        return True
    part, _ = _hadoop(context, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = files.create(part, True)
    stream.write(text.encode())
    stream.close()
    jvm = context._jvm
    options = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else files.getUri(), context._jsc.hadoopConfiguration()).rename(part, at, options)
    return True


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    at, files = _hadoop(spark.sparkContext, path)
    files.delete(at, True)


@lru_cache(maxsize=100)
def _cleaned_at_exit(context, base: str) -> None:
    at, files = _hadoop(context, base)

    def delete() -> None:
        with suppress(Exception):  # the JVM may be gone
            files.delete(at, True)

    atexit.register(delete)


def clean(spark: SparkSession) -> None:
    """Deletes what this application wrote to the shared folder, once its results
    are stored; results that still read it cannot be computed again afterwards."""
    at, files = _hadoop(spark.sparkContext, f"{shared_folder(spark)}/spanline/{spark.sparkContext.applicationId}")
    files.delete(at, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage,
    keeps every copy on storage that outlives a lost executor."""
    spark = df.sparkSession
    path = run_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes up to which a counted and sized side is sent to every executor.
MOST_BROADCAST_BYTES = 32 * 2**20


def small_side(df: DataFrame, most_rows: int = 500_000, row_bytes: int = 64) -> DataFrame:
    """``df`` marked for broadcast if it is counted to be small, else as it is.
    ``row_bytes`` bounds a row; texts are not sent this way."""
    most = min(most_rows, MOST_BROADCAST_BYTES // row_bytes)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Hash-partition by ``keys`` with as many partitions as the session shuffles to."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[F.col(k) if isinstance(k, str) else k for k in keys])


def deal(distinct: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows dealt over as many tasks as the session shuffles to. By a hash
    of the keys, not by the keys themselves: a plan already partitioned by them
    would be left as it is, and small ones folded into one task."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return distinct.repartition(n, F.xxhash64(*keys))
