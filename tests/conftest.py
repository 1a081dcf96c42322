"""One small session for all tests, and folders of hostile and empty tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from spanline.session import local_session

    base = tmp_path_factory.mktemp("spark")
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    return local_session(4, **{"spark.checkpoint.dir": f"file:{base}/shared", "spark.sql.warehouse.dir": f"{base}/warehouse"})


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no test data here")
    return str(DATA)


@pytest.fixture(scope="session")
def empty_data(spark, data, tmp_path_factory):
    """All tables without rows."""
    base = tmp_path_factory.mktemp("empty")
    for f in Path(data).glob("*.parquet"):
        spark.read.parquet(str(f)).limit(0).write.parquet(f"{base}/{f.name}")
    return str(base)


@pytest.fixture(scope="session")
def hostile_data(spark, data, tmp_path_factory):
    """All tables with an all-null row, repeated rows, empty and very long texts,
    and extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    base = tmp_path_factory.mktemp("hostile")
    extra = ("chunk", "label", "moment", "row_id", "tokens", "form", "level", "print", "_v", "_t")
    for f in Path(data).glob("*.parquet"):
        df = spark.read.parquet(str(f))
        rows = df.limit(60)
        nulls = spark.createDataFrame([tuple(None for _ in df.columns)], df.schema)
        texts = [c for c, t in df.dtypes if t == "string"]
        one = df.limit(1)
        blank = one.withColumns({c: F.lit("") for c in texts if c not in ("source", "kind")})
        long = one.withColumns({c: F.repeat(F.lit("Ab-1 ä,."), 6000) for c in texts if c in ("text", "raw", "raw_label", "raw_value", "wording", "raw_specialty", "reference_interval", "unit")})
        out = df if f.stem in ("concepts", "concept_terms", "mix_targets", "eval_items") else rows
        out = out.union(rows.limit(5)).union(nulls).union(blank).union(long)
        for name in extra:
            if name not in out.columns:
                out = out.withColumn(name, F.lit("clash"))
        out.write.parquet(f"{base}/{f.name}")
    return str(base)
