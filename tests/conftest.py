from __future__ import annotations

import os
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = REPO + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


def oracle(sql: str, sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return c.sql(sql).df()


def same(got, want) -> str:
    """Nothing if two frames hold the same rows whatever their order; else what differs."""
    import pandas as pd

    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    cols = sorted(got.columns)
    rows = [sorted((tuple(None if pd.isna(v) else round(float(v), 9) if isinstance(v, float) else v.item() if hasattr(v, "item") else v for v in r) for r in f[cols].itertuples(index=False)), key=repr) for f in (got, want)]
    bad = [(a, b) for a, b in zip(*rows, strict=True) if a != b and not all(x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and x is not None and abs(x - y) <= 1e-9 * max(1, abs(x)) for x, y in zip(a, b, strict=True))]
    return f"{len(bad)} rows differ, as {bad[0]}" if bad else ""
