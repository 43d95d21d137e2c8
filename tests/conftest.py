import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parents[1]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from mietwerk.session import build_session

    place = tmp_path_factory.mktemp("checkpoints")
    session = build_session("tests", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.checkpoint.dir": f"file://{place}", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def _show(v):
    if v is None or v is pd.NA or v != v:
        return "~"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def same():
    """Asserts that two pandas frames have equal columns and rows, in any order."""

    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        rows = [sorted(tuple(map(_show, r)) for r in f[sorted(f.columns)].itertuples(index=False, name=None)) for f in (a, b)]
        assert len(rows[0]) == len(rows[1])
        assert [p for p in zip(*rows, strict=True) if p[0] != p[1]][:3] == []

    return check
