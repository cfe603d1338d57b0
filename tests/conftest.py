"""One local session for all tests, with a fresh checkpoint folder."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoints')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA


def _rows(columns, values):
    import pandas as pd

    def plain(x):
        if isinstance(x, (list, tuple)):
            return tuple(map(plain, x))
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        x = x.item() if hasattr(x, "item") else x
        return int(x) if isinstance(x, float) and x.is_integer() else round(x, 9) if isinstance(x, float) else x

    return sorted(repr([plain(r[c]) for c in columns]) for r in values)


@pytest.fixture(scope="session")
def check_sql(spark, sf_dir):
    """Compares a registered query with its SQL, as sets of rows."""
    import glob

    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")

    def check(query, sql):
        df = query(spark, sf_dir)
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(names)
        columns = sorted(names)
        theirs = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
        assert _rows(columns, [r.asDict() for r in df.collect()]) == _rows(columns, theirs)

    return check
