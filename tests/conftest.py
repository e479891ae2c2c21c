"""One session for all tests, and a check of a query against its SQL in DuckDB."""

from __future__ import annotations

import decimal
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def plain(value):
    """A value as both engines would print it."""
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(columns)
    return sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in rows)


@pytest.fixture
def same_as_sql(spark, duck):
    def check(query, sql):
        df = query(spark, SF)
        want = duck.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want.columns, want.fetchall())

    return check
