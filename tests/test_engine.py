"""Every query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(map(_plain, r))) for r in df.select(cols).collect())
    names = ", ".join(f'"{c}"' for c in cols)
    want = sorted(repr(tuple(map(_plain, r))) for r in duck.sql(f"SELECT {names} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall())
    assert got == want


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_the_rest_does_not_import_the_text_package():
    root = os.path.join(os.path.dirname(__spark_entry__.__file__), "silverbarn")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "silverbarn.llm" not in open(os.path.join(folder, f)).read(), f
