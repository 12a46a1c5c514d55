"""Every query against its SQL in DuckDB, as the driver compares them, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from skyquilt import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


def text(v):
    return repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql_agrees(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    result = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(text, row)) for row in result.fetchall())
    assert sorted(tuple(text(r[c]) for c in columns) for r in df.collect()) == want


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() == 25
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_training_data_operators():
    root = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "skyquilt")
    for folder, _, files in os.walk(root):
        if os.sep + "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert "skyquilt.llm" not in open(os.path.join(folder, f)).read(), f
