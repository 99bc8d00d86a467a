"""Every catalogue query against its DuckDB form on the smallest data."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from cartolyte.plans import binaries, catalogue, ordered, trees

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

QUERIES = catalogue.QUERIES | binaries.QUERIES | ordered.QUERIES | trees.QUERIES
ORACLE_SQL = catalogue.ORACLE_SQL | binaries.ORACLE_SQL | ordered.ORACLE_SQL | trees.ORACLE_SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    clean = lambda v: "NULL" if v is None or v is pd.NaT or v is pd.NA or v != v else str(v)
    return sorted(tuple(map(clean, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_grid_plan_has_no_nested_loop(spark):
    plan = catalogue.QUERIES["q14_poi_city_grid"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
