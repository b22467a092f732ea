"""Every registered query with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from check import TABLES, compare

SF = "/root/testdata/sf0.001"
# Whole runs take minutes; test_whole_runs has what can be said of them without running.
LONG = {"baseline_vs_tuned", *(n for n in queries() if n.startswith("automl_"))}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_registry():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(n for n in oracle_sql() if n not in LONG))
def test_query(spark, base, name):
    df = queries()[name](spark, SF)
    found = base.execute(oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert compare(df.columns, df.collect(), columns, found.fetchall()) == ""


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - {n for n in queries() if n.startswith("op") or n == "pipeline"}))
def test_query_without_sql_runs(spark, name):
    assert queries()[name](spark, SF).count() > 0
