"""Every registered query against its SQL, and the whole job end to end."""

import glob
import os

import duckdb
import pytest
from conftest import TESTDATA

import __spark_entry__ as registry
from spinneret.operators.changes import insert_ignore
from spinneret.workload import inputs

SF = f"{TESTDATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    database = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        database.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return database


def test_registry():
    queries, oracle = registry.queries(), registry.oracle_sql()
    assert set(oracle) <= set(queries)
    from spinneret.workload.queries import QUERIES

    assert set(QUERIES) <= set(oracle)


def test_entry(spark):
    assert registry.entry(spark).count() > 0


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    result = registry.queries()[name](spark, SF)
    expected = sql.sql(registry.oracle_sql()[name])
    assert sorted(expected.columns) == sorted(result.columns)
    types = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: TYPES[t] for c, t in result.dtypes} == types
    order = [expected.columns.index(c) for c in result.columns]
    want = sorted((tuple(row[i] for i in order) for row in expected.fetchall()), key=repr)
    assert sorted((tuple(r) for r in result.collect()), key=repr) == want


def test_insert_ignore_is_idempotent(spark):
    batch = inputs.event_results(inputs.table(spark, SF, "events"))
    once = insert_ignore(batch, batch.limit(0), "id")
    assert insert_ignore(once, batch.limit(0), "id").count() == once.count()
    assert insert_ignore(batch, once, "id").isEmpty()


def test_counters_add_up(spark):
    rows = registry.queries()["crawl_rollup"](spark, SF).collect()
    assert all(r["total_pages"] == r["success_pages"] + r["failed_pages"] for r in rows)
