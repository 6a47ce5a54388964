import os

import duckdb
import pytest

import __spark_entry__ as contract
from millrace.plans import catalog, oracles
from tools.check import TABLES, digest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the standard tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(oracles.oracle_sql())
    assert set(catalog.queries()) <= set(contract.queries()) and set(oracles.oracle_sql()) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_its_oracle(spark, db, name):
    frame = contract.queries()[name](spark, SF)
    result = db.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    rows = frame.collect()
    assert rows
    assert digest(frame.columns, [tuple(r) for r in rows]) == digest(columns, result.fetchall())


def test_entry(spark):
    shards = contract.entry(spark)
    assert shards.columns == ["shard_id", "first_doc", "num_docs", "num_tokens"] and shards.count() > 0
