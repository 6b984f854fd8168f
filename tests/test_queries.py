"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from sceneweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, db, name):
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    cursor = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    assert got == want


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_every_query_has_a_name_of_its_own():
    assert set(registry.oracle_sql()) == set(registry.queries())
    assert set(registry.queries()) <= set(__spark_entry__.queries())
