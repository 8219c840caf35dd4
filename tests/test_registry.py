"""Every registered query runs; those with SQL agree with it."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from defectlens.plans import oracles, registered

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
ORACLES = oracles()
# Queries that train run for a minute each; test_learning covers their parts, lr_static_optimality and
# lofo_vocabulary stand for them here.
TRAINING = {"lr_crossval_optimality", "lr_tfidf_optimality", "lr_tfidf_served"}
QUICK = sorted(n for n in registered() if n in ORACLES and n not in TRAINING)


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    cells = [
        tuple("" if v is None or v != v else repr(v) for v in row)
        for row in frame.itertuples(index=False, name=None)
    ]
    return sorted(cells)


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, duck, sf_dir, name):
    got = registered()[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for column in got.columns:
        assert got[column].dtype == want[column].dtype, column
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry_point.entry(spark).count() == 1


def test_no_oracle_without_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(registered()) <= set(entry_point.queries())
