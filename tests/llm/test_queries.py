"""Queries with SQL agree with it on the whole tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from defectlens.llm.queries import oracles, registered


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("" if v is None or v != v else repr(v) for v in row)
                  for row in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(oracles()))
def test_against_sql(spark, duck, sf_dir, name):
    got = registered()[name](spark, sf_dir).toPandas()
    want = duck.execute(oracles()[name]).to_arrow_table().to_pandas()  # null integers as in Spark's
    assert sorted(got.columns) == sorted(want.columns)
    for column in got.columns:
        assert got[column].dtype == want[column].dtype, column
    assert rows(got) == rows(want)


def test_all_are_registered():
    names = set(entry_point.queries())
    assert set(registered()) < names and "pipeline" in names
