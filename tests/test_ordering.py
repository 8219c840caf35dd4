"""Distributed running totals, quantiles and ranks against brute force."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from defectlens.operators import ordering as O

VALUES = st.lists(
    st.one_of(
        st.sampled_from([0.0, -1.0, 1.0, 1e-9, 1e12, -1e12, 0.5]),
        st.floats(-1e6, 1e6, allow_nan=False),
    ),
    min_size=1, max_size=30,
)
FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@FEW
@given(VALUES)
def test_running_totals(spark, values):
    cells = spark.createDataFrame([(float(v),) for v in values], "v double").groupBy("v").agg(
        F.count("*").alias("n")
    )
    got = {r["v"]: (r["n_below"], r["n_total"]) for r in O.running_totals(cells, "v", ["n"]).collect()}
    assert got == {v: (sum(w < v for w in values), len(values)) for v in values}


@FEW
@given(VALUES)
def test_quantiles(spark, values):
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(values)], "g int, v double")
    probs = [0.0, 0.1, 0.5, 0.85, 1.0]
    got = {(r["g"], r["prob"]): r["quantile"] for r in O.exact_quantiles(df, "v", probs, ["g"]).collect()}
    for g in {i % 2 for i in range(len(values))}:
        part = [v for i, v in enumerate(values) if i % 2 == g]
        for p in probs:
            assert got[g, p] == pytest.approx(float(np.quantile(part, p)), rel=1e-9, abs=1e-9)


def test_hot_value_dominates(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") / 10).alias("v"), "id")
    ranked = O.value_rank(df, "v", "id").toPandas()
    assert sorted(ranked["rank"]) == list(range(3000))
    ordered = ranked.sort_values("rank")["v"].tolist()
    assert ordered == sorted(ordered)
    got = O.exact_quantiles(df, "v", [0.25, 0.5]).orderBy("prob").toPandas()["quantile"].tolist()
    assert got == pytest.approx(np.quantile(ranked["v"], [0.25, 0.5]).tolist())


def test_hash_rank_is_a_permutation_per_stratum(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("s"))
    rows = O.hash_rank(df, "k", 42, ["s"]).toPandas()
    for _, part in rows.groupby("s"):
        assert sorted(part["rank"]) == list(range(len(part)))
        assert set(part["n"]) == {len(part)}
    other = O.hash_rank(df, "k", 43, ["s"]).toPandas()
    assert rows.sort_values("k")["rank"].tolist() != other.sort_values("k")["rank"].tolist()


def test_null_key_is_a_group_of_its_own(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    got = {r["g"]: r["quantile"] for r in O.exact_quantiles(df, "v", [0.5], ["g"]).collect()}
    assert got == {None: 2.0, "a": 5.0}


@FEW
@given(st.lists(st.floats(-1e15, 1e15, allow_nan=False), min_size=2, max_size=40))
def test_buckets_are_monotone(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    placed = df.crossJoin(O.split_points(df, "v")).select("v", O.bucket_of(F.col("v"), F.col("_splits")).alias("b"))
    rows = sorted((r["v"], r["b"]) for r in placed.collect())
    assert [b for _, b in rows] == [len({w for w in values if w <= v}) for v, _ in rows]


@pytest.mark.parametrize("expression", [
    "1.7e9 + id", "1 - id / 1e10", "id * id * id", "if(id < 2, -1e300, id * 1e-12)", "if(id % 100 = 0, id, 0.5 + id / 1e9)",
])
def test_no_bucket_is_large(spark, expression):
    df = spark.range(40_000).select(F.expr(expression).cast("double").alias("v"))
    placed = df.crossJoin(O.split_points(df, "v")).select(O.bucket_of(F.col("v"), F.col("_splits")).alias("b"))
    sizes = placed.groupBy("b").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] < 0.02 * 40_000 and sizes[1] > 1000


def test_nan_is_the_largest_value(spark):
    nan = float("nan")
    df = spark.createDataFrame([(-1.0,), (1.0,), (2.0,), (3.0,), (nan,)], "v double")
    got = {r["prob"]: r["quantile"] for r in O.exact_quantiles(df, "v", [0.0, 0.5, 1.0]).collect()}
    assert got[0.0] == -1.0 and got[0.5] == 2.0 and np.isnan(got[1.0])
    ranked = O.value_rank(spark.createDataFrame([(1, nan), (2, 0.5)], "id int, v double"), "v", "id")
    assert {r["id"]: r["rank"] for r in ranked.collect()} == {2: 0, 1: 1}
