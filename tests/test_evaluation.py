"""Metrics against brute force and against each other."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from defectlens.operators import baselines as B, evaluation as E, resampling as R, triage

RNG = random.Random(7)
ROWS = [(i, RNG.randint(0, 1), round(RNG.random(), 2)) for i in range(300)]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(ROWS, "sample_id long, label int, score double").withColumn(
        "pred", (F.col("score") >= 0.5).cast("int")
    )


def brute_auc(rows):
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def brute_f1(rows, cutoff):
    tp = sum(y == 1 and s >= cutoff for _, y, s in rows)
    fp = sum(y == 0 and s >= cutoff for _, y, s in rows)
    fn = sum(y == 1 and s < cutoff for _, y, s in rows)
    return 2 * tp / (2 * tp + fp + fn) if tp else 0.0


def test_auc(scored):
    value = E.auc(scored).first()["auc"]
    assert value == pytest.approx(brute_auc(ROWS))
    flipped = scored.withColumn("score", -F.col("score"))
    assert E.auc(flipped).first()["auc"] == pytest.approx(1 - value)


def test_auc_of_a_constant_and_of_one_class(spark):
    constant = spark.createDataFrame([(0, 0.3), (1, 0.3), (1, 0.3)], "label int, score double")
    assert E.auc(constant).first()["auc"] == 0.5
    assert E.auc(constant.where("label = 1")).first()["auc"] is None


def test_binary_metrics_agree_with_single_ones(scored):
    row = E.binary_metrics(scored).first()
    single = E.f1_accuracy(scored).first()
    assert row["auc"] == pytest.approx(brute_auc(ROWS))
    assert (row["f1"], row["accuracy"]) == pytest.approx((single["f1"], single["accuracy"]))


def test_undefined_f1_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, pred int")
    assert E.f1_accuracy(df).first()["f1"] == 0.0
    report = {r["class"]: r for r in E.classification_report(df).collect()}
    assert (report["1"]["precision"], report["0"]["support"]) == (0.0, 1)


def test_sweep_and_best(scored):
    sweep = {r["threshold"]: r["f1"] for r in E.threshold_sweep(scored).collect()}
    assert sorted(sweep) == [k / 100 for k in range(10, 91)]
    for k in range(10, 91):
        assert sweep[k / 100] == pytest.approx(brute_f1(ROWS, k / 100)), k
    best = E.best_threshold(scored).first()
    top = max(sweep.values())
    assert (best["threshold"], best["f1"]) == (min(t for t, f in sweep.items() if f == top), top)


def test_cutoff_index_at_every_hundredth(spark):
    df = spark.createDataFrame([(k, k / 100) for k in range(101)], "k int, s double")
    assert df.where(E.cutoff_index(F.col("s")) != F.col("k")).count() == 0


def test_pr_area(scored):
    points = sorted({s for _, _, s in ROWS}, reverse=True)
    n_pos = sum(y for _, y, _ in ROWS)
    curve = [(0.0, 1.0)]
    for t in points:
        called = [y for _, y, s in ROWS if s >= t]
        curve.append((sum(called) / n_pos, sum(called) / len(called)))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:]))
    assert E.pr_auc(scored).first()["pr_auc"] == pytest.approx(area)
    assert E.pr_curve(scored).count() == len(points) + 1


def test_bootstrap_modes_agree(scored):
    for metric, value in (("f1", "pred"), ("auc", "score"), ("accuracy", "pred")):
        exact = E.bootstrap_interval(scored, metric, value, n_boot=200).first()
        drawn = E.bootstrap_interval(scored, metric, value, n_boot=200, mode="poisson").first()
        assert exact["low"] < exact["point"] < exact["high"]
        assert exact["point"] == pytest.approx(drawn["point"])
        assert exact["low"] == pytest.approx(drawn["low"], abs=0.04)
        assert exact["high"] == pytest.approx(drawn["high"], abs=0.04)


@pytest.mark.parametrize("rate", [1, 5, 40, 64, 65, 1000])
def test_poisson_draws(spark, rate):
    from defectlens.functions.hashing import hash_uniform

    draws = spark.range(4000).select(
        E._poisson_draw(F.lit(float(rate)), hash_uniform(1, F.col("id"))).alias("w")
    ).toPandas()["w"]
    assert draws.mean() == pytest.approx(rate, rel=0.06)
    assert draws.var() == pytest.approx(rate, rel=0.12)


@pytest.mark.parametrize("n, p", [(1, 0.5), (7, 0.1), (50, 0.93), (3000, 0.4), (400_000, 0.01)])
def test_binomial_quantiles(n, p):
    u = (np.arange(4000) + 0.5) / 4000
    drawn = R.binomial(np.full(4000, n), p, u)
    assert drawn.min() >= 0 and drawn.max() <= n
    assert drawn.mean() == pytest.approx(n * p, rel=0.01, abs=0.01)
    assert drawn.var() == pytest.approx(n * p * (1 - p), rel=0.03, abs=0.01)


@pytest.mark.parametrize("block", [4096, 3])
def test_resamples_are_multinomial(spark, block, monkeypatch):
    """Every replicate draws n rows; means and spreads are those of drawing with replacement."""
    monkeypatch.setattr(R, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [(float(rng.integers(0, 30)), int(rng.integers(2))) for _ in range(300)]
    df = spark.createDataFrame([(s, y) for s, y in rows], "score double, label int")
    cells = E.score_cells(df, "label", "score").withColumnRenamed("_score", "score")
    sums = R.resampled(cells, 400, 7).groupBy("replicate").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("tp").alias("tp"),
        F.sum(F.col("won") + F.col("pos") * F.col("lower")).alias("won")).toPandas()
    assert len(sums) == 400 and (sums["pos"] + sums["neg"] == 300).all()
    share = sum(y for _, y in rows) / 300
    assert sums["pos"].mean() == pytest.approx(300 * share, rel=0.02)
    assert sums["pos"].var() == pytest.approx(300 * share * (1 - share), rel=0.25)
    yes = sum(y for s, y in rows if s != 0) / 300
    assert sums["tp"].mean() == pytest.approx(300 * yes, rel=0.02)
    drawn = []
    for _ in range(400):
        sample = [rows[i] for i in rng.integers(0, 300, 300)]
        up, down = np.array([s for s, y in sample if y]), np.array([s for s, y in sample if not y])
        drawn.append(((up[:, None] > down).mean() + (up[:, None] == down).mean() / 2))
    got = sums["won"] / (sums["pos"] * sums["neg"])
    assert got.mean() == pytest.approx(np.mean(drawn), abs=0.01)
    assert got.std() == pytest.approx(np.std(drawn), rel=0.2)


def test_resamples_of_one_cell_and_of_none(spark):
    one = spark.createDataFrame([(0.5, 1)] * 4, "score double, label int")
    cells = E.score_cells(one, "label", "score").withColumnRenamed("_score", "score")
    assert {(r["pos"], r["neg"]) for r in R.resampled(cells, 3, 1).collect()} == {(4, 0)}
    assert R.resampled(cells.where("pos < 0"), 3, 1).collect() == []


def test_bad_arguments(scored):
    with pytest.raises(ValueError):
        E.bootstrap_interval(scored, "gini", "pred")
    with pytest.raises(ValueError):
        E.bootstrap_interval(scored, "f1", "pred", mode="guess")


def test_loc_cutoff_is_chosen_on_the_selection_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), f"t{i % 7}", int(rng.integers(1, 60)), int(rng.integers(0, 2))) for i in range(200)]
    df = spark.createDataFrame(rows, "sample_id int, task_id string, classical_loc int, label int")
    train, val, test = df.where("sample_id < 100"), df.where("sample_id between 100 and 149"), df.where("sample_id >= 150")
    locs = [r[2] for r in rows[:100]]

    def f1(t):
        tp = sum(y == 1 and x > t for _, _, x, y in rows[100:150])
        fp = sum(y == 0 and x > t for _, _, x, y in rows[100:150])
        fn = sum(y == 1 and x <= t for _, _, x, y in rows[100:150])
        return 2 * tp / (2 * tp + fp + fn)

    cuts = [float(np.percentile(locs, p)) for p in range(10, 91, 5)]
    want = max(cuts, key=lambda t: (f1(t), -t))
    assert B.best_loc_cutoff(train, val).first()["cutoff"] == pytest.approx(want)
    judged = B.longer_than_cutoff(train, val, test).collect()
    assert all(r["pred"] == int(r["classical_loc"] > want) for r in judged)
    assert max(r["score"] for r in judged) == 1.0


def test_task_median_falls_back(spark):
    train = spark.createDataFrame([("a", 4), ("a", 8), ("b", 30)], "task_id string, classical_loc int")
    test = spark.createDataFrame([("a", 7), ("a", 6), ("z", 8), ("z", 9)], "task_id string, classical_loc int")
    judged = {(r["task_id"], r["classical_loc"]): r["pred"] for r in B.longer_than_median(train, test).collect()}
    assert judged == {("a", 7): 1, ("a", 6): 0, ("z", 8): 0, ("z", 9): 1}


def test_risk_order(scored):
    ranked = triage.risk_ranking(scored, "sample_id", "score").toPandas().sort_values("risk_rank")
    assert ranked["risk_rank"].tolist() == list(range(1, 301))
    assert ranked["risk"].is_monotonic_decreasing
    assert ranked["risk_band"].value_counts().tolist() == [30] * 10


def test_family_drop(spark):
    families = spark.createDataFrame([("f", "m1"), ("f", "m2"), ("g", "m3")], "family string, model_name string")
    inside = spark.createDataFrame([("f", 0.66, 0.5), ("g", 0.7, 0.6)], "family string, auc double, f1 double")
    held = spark.createDataFrame(
        [("f", 10, 0.61234, 0.45, 0.3)],
        "family string, n_test_rows long, ood_auc double, ood_f1 double, ood_threshold double",
    )
    (row,) = E.family_drop(inside, held, families).collect()
    assert (row["n_models"], row["auc_drop"], row["f1_drop"], row["full_pct"]) == (2, 0.0477, 0.05, 66.0)


@pytest.mark.parametrize("rate", [1, 5, 64, 65, 400, 30_000])
def test_poisson_draws_follow_the_distribution(spark, rate):
    n = 20_000
    drawn = spark.range(n).select(E._poisson_draw(F.lit(float(rate)), (F.col("id") + 0.5) / n).alias("k")).toPandas()["k"]
    # An even grid of u gives each count in proportion to its mass.
    from math import exp, lgamma, log

    counts = drawn.value_counts()
    worst = max(abs(c / n - exp(k * log(rate) - rate - lgamma(k + 1))) for k, c in counts.items())
    assert worst <= 2 / n
    assert abs(drawn.mean() - rate) < 0.02 * rate ** 0.5 and abs(drawn.var() / rate - 1) < 0.02
