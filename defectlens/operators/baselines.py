"""Predictors that need no training: each returns the test rows with ``pred`` and ``score``.

Medians and percentiles are exact and come from counts of equal values, cut into buckets:
no task holds all values of a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import hash_uniform
from .evaluation import f1_of
from .ordering import exact_quantiles
from .relational import max_normalise

LOC = "classical_loc"
PERCENTS = range(10, 91, 5)


def always_fail(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Prediction 0 for all rows; the score is the train fail rate, a constant."""
    fail_rate = train.agg(1 - F.avg(label)).scalar()
    return test.withColumns({"pred": F.lit(0), "score": fail_rate})


def random_at_class_rate(
    train: DataFrame, test: DataFrame, ident: str = "sample_id", label: str = "label", seed=42
) -> DataFrame:
    """A coin per row at the train pass rate p. The score is p for passes and 1 - p for
    fails, so it ranks predicted passes lower when p is under one half."""
    rate = train.agg(F.avg(label)).scalar()
    tossed = test.withColumn("pred", (hash_uniform(seed, F.col(ident)) < rate).cast("int"))
    return tossed.withColumn("score", F.when(F.col("pred") == 1, rate).otherwise(1 - rate))


def longer_than_median(
    train: DataFrame, test: DataFrame, group: str = "task_id", loc: str = LOC
) -> DataFrame:
    """Pass if longer than the train median of the task, or than the overall train median
    for tasks that train does not have (all of them after a split by task)."""
    by_task = exact_quantiles(train, loc, [0.5], [group]).select(group, F.col("quantile").alias("_median"))
    overall = exact_quantiles(train, loc, [0.5]).select("quantile").scalar()
    judged = test.join(by_task, group, "left").withColumn(
        "pred", (F.col(loc) > F.coalesce("_median", overall)).cast("int")
    )
    return max_normalise(judged.drop("_median"), loc, "score")


def loc_cutoffs(train: DataFrame, loc: str = LOC) -> DataFrame:
    """One row, one array: (percent, cutoff) at percentiles 10, 15 ... 90 of train line counts."""
    cuts = exact_quantiles(train, loc, [p / 100 for p in PERCENTS])  # one row each
    percent = F.round(F.col("prob") * 100).cast("int")
    return cuts.agg(
        F.sort_array(F.collect_list(F.struct(percent.alias("percent"), F.col("quantile").alias("cutoff")))).alias("cutoffs"))


def best_loc_cutoff(
    train: DataFrame, select_on: DataFrame, loc: str = LOC, label: str = "label"
) -> DataFrame:
    """The percentile cutoff with the best F1 on ``select_on``, the lowest percentile on
    ties, 0 if none scores above 0.

    Rows are counted per line count first; the 17 cutoffs then meet those counts.
    """
    cutoffs = loc_cutoffs(train, loc).scalar()
    counts = select_on.groupBy(loc).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    longer = F.col(loc) > F.col("c.cutoff")
    zero = F.lit(0).cast("long")
    scored = (
        counts.withColumn("c", F.explode(cutoffs))
        .groupBy(F.col("c.percent").alias("percent"), F.col("c.cutoff").alias("cutoff"))
        .agg(
            F.coalesce(F.sum(F.when(longer, F.col("pos"))), zero).alias("tp"),
            F.coalesce(F.sum(F.when(longer, F.col("neg"))), zero).alias("fp"),
            F.sum("pos").alias("p"),
        )
        .withColumn("f1", f1_of(F.col("tp"), F.col("fp"), F.col("p") - F.col("tp")))
    )
    best = scored.where(F.col("f1") > 0).agg(
        F.max(F.struct("f1", (-F.col("percent")).alias("order"), "cutoff")).alias("b")
    )
    return best.select(F.coalesce("b.cutoff", F.lit(0.0)).alias("cutoff"))


def longer_than_cutoff(
    train: DataFrame, select_on: DataFrame, test: DataFrame, loc: str = LOC, label: str = "label"
) -> DataFrame:
    """Pass if longer than the cutoff chosen on ``select_on`` (validation by default use;
    pass the test rows themselves to choose it on test)."""
    cutoff = best_loc_cutoff(train, select_on, loc, label).scalar()
    judged = test.withColumn("pred", (F.col(loc) > cutoff).cast("int"))
    return max_normalise(judged, loc, "score")
