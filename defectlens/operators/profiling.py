"""Dataset profiles and corpus findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.text import line_count
from .ordering import exact_quantiles


def overview(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("model_name").alias("n_models"),
        F.countDistinct("task_id").alias("n_tasks"),
        F.round(F.avg("label"), 6).alias("pass_rate"),
    )


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"))


def pass_rate_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.round(F.avg("label"), 6).alias("pass_rate")
    )


def leaderboard(df: DataFrame, k: int = 10) -> DataFrame:
    """The k best and the k worst models by pass rate, ties by name."""
    rates = pass_rate_by(df, "model_name")
    best = rates.orderBy(F.desc("pass_rate"), "model_name").limit(k)
    worst = rates.orderBy("pass_rate", "model_name").limit(k)
    return best.withColumn("place", F.lit("top")).unionByName(
        worst.withColumn("place", F.lit("bottom"))
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and type of every column from one scan, without a shuffle of rows."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    types = dict(df.dtypes)
    return counted.select(
        F.explode(
            F.array(*[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.lit(types[c]).alias("column_type"),
                    F.col(c).alias("n_null"),
                )
                for c in df.columns
            ])
        ).alias("r")
    ).select("r.*")


def text_measures(df: DataFrame, text: str) -> DataFrame:
    return df.withColumns({
        "n_text_chars": F.length(text).cast("long"),
        "n_text_lines": line_count(F.col(text)).cast("long"),
    })


def five_numbers(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles per measure, one row each."""
    tall = df.select(
        F.explode(
            F.array(*[
                F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"))
                for m in measures
            ])
        ).alias("r")
    ).select("r.*")
    moments = tall.groupBy("measure").agg(
        F.count("value").alias("n"),
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.stddev_samp("value"), 6).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    names = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    quartiles = (
        exact_quantiles(tall, "value", list(names), ["measure"])
        .groupBy("measure")
        .agg(*[
            F.round(F.max(F.when(F.col("prob") == p, F.col("quantile"))), 6).alias(name)
            for p, name in names.items()
        ])
    )
    return moments.join(quartiles, "measure")


def group_median(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Exact median per group; safe for groups and value domains of any size."""
    return exact_quantiles(df, value, [0.5], keys).select(
        *keys, F.col("quantile").alias("median")
    )


def correlations(df: DataFrame, features: Sequence[str], target: str, k: int | None = 10) -> DataFrame:
    """Pearson correlation of each feature with the target, largest size first."""
    measured = df.agg(*[F.corr(F.col(f).cast("double"), F.col(target).cast("double")).alias(f) for f in features])
    tall = measured.select(
        F.explode(
            F.array(*[
                F.struct(F.lit(f).alias("feature"), F.round(F.col(f), 6).alias("correlation"))
                for f in features
            ])
        ).alias("r")
    ).select("r.*")
    # A feature that never varies has no correlation: it goes last.
    size = F.when(~F.isnan("correlation"), F.abs("correlation"))
    ranked = tall.orderBy(F.desc_nulls_last(size), "feature")
    return ranked if k is None else ranked.limit(k)


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    fails = F.count_if(F.col(label) == 0)
    passes = F.count_if(F.col(label) == 1)
    return df.agg(
        fails.alias("n_fail"),
        passes.alias("n_pass"),
        F.round(F.try_divide(fails, passes), 6).alias("fail_per_pass"),
    )


def pass_fail_gap(df: DataFrame, text: str) -> DataFrame:
    measured = text_measures(df, text)

    def gap(col):
        passed = F.avg(F.when(F.col("label") == 1, F.col(col)))
        failed = F.avg(F.when(F.col("label") == 0, F.col(col)))
        return F.round(passed - failed, 6)

    return measured.agg(
        gap("n_text_chars").alias("char_gap"), gap("n_text_lines").alias("line_gap")
    )


def task_difficulty(df: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    rates = df.groupBy("task_id").agg(F.avg("label").alias("rate"))
    unsolved = F.count_if(F.col("rate") == 0)
    contested = F.count_if(F.col("rate").between(low, high))
    return rates.agg(
        F.count("*").alias("n_tasks"),
        unsolved.alias("n_unsolved"),
        contested.alias("n_contested"),
        F.round(contested / F.count("*"), 6).alias("contested_share"),
    )


def failure_overlap(df: DataFrame, k: int = 5) -> DataFrame:
    """Of the tasks failed by all k best models, the share failed by all k worst too.

    A model fails a task when none of its tries passes; every model of the set must
    have tried the task.
    """
    rates = df.groupBy("model_name").agg(F.round(F.avg("label"), 6).alias("rate"))
    best = rates.orderBy(F.desc("rate"), "model_name").limit(k).select("model_name")
    worst = rates.orderBy("rate", "model_name").limit(k).select("model_name")

    def failed_by_all(models: DataFrame) -> DataFrame:
        return (
            df.join(models, "model_name", "left_semi")
            .groupBy("task_id", "model_name").agg(F.max("label").alias("solved"))
            .groupBy("task_id").agg(F.sum("solved").alias("solvers"), F.count("*").alias("tried"))
            .where((F.col("solvers") == 0) & (F.col("tried") == models.agg(F.count("*")).scalar()))
            .select("task_id")
        )

    first = failed_by_all(best)
    both = first.intersect(failed_by_all(worst)).withColumn("shared", F.lit(1))
    return first.join(both, "task_id", "left").agg(
        F.count("*").alias("n_failed_by_best"),
        F.count("shared").alias("n_shared"),
        F.round(F.try_divide(F.count("shared"), F.count("*")), 6).alias("overlap"),
    )


def library_pass_rate(df: DataFrame, libs: str = "libs") -> DataFrame:
    """``libs`` is an array column."""
    return (
        df.select(F.explode(libs).alias("library"), "label")
        .groupBy("library")
        .agg(F.count("*").alias("n_rows"), F.round(F.avg("label"), 6).alias("pass_rate"))
    )
