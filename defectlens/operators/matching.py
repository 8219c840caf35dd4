"""Joining programs to their evaluation results and task descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import normalise_name, text_or_empty
from ..session import materialise

TASK_TEXTS = ("complete_prompt", "instruct_prompt", "libs", "entry_point")


def model_pairs(samples: DataFrame, evals: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per (split, sample_model) with the matching ``eval_model`` or null.

    An alias decides alone: if its target has no results the model stays unmatched.
    Otherwise the normalised names must agree; when several evaluation names share a
    normal form the smallest is taken.
    """
    evaluated = evals.select("split", "eval_model").distinct()
    by_norm = (
        evaluated.withColumn("norm", normalise_name(F.col("eval_model")))
        .groupBy("split", "norm")
        .agg(F.min("eval_model").alias("norm_model"))
    )
    sampled = samples.select("split", "sample_model").distinct()
    named = sampled.join(
        aliases.select("sample_model", F.col("eval_model").alias("alias_model")),
        "sample_model", "left",
    ).withColumn("norm", F.when(F.col("alias_model").isNull(), normalise_name(F.col("sample_model"))))
    candidates = named.join(by_norm, ["split", "norm"], "left").select(
        "split", "sample_model", F.coalesce("alias_model", "norm_model").alias("candidate")
    )
    present = evaluated.withColumnRenamed("eval_model", "candidate").withColumn(
        "eval_model", F.col("candidate")
    )
    return candidates.join(present, ["split", "candidate"], "left").select(
        "split", "sample_model", "eval_model"
    )


def match_labels(samples: DataFrame, evals: DataFrame, aliases: DataFrame) -> DataFrame:
    """Programs with their pass/fail label; programs without one are dropped.

    ``samples``: split, sample_model, task_id, solution.
    ``evals``: split, eval_model, task_id, status.
    """
    # Written first, so that the planner sees how small the name table is: texts are then
    # not shuffled by model, of which there are few and some with very many rows.
    pairs = materialise(model_pairs(samples, evals, aliases).where(F.col("eval_model").isNotNull()))
    results = evals.where(F.col("status").isNotNull())
    return (
        samples.join(pairs, ["split", "sample_model"])
        .join(results, ["split", "eval_model", "task_id"])
        .select(
            "task_id",
            F.col("eval_model").alias("model_name"),
            "split",
            text_or_empty(F.col("solution")).alias("solution"),
            F.col("status").cast("int").alias("label"),
        )
    )


def match_summary(samples: DataFrame, evals: DataFrame, aliases: DataFrame) -> DataFrame:
    """Matched and skipped model counts per split."""
    return (
        model_pairs(samples, evals, aliases)
        .groupBy("split")
        .agg(
            F.count("eval_model").alias("matched"),
            F.count_if(F.col("eval_model").isNull()).alias("skipped"),
        )
    )


def skipped_models(samples: DataFrame, evals: DataFrame, aliases: DataFrame) -> DataFrame:
    return (
        model_pairs(samples, evals, aliases)
        .where(F.col("eval_model").isNull())
        .select("split", "sample_model")
    )


def enrich(samples: DataFrame, tasks: DataFrame) -> DataFrame:
    """Left join of task texts. No broadcast hint: the task table may grow with the data,
    so its measured size decides."""
    described = tasks.select(
        "task_id", *[text_or_empty(F.col(c)).alias(c) for c in TASK_TEXTS if c in tasks.columns]
    )
    return samples.join(described, "task_id", "left")
