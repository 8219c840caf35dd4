"""Leak-free splits and folds by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .ordering import hash_rank

FOLDS = ("train", "val", "test")


def assign_groups(
    df: DataFrame, group: str = "task_id", ratios: Sequence[float] = (0.70, 0.15, 0.15), seed=42
) -> DataFrame:
    """(group, fold): the first int(n*r) groups in seeded order are train, then val, then test."""
    if group not in df.columns:
        raise ValueError(f"no column {group!r} to split by")
    if abs(sum(ratios) - 1.0) > 1e-8:
        raise ValueError("split ratios must add up to 1")
    groups = df.select(group).where(F.col(group).isNotNull()).distinct()
    ranked = hash_rank(groups, group, seed)
    train_end = F.floor(F.col("n") * F.lit(float(ratios[0])))
    val_end = train_end + F.floor(F.col("n") * F.lit(float(ratios[1])))
    fold = (
        F.when(F.col("rank") < train_end, FOLDS[0])
        .when(F.col("rank") < val_end, FOLDS[1])
        .otherwise(FOLDS[2])
    )
    return ranked.select(group, fold.alias("fold"))


def group_split(df: DataFrame, group: str = "task_id", **options) -> DataFrame:
    """Rows with their ``fold``; rows without a group fall out.

    The assignment is written first. Its size is then known when the join is planned:
    up to the session's broadcast limit the rows, which carry whole texts, stay where
    they are, and a group with a third of them does not matter. Beyond it both sides
    are shuffled by group, with adaptive splitting of the hot ones.
    """
    return df.join(materialise(assign_groups(df, group, **options)), group)


def split_summary(df: DataFrame, group: str = "task_id") -> DataFrame:
    return df.groupBy("fold").agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(group).alias("n_tasks"),
        F.round(F.avg("label"), 6).alias("pass_rate"),
    )


def split_overlap(df: DataFrame, group: str = "task_id") -> DataFrame:
    """Number of groups that two folds share; every count is 0 for a clean split."""
    folds = ("train", "val", "test")
    held = df.groupBy(group).agg(*[F.bool_or(F.col("fold") == f).alias(f) for f in folds])
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    counts = held.agg(F.array(*[
        F.struct(F.lit(f"{a}-{b}").alias("pair"), F.count_if(F.col(a) & F.col(b)).alias("n_shared")) for a, b in pairs
    ]).alias("counts"))
    return counts.select(F.explode("counts").alias("c")).select("c.*")


def stratified_group_folds(
    df: DataFrame, k: int = 5, group: str = "task_id", label: str = "label", seed=42, strata: int = 10
) -> DataFrame:
    """(group, foldCol): groups ordered by pass-rate band, then by seeded hash, are dealt
    out in turn, so folds get equal shares of every band."""
    rates = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.avg(label).alias("_rate"))
    banded = rates.select(
        group, F.least(F.floor(F.col("_rate") * strata), F.lit(strata - 1)).alias("stratum")
    )
    ranked = hash_rank(banded, group, seed, ["stratum"])
    # At most ``strata`` rows: where each stratum starts in the overall order.
    lower = Window.partitionBy(F.lit(0)).orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)
    starts = banded.groupBy("stratum").agg(F.count("*").alias("_c")).select(
        "stratum", F.coalesce(F.sum("_c").over(lower), F.lit(0)).alias("_start")
    )
    return ranked.join(F.broadcast(starts), "stratum").select(
        group, ((F.col("_start") + F.col("rank")) % k).cast("int").alias("foldCol")
    )


def without_family(df: DataFrame, members: DataFrame) -> DataFrame:
    return df.join(members.select("model_name"), "model_name", "left_anti")


def only_family(df: DataFrame, members: DataFrame) -> DataFrame:
    return df.join(members.select("model_name"), "model_name", "left_semi")


def holdout_sizes(df: DataFrame, families: DataFrame) -> DataFrame:
    """Train, val and test rows of each leave-one-family-out run, in one pass.

    Rows are counted per (family, fold) once; what a run keeps is the fold total
    minus the family's own rows. Families without test rows are left out.
    """
    def in_fold(fold):
        return F.count_if(F.col("fold") == fold)

    counted = [in_fold(f).alias(f) for f in FOLDS]
    totals = df.agg(*counted)
    own = df.join(families, "model_name").groupBy("family").agg(*counted)
    return own.where(F.col("test") > 0).select(
        "family",
        (totals.select("train").scalar() - F.col("train")).alias("n_train"),
        (totals.select("val").scalar() - F.col("val")).alias("n_val"),
        F.col("test").alias("n_test"),
    )
