"""Acting on scores: rank, route, and choose a cutoff for the capacity at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .evaluation import cutoff_counts
from .ordering import value_rank


def risk_ranking(df: DataFrame, ident: str, score: str, bands: int = 10) -> DataFrame:
    """Samples by failure risk (1 - score), riskiest first, in equal bands."""
    # The score itself is ordered, rounded once: lowest score = highest risk.
    ranked = value_rank(df.select(ident, score), score, ident)
    return ranked.select(
        ident,
        F.round(1 - F.col(score), 6).alias("risk"),
        (F.col("rank") + 1).alias("risk_rank"),
        (F.floor(F.col("rank") * bands / F.col("n")) + 1).cast("int").alias("risk_band"),
    )


def route(df: DataFrame, score: str, senior_above: float = 0.6, auto_below: float = 0.3) -> DataFrame:
    """Add ``route``: high risk to a senior reviewer, low risk to automated checks."""
    risk = 1 - F.col(score)
    return df.withColumn(
        "route",
        F.when(risk >= senior_above, "senior").when(risk < auto_below, "automated").otherwise("junior"),
    )


def retry_flag(df: DataFrame, score: str, cutoff: float) -> DataFrame:
    """Add ``retry``: 1 where the failure risk reaches the cutoff."""
    return df.withColumn("retry", (1 - F.col(score) >= cutoff).cast("int"))


def capacity_curve(df: DataFrame, label: str, risk: str) -> DataFrame:
    """Per risk cutoff: share of samples flagged, share of failures caught, precision.

    A logged failure (label 0) is what the curve is about, so classes are swapped.
    """
    flipped = df.select((1 - F.col(label)).alias("failed"), F.col(risk).alias("risk"))
    flagged = F.col("tp") + F.col("fp")
    total = F.col("n_pos") + F.col("n_neg")
    return cutoff_counts(flipped, "failed", "risk").select(
        "threshold",
        flagged.alias("n_flagged"),
        F.round(flagged / total, 6).alias("load"),
        F.round(F.coalesce(F.try_divide("tp", "n_pos"), F.lit(0.0)), 6).alias("catch_rate"),
        F.round(F.coalesce(F.try_divide("tp", flagged), F.lit(0.0)), 6).alias("precision"),
    )
