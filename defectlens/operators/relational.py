"""Projection, filtering and set operators on sample tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import hash_text


def code_column(df: DataFrame) -> str:
    """Name of the program-text column: ``solution``, else ``generated_code``."""
    return "solution" if "solution" in df.columns else "generated_code"


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace nulls column by column; columns that are absent are left out."""
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in df.columns
    })


def available(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def columns_by_prefix(df: DataFrame, prefixes: Iterable[str]) -> dict[str, list[str]]:
    return {p: [c for c in df.columns if c.startswith(p)] for p in prefixes}


def keep_members(df: DataFrame, members: DataFrame, on: str) -> DataFrame:
    return df.join(members, on, "left_semi")


def drop_members(df: DataFrame, members: DataFrame, on: str) -> DataFrame:
    return df.join(members, on, "left_anti")


def mapping_table(
    spark: SparkSession, mapping: Mapping[str, str], key: str, value: str
) -> DataFrame:
    """A literal mapping as a table; its size is fixed in code."""
    return spark.createDataFrame(list(mapping.items()), f"{key} string, {value} string")


def family_table(spark: SparkSession, families: Mapping[str, Iterable[str]]) -> DataFrame:
    rows = [(family, model) for family, models in families.items() for model in models]
    return spark.createDataFrame(rows, "family string, model_name string")


def sample_n(df: DataFrame, n: int, key: str, seed=42) -> DataFrame:
    """Exactly n rows (all rows if fewer), the same ones for the same seed.

    ``orderBy.limit`` keeps n rows per task and merges those.
    """
    return df.orderBy(hash_text(seed, F.col(key)), key).limit(n)


def max_normalise(df: DataFrame, col: str, out: str) -> DataFrame:
    top = df.agg(F.max(col)).scalar()
    return df.withColumn(out, F.col(col) / F.when(top != 0, top))


def label_at(score: Column, cutoff: float | Column) -> Column:
    """1 where the score reaches the cutoff, a number or a column."""
    return (score >= cutoff).cast("int")


def union_all(*frames: DataFrame) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result
