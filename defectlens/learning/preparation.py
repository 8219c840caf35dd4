"""Class weights, imputation, scaling and feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from ..operators.ordering import exact_quantiles


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n / (2 n_c) of each class, and negatives per positive."""
    n0, n1 = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(
        F.round((n0 + n1) / (2 * n0), 6).alias("weight_fail"),
        F.round((n0 + n1) / (2 * n1), 6).alias("weight_pass"),
        F.round(n0 / n1, 6).alias("fail_per_pass"),
    )


def class_counts(df: DataFrame, label: str = "label") -> tuple[int, int]:
    """Fails and passes: two numbers on the driver, from one combined aggregate."""
    row = df.agg(
        F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")
    ).first()
    return row["n0"], row["n1"]


def with_balanced_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Row weight n / (2 n_c); the weights add up to the row count."""
    n0, n1 = class_counts(df, label)
    total = n0 + n1
    return df.withColumn(
        out, F.when(F.col(label) == 1, total / (2 * max(n1, 1))).otherwise(total / (2 * max(n0, 1)))
    )


def with_positive_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Positives weigh negatives-per-positive, negatives 1."""
    n0, n1 = class_counts(df, label)
    return df.withColumn(out, F.when(F.col(label) == 1, n0 / max(n1, 1)).otherwise(1.0))


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, median) over non-null values: exact, whatever the number of distinct values."""
    tall = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
        ).alias("r")
    ).select("r.*")
    return exact_quantiles(tall, "v", [0.5], ["column"]).select(
        "column", F.col("quantile").alias("median")
    )


def impute_median(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Fill nulls with the median of each column of ``fitted_on``."""
    medians = column_medians(fitted_on if fitted_on is not None else df, columns)
    by_name = medians.agg(F.map_from_entries(F.collect_list(F.struct("column", "median")))).scalar()
    return df.withColumn("_m", by_name).withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.col("_m")[c]) for c in columns
    }).drop("_m")


class _FilledColumns(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Columns in, columns without nulls out, one for one."""


class MedianFiller(_FilledColumns, Estimator):
    """A pipeline stage that fills nulls, as :func:`impute_median` does, by the exact medians of the
    rows it is fitted on. A column without values is filled by 0."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, outputCols: Sequence[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MedianFillerModel:
        columns = self.getInputCols()
        # A number per column comes back.
        found = {r["column"]: r["median"] for r in column_medians(dataset, columns).collect()}
        filled = MedianFillerModel(medians=[found.get(c) or 0.0 for c in columns])
        return self._copyValues(filled)


class MedianFillerModel(_FilledColumns, Model):
    medians = Param(Params._dummy(), "medians", "what fills each input column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, medians: Sequence[float] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({
            out: F.coalesce(F.col(c).cast("double"), F.lit(float(m)))
            for c, out, m in zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.medians))})


def standardise(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation; constant columns are only centred."""
    source = fitted_on if fitted_on is not None else df
    stats = source.agg(
        F.struct(*[
            F.struct(F.avg(F.col(c).cast("double")).alias("m"), F.stddev_pop(F.col(c).cast("double")).alias("s")).alias(c)
            for c in columns
        ]).alias("s")
    ).scalar()

    def scaled(c):
        spread = F.col("_s")[c]["s"]
        return (F.col(c) - F.col("_s")[c]["m"]) / F.when(spread == 0, 1.0).otherwise(spread)

    return df.withColumn("_s", stats).withColumns({c: scaled(c) for c in columns}).drop("_s")


def static_vectors(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Dense feature vector, nulls as 0."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(filled)
