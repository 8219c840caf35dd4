"""Running totals, exact quantiles and ranks without a single-task window.

A plain ``Window.orderBy`` sends every row to one task. Here an order is cut into
buckets at values drawn from the data itself. Running totals inside a bucket come from
a window partitioned by the bucket; totals of the lower buckets come from a second
window over bucket sums, whose number is bounded whatever the size of the data.

NaN is the largest value, as in Spark's own ordering.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import hash_text

_SPLITS = 1023  # one less than a power of two, for the search by halves


def split_points(cells: DataFrame, value: str) -> DataFrame:
    """One row: up to ``_SPLITS`` of the distinct values, in order.

    The values of least hash are a sample that does not depend on how often they occur,
    on their size or spacing, nor on the plan: computed twice it is the same.
    """
    values = cells.select((F.col(value).cast("double") + 0.0).alias("_v")).distinct()
    least = values.orderBy(F.xxhash64("_v"), "_v").limit(_SPLITS)
    return least.agg(F.sort_array(F.collect_list("_v")).alias("_splits"))


def bucket_of(value: Column, splits: Column) -> Column:
    """How many split points the value reaches, found by halves; 0 for a null."""
    steps = F.array(*[F.lit((_SPLITS + 1) >> k) for k in range(1, _SPLITS.bit_length() + 1)])

    def onward(at: Column, step: Column) -> Column:
        reached = (at + step <= F.size(splits)) & (F.get(splits, at + step - 1) <= value)
        return F.when(reached, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), onward)


def _join_offsets(rows: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on null-safe keys; the offsets' own key columns are dropped."""
    renamed = offsets.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    matches = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return rows.join(renamed, reduce(lambda a, b: a & b, matches)).drop(*[f"_of_{k}" for k in keys])


def running_totals(
    cells: DataFrame, value: str, sums: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Add ``<sum>_below`` and ``<sum>_total`` to a frame with one row per (keys, value).

    ``<sum>_below`` adds up the rows of the same keys with a strictly lower value.
    """
    keys = list(keys)
    # One row of bounded size on the other side.
    placed = cells.crossJoin(F.broadcast(split_points(cells, value)))
    bucketed = placed.withColumn("_b", bucket_of(F.col(value).cast("double"), F.col("_splits"))).drop("_splits")

    within = Window.partitionBy(*keys, "_b").orderBy(value)
    lower = within.rowsBetween(Window.unboundedPreceding, -1)
    inner = bucketed.select(
        "*", *[F.coalesce(F.sum(s).over(lower), F.lit(0)).alias(f"_in_{s}") for s in sums]
    )

    # One row per bucket: bounded by the bucket count, so one task per key is safe.
    per_bucket = bucketed.groupBy(*keys, "_b").agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
    everything = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = everything.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys,
        "_b",
        *[F.coalesce(F.sum(f"_sum_{s}").over(before), F.lit(0)).alias(f"_out_{s}") for s in sums],
        *[F.sum(f"_sum_{s}").over(everything).alias(f"{s}_total") for s in sums],
    )
    return _join_offsets(inner, offsets, [*keys, "_b"]).select(
        *cells.columns,
        *[(F.col(f"_in_{s}") + F.col(f"_out_{s}")).alias(f"{s}_below") for s in sums],
        *[F.col(f"{s}_total") for s in sums],
    )


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, long form: keys, prob, quantile.

    Values are counted first, so a hot key costs its distinct values, not its rows,
    and no task ever holds a whole group.
    """
    keys = list(keys)
    cells = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_n"))
    )
    ranked = running_totals(cells, "_v", ["_n"], keys)
    position = F.col("prob") * (F.col("_n_total") - 1)
    spots = ranked.select(
        *keys,
        "_v", "_n", "_n_below", "_n_total",
        F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"),
    )

    def at(rank: Column) -> Column:
        here = (F.col("_n_below") <= rank) & (rank < F.col("_n_below") + F.col("_n"))
        return F.max(F.when(here, F.col("_v")))

    low, high = at(F.floor(position)), at(F.ceil(position))
    part = F.max(position - F.floor(position))
    near = F.floor(position) < F.col("_n_below") + F.col("_n")
    far = F.ceil(position) >= F.col("_n_below")
    return (
        spots.where(near & far)
        .groupBy(*keys, "prob")
        .agg((low + (high - low) * part).alias("quantile"))
    )


def hash_rank(df: DataFrame, ident: str, seed, strata: Sequence[str] = ()) -> DataFrame:
    """Zero-based ``rank`` of each distinct id in seeded hash order, and ``n``, per stratum.

    The first three hex digits cut the order into 4,096 even buckets, so the work is
    spread however large a stratum is.
    """
    strata = list(strata)
    hashed = df.withColumn("_h", hash_text(seed, F.col(ident))).withColumn(
        "_b", F.substring("_h", 1, 3)
    )
    sizes = hashed.groupBy(*strata, "_b").agg(F.count("*").alias("_c"))
    everything = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    before = everything.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *strata,
        "_b",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"),
        F.sum("_c").over(everything).alias("n"),
    )
    within = Window.partitionBy(*strata, "_b").orderBy("_h", ident)
    numbered = hashed.withColumn("_r", F.row_number().over(within) - 1)
    return _join_offsets(numbered, offsets, [*strata, "_b"]).select(
        *df.columns,
        (F.col("_start") + F.col("_r")).alias("rank"),
        F.col("n"),
    )


def value_rank(df: DataFrame, value: str, ident: str, seed="tie") -> DataFrame:
    """Zero-based ``rank`` of every row by value, ties in hash order of the id, and ``n``.

    A value shared by a third of the rows is split over 4,096 hash buckets.
    """
    hashed = df.withColumn("_h", hash_text(seed, F.col(ident))).withColumn(
        "_b3", F.substring("_h", 1, 3)
    )
    ties = hashed.groupBy(value, "_b3").agg(F.count("*").alias("_c"))
    by_value = running_totals(
        ties.groupBy(value).agg(F.sum("_c").alias("_rows")), value, ["_rows"]
    )
    earlier = Window.partitionBy(value).orderBy("_b3").rowsBetween(Window.unboundedPreceding, -1)
    tie_offsets = ties.select(
        value, "_b3", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_tie")
    )
    starts = _join_offsets(
        tie_offsets, by_value.select(value, "_rows_below", F.col("_rows_total").alias("n")), [value]
    ).select(value, "_b3", (F.col("_tie") + F.col("_rows_below")).alias("_start"), "n")
    within = Window.partitionBy(value, "_b3").orderBy("_h", ident)
    numbered = hashed.withColumn("_r", F.row_number().over(within) - 1)
    return _join_offsets(numbered, starts, [value, "_b3"]).select(
        *df.columns,
        (F.col("_start") + F.col("_r")).alias("rank"),
        F.col("n"),
    )
