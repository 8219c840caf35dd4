"""Places of rows in a global order, without a window over all of them.

Rows are dealt out by range, sorted inside their range, and written once; a row's place is that
in its range plus the rows of earlier ranges. The only window over a whole group sees one row
per range, so its size is the number of shuffle partitions. Rows equal in every column are dealt
out by a salt, so a third of all rows being alike fill several ranges; their places are then
arbitrary, which no result can tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import materialise

#: ``monotonically_increasing_id`` has the partition above this bit and the row below it.
_PART_BIT = 33


def numbered(df: DataFrame, by: list[str], within: str | None = None, weight: Column | None = None) -> DataFrame:
    """``df`` with ``rank``, ``total`` and, given a ``weight``, ``before``; null keys come first.

    ``rank`` counts from 0 in the order of ``by``, ``total`` is the number of rows; with ``within``,
    which must be the first of ``by`` and not null, both are those of the row's group. ``before`` is
    the weight of all rows of lower rank. An empty table gives no rows. ``df`` is read twice, once
    for a sample of its keys: hand over a narrow written table. Names beginning with ``_n_`` are
    taken.
    """
    assert within is None or within == by[0]
    weighed = df if weight is None else df.withColumn("_n_weight", weight)
    salted = weighed.withColumn("_n_salt", F.xxhash64(F.monotonically_increasing_id()))
    placed = materialise(
        salted.repartitionByRange(*by, "_n_salt").sortWithinPartitions(*by)
        .withColumn("_n_at", F.monotonically_increasing_id()).drop("_n_salt"))
    placed = placed.withColumn("_n_part", F.shiftright("_n_at", _PART_BIT)) \
        .withColumn("_n_group", F.col(within) if within else F.lit(0))

    earlier = Window.partitionBy("_n_group").orderBy("_n_part").rowsBetween(Window.unboundedPreceding, -1)
    rows = F.count(F.lit(1)).alias("_n_rows")
    weights = [] if weight is None else [F.sum("_n_weight").alias("_n_weights")]
    starts = placed.groupBy("_n_group", "_n_part").agg(F.min("_n_at").alias("_n_first"), rows, *weights)
    starts = starts.select(
        "_n_group", "_n_part", "_n_first",
        F.coalesce(F.sum("_n_rows").over(earlier), F.lit(0)).alias("_n_offset"),
        F.sum("_n_rows").over(Window.partitionBy("_n_group")).alias("total"),
        *([] if weight is None else [F.coalesce(F.sum("_n_weights").over(earlier), F.lit(0)).alias("_n_heavier")]))

    joined = placed.join(starts, ["_n_group", "_n_part"])
    added = [(F.col("_n_at") - F.col("_n_first") + F.col("_n_offset")).alias("rank"), F.col("total")]
    if weight is not None:
        inside = Window.partitionBy("_n_group", "_n_part").orderBy("_n_at").rowsBetween(Window.unboundedPreceding, -1)
        added.append((F.col("_n_heavier") + F.coalesce(F.sum("_n_weight").over(inside), F.lit(0))).alias("before"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *added)
