"""Extendible hashing into shards of bounded size (DataFrame functions only).

Rows are hashed to 60 bits. The directory starts with one bucket; a bucket whose bytes exceed
the limit splits on its next hash bit, and only such buckets split. A bucket is final once it
fits or once all its rows have one hash value, which no further bit can part: rows equal in key
and text, or one row beyond the limit. Such shards are returned with ``fits`` false, whole.

Nulls, in the key as in the text, hash as empty strings, and a null text has 0 bytes. Equal rows
share a shard. An empty table gives no rows and no shards. Other columns are carried by
:func:`assign` only if asked for, so clashing names cannot occur.

What is aggregated is bytes per hash prefix, with partial sums before the shuffle: a hot key or
source is spread by the hash, and no task sees a group of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .tables import materialise

HASH_BITS = 60
#: Bits by which the directory is refined per pass over the row sizes.
_STEP = 12


def _prefix(bits: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", F.col("hash"), F.lit(HASH_BITS) - bits)


def _hashed(key: str, text: str) -> tuple[Column, Column]:
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), content))
    return (F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"),
            F.octet_length(content).cast("long").alias("n_bytes"))


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hash, n_bytes) of each row."""
    return docs.select(F.col(key), *_hashed(key, text))


def directory(rows: DataFrame, max_bytes: int) -> DataFrame:
    """The final buckets of ``rows`` (hash, n_bytes): depth, prefix, shard_bytes, n_rows, fits.

    ``rows`` is read once for each ``_STEP`` bits of depth; put it in a table first.
    """
    final, depth, parents = None, 0, None
    while depth < HASH_BITS:
        deeper = min(depth + _STEP, HASH_BITS)
        inside = rows.withColumn("parent", _prefix(depth))
        if parents is not None:
            inside = inside.join(parents, "parent", "left_semi")
        fine = inside.groupBy(_prefix(deeper).alias("fine")).agg(
            F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n"),
            F.min("hash").alias("low"), F.max("hash").alias("high"),
        )
        levels = F.explode(F.sequence(F.lit(depth), F.lit(deeper))).alias("depth")
        buckets = (
            fine.select("*", levels)
            .groupBy("depth", F.expr(f"shiftrightunsigned(fine, {deeper} - depth)").alias("prefix"))
            .agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("n_rows"),
                 F.min("low").alias("low"), F.max("high").alias("high"))
            .withColumn("done", (F.col("shard_bytes") <= max_bytes) | (F.col("low") == F.col("high")))
        )
        buckets = materialise(buckets)
        # A bucket exists if all its ancestors had to split, that is if its parent was not done.
        open_above = buckets.where(~F.col("done")).select(
            (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        exists = buckets.where(F.col("depth") > depth).join(
            open_above, (open_above["depth"] == buckets["depth"])
            & (open_above["above"] == F.expr("shiftrightunsigned(prefix, 1)")), "left_semi")
        if depth == 0:
            exists = exists.unionByName(buckets.where("depth = 0"))
        leaves = exists.where("done").select(
            "depth", "prefix", "shard_bytes", "n_rows", (F.col("shard_bytes") <= max_bytes).alias("fits"))
        final = leaves if final is None else final.unionByName(leaves)
        still = exists.where((F.col("depth") == deeper) & ~F.col("done"))
        parents = still.select(F.col("prefix").alias("parent"))
        depth = deeper
        if still.isEmpty():
            break
    return final


def assign(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` with depth, prefix, shard_bytes, fits and ``shard``, the bits of the prefix.

    The directory has at most one bucket per ``max_bytes / 2`` bytes or so, but it grows with the
    data: whether it is broadcast is left to its measured size. Each row meets one bucket: the
    join is on the prefix at the depths that occur, at most ``HASH_BITS + 1`` numbers.
    """
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect())
    candidates = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]))) if depths \
        else rows.withColumn("depth", F.lit(0))
    bits = F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))
    return (
        candidates.withColumn("prefix", _prefix(F.col("depth")))
        .join(buckets, ["depth", "prefix"])
        .withColumn("shard", F.when(F.col("depth") == 0, F.lit("")).otherwise(bits))
    )


def extendible_shards(docs: DataFrame, max_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, shard (hash-prefix bits), depth, shard_bytes and fits for every row."""
    rows = materialise(sized(docs, key, text))
    return assign(rows, directory(rows, max_bytes)).select(
        key, "n_bytes", "shard", "depth", "shard_bytes", "fits")


def write_shards(docs: DataFrame, path: str, max_bytes: int, key: str = "doc_id", text: str = "text") -> None:
    """Write ``docs``, all columns, as one Parquet folder ``shard_name=b<bits>`` per shard."""
    rows = materialise(docs.select(*_hashed(key, text)))
    packed = docs.select(F.struct("*").alias("row"), *_hashed(key, text))
    assign(packed, materialise(directory(rows, max_bytes))) \
        .select("row.*", F.concat(F.lit("b"), "shard").alias("shard_name")) \
        .repartition("shard_name").write.partitionBy("shard_name").parquet(path)
