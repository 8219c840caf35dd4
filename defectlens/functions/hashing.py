"""Seeded, engine-independent hashing: the same draw on any cluster or SQL engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNIFORM_RANGE = float(1 << 60)


def hash_text(seed, *cols: Column) -> Column:
    """md5 hex digest of ``seed:col:col``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_long(seed, *cols: Column) -> Column:
    """Non-negative 60-bit integer taken from the digest."""
    return F.conv(F.substring(hash_text(seed, *cols), 1, 15), 16, 10).cast("long")


def hash_uniform(seed, *cols: Column) -> Column:
    """Uniform double in [0, 1)."""
    return hash_long(seed, *cols) / F.lit(UNIFORM_RANGE)
