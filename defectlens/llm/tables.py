"""Reading the driver's tables, and tables kept in the cluster's shared folder."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from defectlens.session import materialise


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def fold(modulus: int):
    """The fold of a document: crc32 of its id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def join_apart(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """An equality join with exchanges of its own, which adaptive execution can split at hot keys.

    A plain join after a grouping by ``key`` would take over the grouping's exchange, which it
    cannot; a second key that follows from the first keeps them apart.
    """
    again = F.xxhash64(key)
    return left.withColumn("_again", again).join(right.withColumn("_again", again), [key, "_again"], how).drop("_again")


def ship(*module_names: str) -> None:
    """Send these modules' functions by value, so that executors need not have the package."""
    for name in module_names:
        cloudpickle.register_pickle_by_value(sys.modules[name])


_STATE = "_llm_worker_state"


def worker_state(kind: str, key: str, build: Callable[[], object]) -> object:
    """What ``build`` makes, once in a worker process; only the last one is kept, whatever its kind.

    Modules shipped by value have globals anew in every task, so this lives in a module of the
    process itself, which Python workers keep from task to task. A step without a state of its own
    calls :func:`drop_worker_state`, as it may run in workers that still hold an earlier step's.
    """
    state = sys.modules.setdefault(_STATE, types.ModuleType(_STATE)).__dict__
    if state.get("last", (None,))[0] != (kind, key):
        drop_worker_state()
        state["last"] = (kind, key), build()
    return state["last"][1]


def drop_worker_state() -> None:
    """Free what this worker process has kept for an earlier step, and hand the pages back."""
    if _STATE in sys.modules and sys.modules[_STATE].__dict__.pop("last", None) is not None:
        gc.collect()
        pa.default_memory_pool().release_unused()


__all__ = [
    "benchmark", "conversations", "documents", "drop_worker_state", "fold", "join_apart", "materialise", "ship", "worker_state",
]

ship(__name__)
