"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def build_session(app: str = "defectlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Nothing here pins a partition count: adaptive execution coalesces and splits
    shuffle partitions from their measured sizes.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Source texts vary from bytes to megabytes: bound Arrow batches by bytes too.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is set only on a single-machine session that has none.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="defectlens-"))
        folder = context.getCheckpointDir()
    return folder


_written: list[str] = []


def materialise(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Cut lineage: write the frame once as a table in the shared folder and read it back.

    Unlike a cached frame it outlives its executors, and later reads prune columns and
    push filters down. ``schema`` may read a column as a user type stored the same way.
    """
    path = f"{scratch_folder(df.sparkSession).rstrip('/')}/defectlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema if schema is None else schema).parquet(path)


def written_tables() -> list[str]:
    """The folders that :func:`materialise` has written and :func:`release` has not deleted."""
    return list(_written)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete these tables, or all, that this process has written by :func:`materialise`.

    Call it when no frame that was read from one is needed any more.
    """
    context = spark.sparkContext
    for name in list(_written) if paths is None else [p for p in paths if p in _written]:
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        _written.remove(name)


def release_read(df: DataFrame) -> None:
    """Delete those tables written by :func:`materialise` that this frame, no more needed, reads."""
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    release(df.sparkSession, [p for p in _written if any(folder.endswith(p.split(":", 1)[-1]) for folder in folders)])


@contextmanager
def released(spark: SparkSession):
    """Delete at the end what :func:`materialise` writes inside, which nothing may read any more.

    For work whose result leaves as a value; not beside other threads that write tables."""
    before = set(_written)
    try:
        yield
    finally:
        release(spark, [p for p in _written if p not in before])


#: Rows of a partition of a fit, by default.
FIT_ROWS = 1 << 16


def placed(df: DataFrame, ident: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Rows dealt out by their id and sorted by it, for work whose result depends on place.

    Learners that draw rows draw per partition: with this the draw depends on the ids and on
    ``fit_rows``, about which a partition holds, not on how many files, cores or shuffle
    partitions there are.
    """
    n = max(1, -(-df.count() // fit_rows))
    return df.repartition(n, F.col(ident)).sortWithinPartitions(ident)
