"""Table, report and model sinks."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .readers import CSV_OPTIONS, EVAL_SUFFIX, SAMPLE_MARK


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Samples, features, predictions and result tables. Splits use ``partition_by=["fold"]``,
    so that reading one fold opens that fold's files only."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.options(**CSV_OPTIONS).csv(path)
    else:
        writer.format(fmt).save(path)


def write_metrics(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Metric rows as JSON lines."""
    df.write.mode(mode).json(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_vectoriser(fitted: DataFrame, path: str) -> None:
    """A fitted vectoriser is a table of term, idx, df, idf."""
    fitted.write.mode("overwrite").parquet(path)


def load_vectoriser(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _named_files(lines: DataFrame, keys: Sequence[str], folder: str, name) -> None:
    """Write ``line`` as text, each file of one ``keys`` value under a name made from it.

    Files are written by the cluster into a folder per value and then renamed: the driver sees one
    path per file. A value of very many rows fills several files, one per task.
    """
    context = lines.sparkSession.sparkContext
    part = f"{folder.rstrip('/')}/_parts"
    lines.select(*keys, "line").write.partitionBy(*keys).text(part)
    path = context._jvm.org.apache.hadoop.fs.Path
    files = path(part).getFileSystem(context._jsc.hadoopConfiguration())
    found = files.globStatus(path("/".join([part, *["*"] * len(keys), "part-*"])))
    for number, status in enumerate(found or []):
        source = status.getPath()
        values = source.toString().split("/")[-1 - len(keys):-1]
        target = path(f"{folder.rstrip('/')}/{name(number, *[unquote(v.split('=', 1)[1]) for v in values])}")
        files.mkdirs(target.getParent())
        files.rename(source, target)
    files.delete(path(part), True)


def write_code_files(samples: DataFrame, folder: str, line: Column | None = None) -> None:
    """``<split>/<model>--bigcodebench-<split>--<n>.jsonl`` from split, sample_model, task_id and
    solution: what ``readers.read_code_files`` reads. ``line`` may spell out other lines."""
    spelled = F.to_json(F.struct("task_id", "solution")) if line is None else line
    _named_files(
        samples.withColumn("line", spelled), ["split", "sample_model"], folder,
        lambda n, split, model: f"{split}/{model}{SAMPLE_MARK}-{split}--{n}.jsonl")


def write_eval_maps(results: DataFrame, folder: str) -> None:
    """One ``<model>--<split>_eval_results.json`` map of task_id to status from split, eval_model,
    task_id and status. The format wants a model's results of one split in one object."""
    entries = F.map_from_entries(F.collect_list(F.struct("task_id", "status")))
    maps = results.groupBy("split", "eval_model").agg(F.to_json(entries).alias("line"))
    _named_files(
        maps.repartition("split", "eval_model"), ["split", "eval_model"], folder,
        lambda _, split, model: f"{model}{EVAL_SUFFIX.format(split=split)}")
