"""Scans of sample tables and of the raw files they are stitched from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.hashing import hash_text
from ..operators.matching import enrich, match_labels
from ..operators.relational import mapping_table, sample_n, union_all
from ..schema import CODE_LINES, MODEL_ALIASES, REQUIRED_SAMPLE_COLUMNS, SAMPLES, TASKS

# How raw files are named.
SAMPLE_MARK = "--bigcodebench"
EVAL_SUFFIX = "--{split}_eval_results.json"
SPLITS = ("complete", "instruct")

# Program text comes back as written: quotes, blanks at the ends, empty against missing.
CSV_OPTIONS = {
    "header": True, "quote": '"', "escape": '"', "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Parquet by default: CSV with line breaks inside texts cannot be split by file offset,
    so a CSV file is read by one task."""
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        return reader.options(**CSV_OPTIONS, multiLine=True, enforceSchema=False).csv(path)
    return reader.format(fmt).load(path)


def prepare_samples(df: DataFrame, max_rows: int | None = None, key: str | None = None) -> DataFrame:
    """Check columns, rename the program and prompt columns, cast the label, cap the rows.

    The cap is a seeded sample, the same rows on every run.
    """
    missing = sorted(set(REQUIRED_SAMPLE_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"sample table lacks columns {missing}; it has {df.columns}")
    renamed = df.withColumnsRenamed(
        {"solution": "generated_code", "instruct_prompt": "prompt"}
    ).withColumn("label", F.col("label").cast("int"))
    if not max_rows:
        return renamed
    if key:
        return sample_n(renamed, max_rows, key)
    row = hash_text(42, *[F.col(c) for c in ("task_id", "model_name", "generated_code")])
    return renamed.orderBy(row).limit(max_rows)


def read_samples(
    spark: SparkSession, path: str, fmt: str = "parquet", max_rows: int | None = None
) -> DataFrame:
    return prepare_samples(read_table(spark, path, fmt, SAMPLES if fmt == "csv" else None), max_rows)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task JSON lines; of several lines with one task_id the last in the file order wins.

    Lines are keyed by file position, and duplicates are combined by ``max_by`` before the
    shuffle, so a much-repeated task costs one row per scan task. A cut or mistyped line
    fails the read.
    """
    raw = spark.read.schema(TASKS).option("mode", "FAILFAST").json(path).select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("f"),
            F.col("_metadata.file_block_start").alias("b"),
            F.monotonically_increasing_id().alias("i"),
        ).alias("_at"),
    )
    fields = F.struct(*[F.col(c) for c in TASKS.names])
    return raw.groupBy("task_id").agg(F.max_by(fields, "_at").alias("t")).select("t.*")


def read_code_files(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """All ``<model>--bigcodebench*.jsonl`` of one split: split, sample_model, task_id, solution.

    A cut or mistyped line fails the read.
    """
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl$", "")
    return (
        spark.read.schema(CODE_LINES)
        .option("mode", "FAILFAST")
        .option("pathGlobFilter", "*.jsonl")
        .json(f"{folder}/{split}")
        .select(
            F.lit(split).alias("split"),
            F.split(F.url_decode(stem), SAMPLE_MARK)[0].alias("sample_model"),
            "task_id",
            "solution",
        )
    )


def read_eval_maps(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """All ``<model>--<split>_eval_results.json`` maps: split, eval_model, task_id, status.

    A cut file, or a status that is no whole number, fails the read.
    """
    suffix = EVAL_SUFFIX.format(split=split)
    return (
        spark.read.option("wholetext", True)
        .option("pathGlobFilter", f"*{suffix}")
        .text(folder)
        .select(
            F.lit(split).alias("split"),
            F.replace(F.url_decode(F.col("_metadata.file_name")), F.lit(suffix), F.lit("")).alias("eval_model"),
            F.explode(F.from_json("value", "map<string,int>", {"mode": "FAILFAST"})).alias("task_id", "status"),
        )
    )


def _raw_text(spark: SparkSession, path: str, glob: str, whole: bool = False) -> DataFrame:
    """file, block, place and value of each line, or file, that is not blank.

    ``place`` orders the lines of a block; a block starts ``block`` bytes into its file.
    """
    reader = spark.read.option("pathGlobFilter", glob)
    return (reader.option("wholetext", True) if whole else reader).text(path).select(
        F.url_decode(F.col("_metadata.file_name")).alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value",
    ).where(F.trim("value") != "")


def _parsed_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """``lines`` with ``row``, null where a line is cut, no object or has a field of another type."""
    noted = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("value", noted, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.withColumn("_row", parsed).withColumn("row", F.when(
        F.col("_row._corrupt").isNull(), F.struct(*[F.col(f"_row.{f}") for f in schema.names]))).drop("_row")


def _rejected(kind: str, rows: DataFrame, reason: Column) -> DataFrame:
    return rows.select(
        F.lit(kind).alias("kind"), "file", "block", "place", F.col("value").alias("raw"), reason.alias("reason"))


class RawSamples:
    """The three raw sources, read with what cannot be used kept beside what can.

    The strict readers above fail on the first broken line; here ``rejects`` has, as written, each
    line or map entry that is left out, with its kind, file and place, and the rest is read.
    """

    def __init__(self, spark: SparkSession, tasks_path: str, samples_folder: str, evals_folder: str, splits=SPLITS):
        self.spark = spark
        tasks = _parsed_lines(_raw_text(spark, tasks_path, "*"), TASKS)
        keyed = F.col("row.task_id").isNotNull()
        last = F.max_by("row", F.struct("file", "block", "place")).alias("t")
        self.tasks = tasks.where(keyed).groupBy("row.task_id").agg(last).select("t.*")
        bad = [_rejected("task", tasks.where(~F.coalesce(keyed, F.lit(False))), F.lit("no task"))]

        codes, evals = [], []
        for split in splits:
            lines = _parsed_lines(_raw_text(spark, f"{samples_folder}/{split}", "*.jsonl"), CODE_LINES)
            model = F.split(F.regexp_replace("file", r"\.jsonl$", ""), SAMPLE_MARK)[0]
            usable = F.col("row.task_id").isNotNull()
            codes.append(lines.where(usable).select(
                F.lit(split).alias("split"), model.alias("sample_model"), "row.task_id", "row.solution"))
            bad.append(_rejected("code", lines.where(~F.coalesce(usable, F.lit(False))), F.lit("no program")))

            suffix = EVAL_SUFFIX.format(split=split)
            files = _raw_text(spark, evals_folder, f"*{suffix}", whole=True) \
                .withColumn("entries", F.from_json("value", "map<string,string>"))
            bad.append(_rejected("eval", files.where("entries IS NULL"), F.lit("no map")))
            listed = files.where("entries IS NOT NULL").select("file", "block", "place", F.explode("entries").alias("task_id", "value"))
            status = F.col("value").try_cast("int")
            # A null status is an entry without a result, as the strict reader has it.
            broken = F.col("value").isNotNull() & status.isNull()
            evals.append(listed.where(~broken).select(
                F.lit(split).alias("split"), F.replace("file", F.lit(suffix), F.lit("")).alias("eval_model"), "task_id",
                status.alias("status")))
            bad.append(_rejected(
                "eval", listed.where(broken).withColumn("value", F.concat_ws(": ", "task_id", "value")), F.lit("no whole number")))
        self.codes, self.evals, self.rejects = union_all(*codes), union_all(*evals), union_all(*bad)

    def samples(self, aliases: dict[str, str] | None = None) -> DataFrame:
        """The flat sample table of what could be read."""
        names = mapping_table(self.spark, MODEL_ALIASES if aliases is None else aliases, "sample_model", "eval_model")
        return enrich(match_labels(self.codes, self.evals, names), self.tasks)

    def reject_counts(self) -> DataFrame:
        """kind, file, reason, n."""
        return self.rejects.groupBy("kind", "file", "reason").agg(F.count(F.lit(1)).alias("n"))


def collect_samples(
    spark: SparkSession, tasks_path: str, samples_folder: str, evals_folder: str,
    aliases: dict[str, str] | None = None, splits=SPLITS,
) -> DataFrame:
    """The flat sample table from the three raw sources, as one lazy plan."""
    alias_table = mapping_table(spark, MODEL_ALIASES if aliases is None else aliases, "sample_model", "eval_model")
    codes = union_all(*[read_code_files(spark, samples_folder, s) for s in splits])
    evals = union_all(*[read_eval_maps(spark, evals_folder, s) for s in splits])
    return enrich(match_labels(codes, evals, alias_table), read_tasks(spark, tasks_path))
