"""The cleaning pipeline over ``documents``: each stage's table is the next one's input.

Stages, in order, each with the operator it calls and what it does to the documents:

- language id: a document without a letter, or whose best language needs more than ``MAX_BITS`` bits
  per symbol, goes; the others stay as they are.
- line dedup: repeated line runs are cut out of the texts; every document stays.
- near-duplicates: of each group the document of smallest id stays. A document without id takes no
  part and stays.
- decontamination: documents that hold a passage of a test item go.
  Here and in language id a row is judged by its own text, whether its id is null or repeated.
- byte-pair codes: doc_id, the token ids and their number, and the digest of the decoded text.

All but the last return the columns they got. An empty table passes through all of them. A stage's
result has been written when the next stage begins, which then deletes the helper tables behind it.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from defectlens.llm import bpe, decontamination, langid, linededup, neardup
from defectlens.llm.tables import benchmark, documents
from defectlens.session import materialise, release, scratch_folder, written_tables

#: Phrases of less than two symbols, for references of some 14 bits: no learned language.
MAX_BITS = 8.0
VOCABULARY = "byte_bpe_50k.json"


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_spent: list[str] = []


def _stage(function: Stage) -> Stage:
    """Delete the helper tables of the stage before, and remember those of this one."""
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _spent)
        before = set(written_tables())
        result = function(spark, docs, sf_dir)
        _spent[:] = [path for path in written_tables() if path not in before]
        return result

    return run_stage


def _row_key(docs: DataFrame) -> Column:
    """Names a row by its id and text, either of which may be null."""
    return F.xxhash64(docs["doc_id"], docs["doc_id"].isNull(), docs["text"], docs["text"].isNull())


def _keyed(docs: DataFrame) -> DataFrame:
    """The texts, with the name of the row in place of its id."""
    return docs.select(_row_key(docs).alias("doc_id"), "text")


def _without(docs: DataFrame, ids: DataFrame, key: Column | None = None) -> DataFrame:
    """The documents whose key, the id by default, is not among ``ids``, in the columns they have."""
    mark = f"gone_{uuid.uuid4().hex}"
    gone = ids.select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(gone, (docs["doc_id"] if key is None else key) == gone[mark], "left_anti")


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(_keyed(docs), langid.learn(docs))
    rejected = materialise(found.where((F.col("lang_pred") == langid.UNKNOWN) | (F.col("bits") > MAX_BITS)))
    return _without(docs, rejected, _row_key(docs))


@_stage
def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    result = linededup.dedup_lines(docs)
    return result.select([
        F.col("kept_text").alias(c) if c == "text"
        else F.length("kept_text").cast("long").alias(c) if c == "n_chars"
        else F.col(f"doc.`{c}`").alias(c) for c in docs.columns
    ])


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = materialise(neardup.near_duplicates(docs))
    return _without(docs, groups.where(~F.col("kept")))


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = materialise(decontamination.find_leaks(_keyed(docs), benchmark(spark, sf_dir)).select("doc_id"))
    return _without(docs, leaks, _row_key(docs))


@_stage
def bpe_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Stage]] = [
    ("language id", language_id),
    ("line dedup", repeated_lines),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("byte-pair codes", bpe_codes),
]

#: Cross-parsing, alignment and byte-pair codes are not SQL; a brute-force version stands in the tests.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    folder = f"{scratch_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        result = stage(spark, docs, sf_dir)
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
