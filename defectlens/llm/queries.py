"""Registered queries of the pipeline operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontamination, langid, linededup, lm, merkle, neardup, pii, quality, sharding, simhash, substrings, trie
from .oracles import LINES_SQL, MANIFEST_SQL, PASSAGES_SQL, QUALITY_SQL, SHARDS_SQL, TRIE_SQL
from .tables import benchmark, conversations, documents, fold, materialise

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

SHARD_BYTES = 1 << 20
VOCABULARY = "byte_bpe_50k.json"


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _queries[name] = fn
        if sql:
            _oracles[name] = sql
        return fn

    return add


def registered() -> dict[str, Query]:
    return dict(_queries)


def oracles() -> dict[str, str]:
    return dict(_oracles)


@_query("op1_bpe_codes")
def bpe_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


@_query("op2_benchmark_leaks")
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(documents(spark, sf_dir), benchmark(spark, sf_dir))


@_query("op3_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


@_query("op4_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(documents(spark, sf_dir))
    base = F.concat(*[pii.digest(F.col(f"{k}s"), k) for k in pii.BASE])
    every = F.concat(*[pii.digest(F.col(f"{k}s"), k) for k in pii.PATTERNS])
    return found.select(
        "doc_id", *[F.size(f"{k}s").cast("long").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"))


@_query("op5_repeated_passages", PASSAGES_SQL)
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.when(F.col("kept_text") == "", 0).otherwise(
        F.length("kept_text") - F.length(F.translate("kept_text", " ", "")) + 1)
    return substrings.dedup_passages(documents(spark, sf_dir)).select(
        "doc_id", "n_words", (F.col("n_words") - left).alias("n_removed"),
        F.sha2("kept_text", 256).alias("kept_sha256"))


@_query("op6_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    references = langid.learn(docs.where(fold(4) != 2))
    return langid.identify(docs, references).select(
        "doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


@_query("op7_quality_rules", QUALITY_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", *[F.col(f"max_{r}").cast("long").alias(f"max_{r}") for r in quality.SLACK])


@_query("op8_lm_scores")
def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = lm.score_documents(docs.select("doc_id", "text", (fold(5) != 1).alias("learn")))
    return scored.select(
        "doc_id", F.coalesce(fold(5) == 1, F.lit(True)).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score")


@_query("op9_line_dedup", LINES_SQL)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(documents(spark, sf_dir)).select(
        "doc.doc_id", "n_lines", "n_removed", "level",
        F.sha2("kept_text", 256).alias("kept_sha256"))


@_query("op10_extendible_shards", SHARDS_SQL)
def extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(documents(spark, sf_dir), SHARD_BYTES).select(
        "doc_id", "n_bytes", "shard", F.col("depth").cast("long").alias("depth"), "shard_bytes", "fits")


@_query("op11_merkle_manifest", MANIFEST_SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tampered = F.when(fold(7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows = docs.select("doc_id", "lang", *[
        merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang")], n, F.col("text")).alias(name)
        for name, n in (("digest", F.col("n_chars")), ("shown", tampered))])
    proven = merkle.prove(rows, "lang", "doc_id", "digest", ["doc_id", "shown"])
    return proven.withColumn("folded_root", merkle.folded(F.col("shown"), F.col("proof"))).select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@_query("op12_conversation_trie", TRIE_SQL)
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = materialise(trie.encode_turns(conversations(spark, sf_dir)))
    own = F.col("conv_id")
    taken = F.crc32(own.cast("string").cast("binary")) % 4
    return trie.prefix_trie(trie.with_shared_head(encoded, own - own % 20, taken, most=3))


@_query("op13_simhash_groups")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(documents(spark, sf_dir))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
