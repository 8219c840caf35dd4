"""Scans, projections, joins, set operators and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import (
    identifier_count, is_very_short, length_ratio, line_count, marker_hits, nonblank_lines,
    normalise_name, parse_libs,
)
from ..operators import matching, relational
from ..session import scratch_folder
from ..sources import writers
from ..sources.readers import RawSamples, prepare_samples
from .registry import query
from .views import CODE_SAMPLES, TEXT_FAMILY, TEXT_SAMPLES, code_samples, table, text_families, text_samples

VISIBLE_LINES = r"len(regexp_extract_all(text, '[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}][^\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]*'))"


@query("scan_samples", f"""WITH {TEXT_SAMPLES}
SELECT sample_id, task_id, model_name, split, label, md5(solution) AS code_md5,
       length(solution) AS code_chars, '' AS prompt
FROM text_samples""")
def scan_samples(spark, sf_dir):
    raw = text_samples(spark, sf_dir).withColumn("instruct_prompt", F.lit(""))
    return prepare_samples(raw).select(
        "sample_id", "task_id", "model_name", "split", "label",
        F.md5("generated_code").alias("code_md5"),
        F.length("generated_code").cast("long").alias("code_chars"), "prompt",
    )


@query("null_defaults", """
SELECT d.doc_id AS sample_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, -1) AS toxic,
       coalesce(CASE WHEN d.lang <> 'en' THEN d.lang END, '') AS other_lang
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def null_defaults(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("sample_id"), "quality", "toxic",
        F.when(F.col("lang") != "en", F.col("lang")).alias("other_lang"),
    )
    return relational.with_defaults(joined, {"quality": 0, "toxic": -1, "other_lang": "", "absent": 0})


FAMILY_ZERO = f"(SELECT DISTINCT model_name FROM text_samples WHERE {TEXT_FAMILY} = 'family0')"


@query("family_semi", f"""WITH {TEXT_SAMPLES}
SELECT sample_id, model_name, label FROM text_samples WHERE model_name IN {FAMILY_ZERO}""")
def family_semi(spark, sf_dir):
    samples = text_samples(spark, sf_dir).select("sample_id", "model_name", "label")
    members = text_families(samples).where(F.col("family") == "family0")
    return relational.keep_members(samples, members, "model_name").select("sample_id", "model_name", "label")


@query("family_anti", f"""WITH {TEXT_SAMPLES}
SELECT sample_id, model_name, label FROM text_samples WHERE model_name NOT IN {FAMILY_ZERO}""")
def family_anti(spark, sf_dir):
    samples = text_samples(spark, sf_dir).select("sample_id", "model_name", "label")
    members = text_families(samples).where(F.col("family") == "family0")
    return relational.drop_members(samples, members, "model_name").select("sample_id", "model_name", "label")


@query("sample_n", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100""")
def sample_n(spark, sf_dir):
    return relational.sample_n(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 100, "o_orderkey")


@query("max_normalise", """
SELECT l_orderkey, l_linenumber, l_extendedprice,
       round(l_extendedprice / (SELECT max(l_extendedprice) FROM lineitem), 6) AS score
FROM lineitem""")
def max_normalise(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return relational.max_normalise(lines, "l_extendedprice", "score").withColumn("score", F.round("score", 6))


@query("enrich_left_join", """
SELECT c.conv_id AS sample_id, 'task' || (c.conv_id % 60) AS task_id, length(c.text) AS code_chars,
       coalesce(length(b.text), -1) AS prompt_chars, md5(b.text) AS prompt_md5
FROM conversations c LEFT JOIN benchmark b ON c.conv_id % 60 = b.item_id""")
def enrich_left_join(spark, sf_dir):
    tasks = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("task"), F.col("item_id").cast("string")).alias("task_id"),
        F.col("text").alias("instruct_prompt"),
    )
    samples = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("sample_id"),
        F.concat(F.lit("task"), (F.col("conv_id") % 60).cast("string")).alias("task_id"),
        F.col("text").alias("solution"),
    )
    return matching.enrich(samples, tasks).select(
        "sample_id", "task_id", F.length("solution").cast("long").alias("code_chars"),
        F.coalesce(F.length("instruct_prompt"), F.lit(-1)).cast("long").alias("prompt_chars"),
        F.md5("instruct_prompt").alias("prompt_md5"),
    )


# Brands as model names: files carry an organisation prefix and a suffix, results do not.
ALIASES = {
    "org--Brand-1-hf": "Brand_1",
    "org--Brand-2-hf": "Brand_unknown",
    "org--Brand-3-hf": "Brand_4",
}
MATCH_SQL = """sampled AS (
  SELECT CASE WHEN p_partkey % 2 = 0 THEN 'complete' ELSE 'instruct' END AS split,
         'org--' || replace(p_brand, '#', '-') || '-hf' AS sample_model,
         p_partkey // 50 AS task, CASE WHEN p_partkey % 9 <> 0 THEN p_name END AS solution
  FROM part), evaluated AS (
  SELECT CASE WHEN p_partkey % 2 = 0 THEN 'complete' ELSE 'instruct' END AS split,
         replace(p_brand, '#', '_') AS eval_model, p_partkey // 50 AS task,
         min(p_size % 2) AS status
  FROM part WHERE p_partkey % 10 <> 0 AND NOT (p_brand = 'Brand#5' AND p_partkey % 2 = 0)
  GROUP BY ALL), aliases(sample_model, alias_model) AS (
  VALUES ('org--Brand-1-hf', 'Brand_1'), ('org--Brand-2-hf', 'Brand_unknown'), ('org--Brand-3-hf', 'Brand_4')),
named AS (
  SELECT DISTINCT s.split, s.sample_model, a.alias_model,
         lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s.sample_model,
           '^.*?--', ''), '-hf$', ''), '[-_v. ]', '', 'g'), '[0-9]{8}$', '')) AS norm
  FROM sampled s LEFT JOIN aliases a ON s.sample_model = a.sample_model), evals AS (
  SELECT split, min(eval_model) AS norm_model, lower(replace(eval_model, '_', '')) AS norm
  FROM evaluated GROUP BY split, lower(replace(eval_model, '_', ''))), candidates AS (
  SELECT n.split, n.sample_model,
         CASE WHEN n.alias_model IS NOT NULL THEN n.alias_model ELSE e.norm_model END AS candidate
  FROM named n LEFT JOIN evals e ON n.split = e.split AND n.norm = e.norm), pairs AS (
  SELECT c.split, c.sample_model, v.eval_model
  FROM candidates c LEFT JOIN (SELECT DISTINCT split, eval_model FROM evaluated) v
    ON c.split = v.split AND c.candidate = v.eval_model)"""


def _split():
    return F.when(F.col("p_partkey") % 2 == 0, "complete").otherwise("instruct").alias("split")


def _task():
    return F.floor(F.col("p_partkey") / 50).alias("task_id")


def match_inputs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    samples = part.select(
        _split(),
        F.concat(F.lit("org--"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("-hf")).alias("sample_model"),
        _task(),
        F.when(F.col("p_partkey") % 9 != 0, F.col("p_name")).alias("solution"),
    )
    scored = part.where(
        (F.col("p_partkey") % 10 != 0) & ~((F.col("p_brand") == "Brand#5") & (F.col("p_partkey") % 2 == 0))
    )
    evals = scored.groupBy(
        _split(), F.replace("p_brand", F.lit("#"), F.lit("_")).alias("eval_model"), _task()
    ).agg(F.min(F.col("p_size") % 2).alias("status"))
    return samples, evals, relational.mapping_table(spark, ALIASES, "sample_model", "eval_model")


@query("match_labels", f"""WITH {MATCH_SQL}
SELECT s.task AS task_id, p.eval_model AS model_name, s.split, coalesce(s.solution, '') AS solution,
       e.status AS label
FROM sampled s JOIN pairs p ON s.split = p.split AND s.sample_model = p.sample_model
JOIN evaluated e ON e.split = s.split AND e.eval_model = p.eval_model AND e.task = s.task""")
def match_labels(spark, sf_dir):
    return matching.match_labels(*match_inputs(spark, sf_dir))


@query("match_skipped", f"""WITH {MATCH_SQL}
SELECT split, sample_model FROM pairs WHERE eval_model IS NULL""")
def match_skipped(spark, sf_dir):
    return matching.skipped_models(*match_inputs(spark, sf_dir))


@query("match_summary", f"""WITH {MATCH_SQL}
SELECT split, count(eval_model) AS matched, count(*) - count(eval_model) AS skipped
FROM pairs GROUP BY split""")
def match_summary(spark, sf_dir):
    return matching.match_summary(*match_inputs(spark, sf_dir))


@query("union_splits", f"""WITH {CODE_SAMPLES}
SELECT sample_id, split, label FROM code_samples WHERE split = 'complete'
UNION ALL
SELECT sample_id, split, label FROM code_samples WHERE split = 'instruct'""")
def union_splits(spark, sf_dir):
    samples = code_samples(spark, sf_dir).select("sample_id", "split", "label")
    parts = [samples.where(F.col("split") == s) for s in ("complete", "instruct")]
    return relational.union_all(*parts)


@query("normalise_name", """
WITH names AS (
  SELECT p_partkey, 'org' || (p_partkey % 7) || '--' || replace(p_brand, '#', '_v') || '-' || p_name
         || CASE p_partkey % 3 WHEN 0 THEN '-hf' WHEN 1 THEN '_20240229' ELSE '' END AS raw_name
  FROM part)
SELECT p_partkey, raw_name,
       lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw_name,
         '^.*?--', ''), '-hf$', ''), '[-_v. ]', '', 'g'), '[0-9]{8}$', '')) AS norm_name
FROM names""")
def normalise_names(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.concat(
        F.lit("org"), (k % 7).cast("string"), F.lit("--"), F.replace("p_brand", F.lit("#"), F.lit("_v")),
        F.lit("-"), F.col("p_name"),
        F.when(k % 3 == 0, "-hf").when(k % 3 == 1, "_20240229").otherwise(""),
    )
    named = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw_name"))
    return named.withColumn("norm_name", normalise_name(F.col("raw_name")))


@query("text_line_features", f"""
SELECT doc_id AS sample_id, length(text) AS n_chars,
       length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines,
       {VISIBLE_LINES} AS n_visible_lines,
       CASE WHEN {VISIBLE_LINES} <= 5 THEN 1 ELSE 0 END AS smell_is_very_short
FROM documents""")
def text_line_features(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"),
        F.length(text).cast("long").alias("n_chars"),
        line_count(text).cast("long").alias("n_lines"),
        nonblank_lines(text).cast("long").alias("n_visible_lines"),
        is_very_short(text).alias("smell_is_very_short"),
    )


@query("marker_hits", f"""WITH {CODE_SAMPLES}
SELECT sample_id, len(regexp_extract_all(solution || ' ' || instruct_prompt, '(?i)\\b(TODO|FIXME|HACK|XXX)\\b')) AS n_markers
FROM code_samples""")
def marker_counts(spark, sf_dir):
    both = F.concat_ws(" ", "solution", "instruct_prompt")
    return code_samples(spark, sf_dir).select("sample_id", marker_hits(both).cast("long").alias("n_markers"))


@query("identifier_counts", """
SELECT doc_id AS sample_id, len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS n_identifiers
FROM documents""")
def identifier_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"),
        identifier_count(F.col("text")).cast("long").alias("n_identifiers"),
    )


@query("parse_libs", f"""WITH {CODE_SAMPLES}
SELECT sample_id, CASE k % 5 WHEN 2 THEN 'os' WHEN 3 THEN 'pandas|requests' WHEN 4 THEN 'pandas|numpy|os' ELSE '' END AS required,
       CASE k % 5 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 0 END AS n_required
FROM code_samples""")
def parsed_libs(spark, sf_dir):
    required = parse_libs(F.col("libs"))
    return code_samples(spark, sf_dir).select(
        "sample_id", F.concat_ws("|", required).alias("required"), F.size(required).alias("n_required")
    )


@query("length_ratio", """
SELECT a.conv_id, a.turn, round(length(b.text)::DOUBLE / greatest(length(a.text), 1), 4) AS align_length_ratio
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def length_ratios(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    answers = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return turns.join(answers, ["conv_id", "turn"]).select(
        "conv_id", "turn", length_ratio(F.col("answer"), F.col("text")).alias("align_length_ratio")
    )


# Raw files spelled out from the tables, some of their lines and results broken on purpose: a program
# line cut short where 97 divides the id, a result that is no number where 89 does.
_CUT, _MISTYPED = 97, 89


def _raw_samples(spark, sf_dir):
    folder = f"{scratch_folder(spark).rstrip('/')}/raw-{uuid.uuid4().hex}"
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    named = documents.select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, "complete").otherwise("instruct").alias("split"),
        F.col("source").alias("sample_model"), F.concat(F.lit("t"), "doc_id").alias("task_id"),
        F.col("text").alias("solution"), "lang")
    line = F.to_json(F.struct("task_id", "solution"))
    cut = F.when(F.col("doc_id") % _CUT == 0, line.substr(F.lit(1), F.length(line) - 2)).otherwise(line)
    writers.write_code_files(named, f"{folder}/samples", cut)
    status = F.when(F.col("doc_id") % _MISTYPED == 0, "oops").otherwise(F.col("quality").cast("string"))
    writers.write_eval_maps(
        named.join(labels, "doc_id").select("split", F.col("sample_model").alias("eval_model"), "task_id", status.alias("status")),
        f"{folder}/evals")
    task = F.to_json(F.struct("task_id", F.col("lang").alias("complete_prompt")))
    named.select(task.alias("value")).write.text(f"{folder}/tasks")
    return RawSamples(spark, f"{folder}/tasks", f"{folder}/samples", f"{folder}/evals")


@query("stitch_raw", f"""
SELECT 't' || d.doc_id AS task_id, source AS model_name, CASE WHEN d.doc_id % 2 = 0 THEN 'complete' ELSE 'instruct' END AS split,
       md5(text) AS solution_md5, quality::INTEGER AS label, lang AS complete_prompt, '' AS instruct_prompt
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id % {_CUT} <> 0 AND d.doc_id % {_MISTYPED} <> 0""")
def stitch_raw(spark, sf_dir):
    """The sample table stitched from raw files that are written from the tables first."""
    return _raw_samples(spark, sf_dir).samples().select(
        "task_id", "model_name", "split", F.md5("solution").alias("solution_md5"), "label", "complete_prompt", "instruct_prompt")


@query("stitch_rejects", f"""
SELECT 'code' AS kind, source AS model_name, 'no program' AS reason, count(*) AS n
FROM documents WHERE doc_id % {_CUT} = 0 GROUP BY source
UNION ALL
SELECT 'eval', source, 'no whole number', count(*)
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id % {_MISTYPED} = 0 GROUP BY source""")
def stitch_rejects(spark, sf_dir):
    """What of the raw files could not be used, per kind and model."""
    counts = _raw_samples(spark, sf_dir).reject_counts()
    return counts.groupBy("kind", F.split("file", "--")[0].alias("model_name"), "reason").agg(F.sum("n").alias("n"))
