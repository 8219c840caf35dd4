"""Profiles, medians, correlations, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import parse_libs
from ..operators import profiling, splits
from ..operators.ordering import exact_quantiles
from .registry import query
from .views import (
    CODE_SAMPLES, SCORED_TEXTS, SEED, SPLIT_SCORED_TEXTS, TEXT_FAMILY,
    TEXT_SAMPLES, code_samples, split_scored_texts, stored_split, table,
    text_families, text_samples,
)


@query("dataset_overview", f"""WITH {TEXT_SAMPLES}
SELECT count(*) AS n_rows, count(DISTINCT model_name) AS n_models, count(DISTINCT task_id) AS n_tasks,
       round(avg(label), 6) AS pass_rate FROM text_samples""")
def dataset_overview(spark, sf_dir):
    return profiling.overview(text_samples(spark, sf_dir))


@query("split_counts", f"""WITH {TEXT_SAMPLES}
SELECT split, count(*) AS n_rows FROM text_samples GROUP BY split""")
def split_counts(spark, sf_dir):
    return profiling.counts_by(text_samples(spark, sf_dir), "split")


@query("split_pass_rate", f"""WITH {TEXT_SAMPLES}
SELECT split, count(*) AS n_rows, round(avg(label), 6) AS pass_rate FROM text_samples GROUP BY split""")
def split_pass_rate(spark, sf_dir):
    return profiling.pass_rate_by(text_samples(spark, sf_dir), "split")


@query("model_leaderboard", f"""WITH {TEXT_SAMPLES}, rates AS (
  SELECT model_name, count(*) AS n_rows, round(avg(label), 6) AS pass_rate FROM text_samples GROUP BY model_name)
(SELECT *, 'top' AS place FROM rates ORDER BY pass_rate DESC, model_name LIMIT 10)
UNION ALL
(SELECT *, 'bottom' AS place FROM rates ORDER BY pass_rate, model_name LIMIT 10)""")
def model_leaderboard(spark, sf_dir):
    return profiling.leaderboard(text_samples(spark, sf_dir))


@query("group_median", """
SELECT o_orderpriority, round(median(o_totalprice), 6) AS median FROM orders GROUP BY o_orderpriority""")
def group_median(spark, sf_dir):
    medians = profiling.group_median(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])
    return medians.withColumn("median", F.round("median", 6))


@query("null_profile", """
WITH wide AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
              FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'doc_id' AS column_name, 'bigint' AS column_type, count(*) - count(doc_id) AS n_null FROM wide
UNION ALL SELECT 'lang', 'string', count(*) - count(lang) FROM wide
UNION ALL SELECT 'source', 'string', count(*) - count(source) FROM wide
UNION ALL SELECT 'n_chars', 'bigint', count(*) - count(n_chars) FROM wide
UNION ALL SELECT 'quality', 'int', count(*) - count(quality) FROM wide
UNION ALL SELECT 'toxic', 'int', count(*) - count(toxic) FROM wide""")
def null_profile(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    wide = documents.drop("text").join(labels, "doc_id", "left")
    return profiling.null_profile(
        wide.select("doc_id", "lang", "source", "n_chars", F.col("quality").cast("int"), F.col("toxic").cast("int"))
    )


def _measure_sql(column):
    return f"""SELECT '{column}' AS measure, count({column}) AS n, round(avg({column}), 6) AS mean,
       round(stddev_samp({column}), 6) AS std, min({column})::DOUBLE AS min, max({column})::DOUBLE AS max,
       round(quantile_cont({column}, 0.25), 6) AS q25, round(quantile_cont({column}, 0.5), 6) AS q50,
       round(quantile_cont({column}, 0.75), 6) AS q75 FROM measured"""


@query("length_profile", f"""
WITH measured AS (SELECT length(text) AS n_text_chars,
                         length(text) - length(replace(text, chr(10), '')) + 1 AS n_text_lines FROM documents)
{_measure_sql('n_text_chars')} UNION ALL {_measure_sql('n_text_lines')}""")
def length_profile(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("text")
    measured = profiling.text_measures(documents, "text").select("n_text_chars", "n_text_lines")
    return profiling.five_numbers(measured, ["n_text_chars", "n_text_lines"])


@query("loc_percentiles", """
WITH p AS (SELECT unnest(range(10, 91, 5)) AS percent),
q AS (SELECT list_sort(list(l_extendedprice)) AS v FROM lineitem)
SELECT percent::INTEGER AS percent, round((SELECT quantile_cont(l_extendedprice, [0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40,
  0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90]) FROM lineitem)[(percent - 10) // 5 + 1], 6) AS cutoff
FROM p""")
def loc_percentiles(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    probs = [p / 100 for p in range(10, 91, 5)]
    return exact_quantiles(lines, "l_extendedprice", probs).select(
        F.round(F.col("prob") * 100).cast("int").alias("percent"), F.round("quantile", 6).alias("cutoff")
    )


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]


@query("feature_correlation", f"""
WITH t AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)
{' UNION ALL '.join(f"SELECT '{c}' AS feature, round(corr({c}, label), 6) AS correlation FROM t" for c in _NUMERIC)}""")
def feature_correlation(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    return profiling.correlations(lines, _NUMERIC, "label")


@query("class_balance", """
SELECT count(*) FILTER (quality = 0) AS n_fail, count(*) FILTER (quality = 1) AS n_pass,
       round(count(*) FILTER (quality = 0) / count(*) FILTER (quality = 1)::DOUBLE, 6) AS fail_per_pass
FROM labels""")
def class_balance(spark, sf_dir):
    return profiling.class_balance(table(spark, sf_dir, "labels"), "quality")


@query("pass_fail_gap", f"""WITH {SCORED_TEXTS}
SELECT round(avg(n_text_chars) FILTER (label = 1) - avg(n_text_chars) FILTER (label = 0), 6) AS char_gap,
       round(avg(n_text_lines) FILTER (label = 1) - avg(n_text_lines) FILTER (label = 0), 6) AS line_gap
FROM scored_texts""")
def pass_fail_gap(spark, sf_dir):
    return profiling.pass_fail_gap(text_samples(spark, sf_dir), "solution")


@query("task_difficulty", f"""WITH {CODE_SAMPLES}, rates AS (
  SELECT sample_id // 6 AS task, avg(label) AS rate FROM code_samples GROUP BY 1)
SELECT count(*) AS n_tasks, count(*) FILTER (rate = 0) AS n_unsolved,
       count(*) FILTER (rate BETWEEN 0.1 AND 0.9) AS n_contested,
       round(count(*) FILTER (rate BETWEEN 0.1 AND 0.9)::DOUBLE / count(*), 6) AS contested_share
FROM rates""")
def task_difficulty(spark, sf_dir):
    samples = code_samples(spark, sf_dir).select(F.floor(F.col("sample_id") / 6).alias("task_id"), "label")
    return profiling.task_difficulty(samples)


@query("failure_overlap", """
WITH tries AS (SELECT p_brand AS model_name, p_type AS task_id,
    CASE WHEN p_size < 2 + p_partkey % 4 THEN 1 ELSE 0 END AS label FROM part),
rates AS (SELECT model_name, round(avg(label), 6) AS rate FROM tries GROUP BY 1),
best AS (SELECT model_name FROM rates ORDER BY rate DESC, model_name LIMIT 5),
worst AS (SELECT model_name FROM rates ORDER BY rate, model_name LIMIT 5),
solved AS (SELECT task_id, model_name, max(label) AS s FROM tries GROUP BY ALL),
f AS (SELECT task_id FROM solved JOIN best USING (model_name) GROUP BY task_id HAVING sum(s) = 0 AND count(*) = 5),
g AS (SELECT task_id FROM solved JOIN worst USING (model_name) GROUP BY task_id HAVING sum(s) = 0 AND count(*) = 5)
SELECT count(*) AS n_failed_by_best, count(g.task_id) AS n_shared,
       round(count(g.task_id)::DOUBLE / nullif(count(*), 0), 6) AS overlap
FROM f LEFT JOIN g ON f.task_id = g.task_id""")
def failure_overlap(spark, sf_dir):
    tries = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("model_name"), F.col("p_type").alias("task_id"),
        (F.col("p_size") < 2 + F.col("p_partkey") % 4).cast("int").alias("label"),
    )
    return profiling.failure_overlap(tries)


@query("library_pass_rate", f"""WITH {CODE_SAMPLES}, used AS (
  SELECT unnest(CASE k % 5 WHEN 2 THEN ['os'] WHEN 3 THEN ['pandas', 'requests']
                WHEN 4 THEN ['pandas', 'numpy', 'os'] ELSE [] END) AS library, label FROM code_samples)
SELECT library, count(*) AS n_rows, round(avg(label), 6) AS pass_rate FROM used GROUP BY library""")
def library_pass_rate(spark, sf_dir):
    samples = code_samples(spark, sf_dir).select(parse_libs(F.col("libs")).alias("libs"), "label")
    return profiling.library_pass_rate(samples)


# ---------------------------------------------------------------- splits and folds

@query("group_split", f"""WITH {SPLIT_SCORED_TEXTS}
SELECT sample_id, task_id, fold FROM split_scored_texts""")
def group_split(spark, sf_dir):
    return split_scored_texts(spark, sf_dir).select("sample_id", "task_id", "fold")


@query("split_summary", f"""WITH {SPLIT_SCORED_TEXTS}
SELECT fold, count(*) AS n_rows, count(DISTINCT task_id) AS n_tasks, round(avg(label), 6) AS pass_rate
FROM split_scored_texts GROUP BY fold""")
def split_summary(spark, sf_dir):
    return splits.split_summary(split_scored_texts(spark, sf_dir))


@query("split_overlap", f"""WITH {SPLIT_SCORED_TEXTS}, t AS (SELECT DISTINCT fold, task_id FROM split_scored_texts)
SELECT a.pair, count(b.task_id) AS n_shared
FROM (VALUES ('train-val', 'train', 'val'), ('train-test', 'train', 'test'), ('val-test', 'val', 'test')) a(pair, x, y)
LEFT JOIN (SELECT p.fold AS x, q.fold AS y, p.task_id FROM t p JOIN t q ON p.task_id = q.task_id) b
  ON a.x = b.x AND a.y = b.y
GROUP BY a.pair""")
def split_overlap(spark, sf_dir):
    return splits.split_overlap(stored_split(spark, sf_dir))


@query("stratified_group_folds", f"""WITH {CODE_SAMPLES}, rates AS (
  SELECT task_id, least(floor(avg(label) * 10), 9) AS stratum FROM code_samples GROUP BY task_id)
SELECT task_id, ((row_number() OVER (ORDER BY stratum, md5('{SEED}:' || task_id), task_id) - 1) % 5)::INTEGER AS "foldCol"
FROM rates""")
def stratified_group_folds(spark, sf_dir):
    return splits.stratified_group_folds(code_samples(spark, sf_dir).select("task_id", "label"))


@query("lofo_sizes", f"""WITH {SPLIT_SCORED_TEXTS}, fam AS (SELECT *, {TEXT_FAMILY} AS family FROM split_scored_texts)
SELECT f.family, count(*) FILTER (s.fold = 'train' AND s.family <> f.family) AS n_train,
       count(*) FILTER (s.fold = 'val' AND s.family <> f.family) AS n_val,
       count(*) FILTER (s.fold = 'test' AND s.family = f.family) AS n_test
FROM (SELECT DISTINCT family FROM fam WHERE fold = 'test') f, fam s GROUP BY f.family""")
def lofo_sizes(spark, sf_dir):
    samples = split_scored_texts(spark, sf_dir).select("model_name", "fold")
    return splits.holdout_sizes(samples, text_families(text_samples(spark, sf_dir)))
