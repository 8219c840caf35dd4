"""The driver tables seen as sample tables, in Spark and in SQL.

``documents`` joined to ``labels`` plays the labelled text table. The tables hold no
Python, so a table of programs is derived from ``part``: each row spells out one program
from its key, and SQL can tell in closed form what a parser must find in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import hash_uniform
from ..functions.text import line_count
from ..operators.splits import group_split
from ..session import materialise

SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- labelled texts

def text_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id").select(
        F.col("doc_id").alias("sample_id"),
        F.concat(F.lit("task"), (F.col("doc_id") % 40).cast("string")).alias("task_id"),
        F.col("source").alias("model_name"),
        F.col("lang").alias("split"),
        F.col("text").alias("solution"),
        F.col("quality").alias("label"),
    )


TEXT_SAMPLES = """text_samples AS (
  SELECT d.doc_id AS sample_id, 'task' || (d.doc_id % 40) AS task_id, d.source AS model_name,
         d.lang AS split, d.text AS solution, l.quality AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def scored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts with a given score and the length features behind it."""
    return text_samples(spark, sf_dir).withColumns({
        "n_text_chars": F.length("solution").cast("long"),
        "n_text_lines": line_count(F.col("solution")).cast("long"),
    }).drop("solution").withColumn("score", _given_score())


def _given_score() -> Column:
    logit = (F.col("n_text_chars") - 1500) / 1200 + (F.col("n_text_lines") % 7) * 0.1
    return F.round(1 / (1 + F.exp(-logit)), 6)


SCORED_TEXTS = TEXT_SAMPLES + """, measured AS (
  SELECT sample_id, task_id, model_name, split, label, length(solution) AS n_text_chars,
         length(solution) - length(replace(solution, chr(10), '')) + 1 AS n_text_lines
  FROM text_samples), scored_texts AS (
  SELECT *, round(1 / (1 + exp(-((n_text_chars - 1500)::DOUBLE / 1200
                                 + (n_text_lines % 7)::DOUBLE * 0.1::DOUBLE))), 6) AS score
  FROM measured)"""


def folds_sql(samples: str) -> str:
    """Tasks of a sample relation dealt out to train, val and test."""
    return f"""ranked AS (
  SELECT task_id, row_number() OVER (ORDER BY md5('{SEED}:' || task_id), task_id) - 1 AS r,
         count(*) OVER () AS n
  FROM (SELECT DISTINCT task_id FROM {samples})), folds AS (
  SELECT task_id,
         CASE WHEN r < floor(n * 0.7::DOUBLE) THEN 'train'
              WHEN r < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val'
              ELSE 'test' END AS fold
  FROM ranked), split_{samples} AS (
  SELECT s.*, f.fold FROM {samples} s JOIN folds f ON s.task_id = f.task_id)"""


def split_scored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_split(scored_texts(spark, sf_dir), seed=SEED)


def stored_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split as a written table, for queries that read several of its folds: the
    texts are scanned once, and reading a fold touches narrow columns only."""
    return materialise(split_scored_texts(spark, sf_dir))


SPLIT_SCORED_TEXTS = SCORED_TEXTS + ", " + folds_sql("scored_texts")

TEXT_FAMILY = "'family' || (substr(model_name, 4)::INTEGER % 4)"


def text_families(samples: DataFrame) -> DataFrame:
    """Sources in four families by their number."""
    number = F.substring("model_name", 4, 10).cast("int")
    return samples.select("model_name").distinct().select(
        F.concat(F.lit("family"), (number % 4).cast("string")).alias("family"), "model_name"
    )


# ---------------------------------------------------------------- programs from part

def _if(condition: Column, text: str | Column) -> Column:
    return F.when(condition, text if isinstance(text, Column) else F.lit(text)).otherwise(F.lit(""))


def _program(k: Column) -> Column:
    def times(text: str, n: Column) -> Column:
        return F.repeat(F.lit(text), n.cast("int"))

    tries = F.floor(k / 5) % 3
    return F.concat(
        _if(k % 2 == 1, "import os\n"),
        _if(F.floor(k / 2) % 2 == 1, "import pandas as pd\n"),
        _if(F.floor(k / 4) % 2 == 1, "from requests.api import get\n"),
        F.lit("\ndef task_func(x):\n"),
        _if(k % 6 == 0, F.concat(F.lit('    """'), F.col("p_name"), F.lit('"""\n'))),
        times("    if x > 0:\n        x = x + 1\n", k % 4),
        times("    for i in range(3):\n        x = x + i\n", k % 3),
        times("    while x > 100:\n        x = x - 1\n", k % 2),
        times("    try:\n        x = int(x)\n    except ValueError:\n        x = 0\n", tries),
        _if(k % 10 == 0, "    for a in [x]:\n        if a and x:\n            while a > 1:\n                a = a - 1\n"),
        _if(k % 11 == 0, "    # TODO: revisit\n"),
        _if(k % 7 == 0, "    pass\n"),
        F.lit("    return x\n"),
        _if(k % 13 == 0, "\ndef constant():\n    return 1\n"),
        _if(k % 19 == 0, "\ndef later():\n    raise NotImplementedError('x')\n"),
        _if(k % 23 == 0, "\nclass Holder:\n    def get(self):\n        ...\n"),
        _if(k % 17 == 0, "def broken(:\n"),
    )


def code_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pass_rate = 0.75 - (k % 4) * 0.10 - (F.floor(k / 5) % 3) * 0.12 - F.when(k % 17 == 0, 0.15).otherwise(0.0)
    libs = (
        F.when(k % 5 == 0, "[]").when(k % 5 == 1, "oops").when(k % 5 == 2, "['os']")
        .when(k % 5 == 3, "['pandas', 'requests']").otherwise("['pandas', 'numpy', 'os']")
    )
    # The keys of few files are dealt out before programs are spelled out from them.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf_dir, "part").repartition(n, "p_partkey").select(
        k.alias("sample_id"),
        F.concat(F.lit("task"), F.floor(k / 25).cast("string")).alias("task_id"),
        F.col("p_brand").alias("model_name"),
        F.when(k % 2 == 0, "complete").otherwise("instruct").alias("split"),
        _program(k).alias("solution"),
        (hash_uniform("label", k) < pass_rate).cast("int").alias("label"),
        F.concat(F.lit("Write task_func for a "), F.col("p_name"), F.lit(" of type "), F.col("p_type")).alias("instruct_prompt"),
        libs.alias("libs"),
        F.lit("task_func").alias("entry_point"),
    )


CODE_SAMPLES = """code_samples AS (
  SELECT p_partkey AS k, p_partkey AS sample_id, 'task' || (p_partkey // 25) AS task_id,
         p_brand AS model_name,
         CASE WHEN p_partkey % 2 = 0 THEN 'complete' ELSE 'instruct' END AS split,
         CASE WHEN p_partkey % 2 = 1 THEN 'import os' || chr(10) ELSE '' END
         || CASE WHEN p_partkey // 2 % 2 = 1 THEN 'import pandas as pd' || chr(10) ELSE '' END
         || CASE WHEN p_partkey // 4 % 2 = 1 THEN 'from requests.api import get' || chr(10) ELSE '' END
         || chr(10) || 'def task_func(x):' || chr(10)
         || CASE WHEN p_partkey % 6 = 0 THEN '    \"\"\"' || p_name || '\"\"\"' || chr(10) ELSE '' END
         || repeat('    if x > 0:' || chr(10) || '        x = x + 1' || chr(10), (p_partkey % 4)::INTEGER)
         || repeat('    for i in range(3):' || chr(10) || '        x = x + i' || chr(10), (p_partkey % 3)::INTEGER)
         || repeat('    while x > 100:' || chr(10) || '        x = x - 1' || chr(10), (p_partkey % 2)::INTEGER)
         || repeat('    try:' || chr(10) || '        x = int(x)' || chr(10) || '    except ValueError:' || chr(10)
                   || '        x = 0' || chr(10), (p_partkey // 5 % 3)::INTEGER)
         || CASE WHEN p_partkey % 10 = 0 THEN '    for a in [x]:' || chr(10) || '        if a and x:' || chr(10)
                 || '            while a > 1:' || chr(10) || '                a = a - 1' || chr(10) ELSE '' END
         || CASE WHEN p_partkey % 11 = 0 THEN '    # TODO: revisit' || chr(10) ELSE '' END
         || CASE WHEN p_partkey % 7 = 0 THEN '    pass' || chr(10) ELSE '' END
         || '    return x' || chr(10)
         || CASE WHEN p_partkey % 13 = 0 THEN chr(10) || 'def constant():' || chr(10) || '    return 1' || chr(10) ELSE '' END
         || CASE WHEN p_partkey % 19 = 0 THEN chr(10) || 'def later():' || chr(10)
                 || '    raise NotImplementedError(''x'')' || chr(10) ELSE '' END
         || CASE WHEN p_partkey % 23 = 0 THEN chr(10) || 'class Holder:' || chr(10) || '    def get(self):' || chr(10)
                 || '        ...' || chr(10) ELSE '' END
         || CASE WHEN p_partkey % 17 = 0 THEN 'def broken(:' || chr(10) ELSE '' END AS solution,
         CASE WHEN ('0x' || substr(md5('label:' || p_partkey), 1, 15))::BIGINT / 1152921504606846976::DOUBLE
                   < 0.75::DOUBLE - (p_partkey % 4) * 0.10::DOUBLE - (p_partkey // 5 % 3) * 0.12::DOUBLE
                     - CASE WHEN p_partkey % 17 = 0 THEN 0.15::DOUBLE ELSE 0::DOUBLE END
              THEN 1 ELSE 0 END AS label,
         'Write task_func for a ' || p_name || ' of type ' || p_type AS instruct_prompt,
         CASE p_partkey % 5 WHEN 0 THEN '[]' WHEN 1 THEN 'oops' WHEN 2 THEN '[''os'']'
              WHEN 3 THEN '[''pandas'', ''requests'']' ELSE '[''pandas'', ''numpy'', ''os'']' END AS libs
  FROM part)"""

# What a parser must find, from the key alone. ok = 1 where the program parses.
CODE_FEATURES = CODE_SAMPLES + """, bits AS (
  SELECT *, (k % 17 <> 0)::INTEGER AS ok, (k % 10 = 0)::INTEGER AS deep, (k // 5 % 3)::INTEGER AS tries,
         (k % 6 = 0)::INTEGER AS doc, (k % 11 = 0)::INTEGER AS todo, (k % 7 = 0)::INTEGER AS skip,
         (k % 13 = 0)::INTEGER AS const, (k % 19 = 0)::INTEGER AS later, (k % 23 = 0)::INTEGER AS cls,
         (k % 2)::INTEGER AS i1, (k // 2 % 2)::INTEGER AS i2, (k // 4 % 2)::INTEGER AS i3,
         (k % 4)::INTEGER AS ifs, (k % 3)::INTEGER AS fors, (k % 2)::INTEGER AS whiles
  FROM code_samples), lines AS (
  SELECT *, i1 + i2 + i3 + 2 + 2 * ifs + 2 * fors + 2 * whiles + 4 * tries + 4 * deep + skip
            + 2 * const + 2 * later + 3 * cls AS source_lines
  FROM bits), need AS (
  SELECT *, source_lines + doc + todo + 1 - ok AS visible_lines,
         CASE k % 5 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 0 END AS required,
         ok * CASE k % 5 WHEN 2 THEN i1 WHEN 3 THEN i2 + i3 WHEN 4 THEN i2 + i1 ELSE 0 END AS found
  FROM lines), code_features AS (
  SELECT sample_id, task_id, model_name, split, label,
         1 - ok AS meta_parse_error,
         CASE WHEN ok = 1 THEN source_lines ELSE visible_lines END AS classical_loc,
         ok * (1 + ifs + fors + whiles + tries + 4 * deep + const + later + 3 * cls) AS classical_cyclomatic_complexity,
         ok * CASE WHEN deep = 1 THEN 3 WHEN tries > 0 THEN 2 WHEN ifs + fors + whiles > 0 THEN 1 ELSE 0 END
           AS classical_max_nesting_depth,
         ok * (ifs + deep) AS ast_if_count,
         ok * (fors + deep) AS ast_for_count,
         ok * (whiles + deep) AS ast_while_count,
         ok * tries AS ast_try_count,
         ok * tries AS ast_except_count,
         ok * (1 + const) AS ast_return_count,
         ok * (i1 + i2 + i3) AS ast_import_count,
         ok * (tries > 0)::INTEGER AS ast_has_error_handling,
         CASE WHEN required = 0 THEN 1.0::DOUBLE ELSE round(found::DOUBLE / required, 4) END AS align_lib_coverage,
         required - found AS align_missing_libs,
         round(length(solution)::DOUBLE / length(instruct_prompt), 4) AS align_length_ratio,
         ok * const AS smell_hardcoded_return_funcs,
         ok * (skip + cls + later) + todo AS smell_placeholder_hits,
         (visible_lines <= 5)::INTEGER AS smell_is_very_short
  FROM need)"""

FULL_CODE_FEATURES = CODE_FEATURES + """, task_medians AS (
  SELECT task_id, median(classical_loc) AS m FROM code_features GROUP BY task_id), full_features AS (
  SELECT f.*, round(f.classical_loc / greatest(t.m, 1.0::DOUBLE), 4) AS smell_relative_length
  FROM code_features f JOIN task_medians t ON f.task_id = t.task_id)"""
