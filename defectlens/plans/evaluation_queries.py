"""Baselines, metrics, explanations and triage on given scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baselines, evaluation, explain, triage
from .registry import query
from .views import (
    SCORED_TEXTS, SEED, SPLIT_SCORED_TEXTS, TEXT_FAMILY, scored_texts, stored_split, table,
    text_families,
)

LOC = "n_text_lines"


def _fold(df, name):
    return df.where(F.col("fold") == name)


def _folds(spark, sf_dir):
    df = stored_split(spark, sf_dir).drop("score")
    return [_fold(df, f) for f in ("train", "val", "test")]


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


# Metrics in SQL over a relation with label, pred and score.
def auc_sql(relation, label="label", score="score", by=""):
    """Mid-rank AUC from ranks, an independent route to the same number."""
    part = f"PARTITION BY {by}" if by else ""
    select = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {select}(sum(CASE WHEN {label} = 1 THEN mid END) - count(*) FILTER ({label} = 1)::DOUBLE * (count(*) FILTER ({label} = 1) + 1) / 2)
       / nullif(count(*) FILTER ({label} = 1)::DOUBLE * count(*) FILTER ({label} = 0), 0) AS auc
FROM (SELECT *, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER (PARTITION BY {by + ',' if by else ''} {score}) - 1) / 2.0::DOUBLE AS mid
      FROM {relation}) {group}"""


F1_SQL = """2.0::DOUBLE * count(*) FILTER (label = 1 AND pred = 1)
  / nullif(2 * count(*) FILTER (label = 1 AND pred = 1) + count(*) FILTER (label <> pred), 0)"""
ACC_SQL = "count(*) FILTER (label = pred)::DOUBLE / count(*)"


# ---------------------------------------------------------------- baselines

BASE = f"WITH {SPLIT_SCORED_TEXTS}, train AS (SELECT * FROM split_scored_texts WHERE fold = 'train'), " \
       "val AS (SELECT * FROM split_scored_texts WHERE fold = 'val'), " \
       "test AS (SELECT * FROM split_scored_texts WHERE fold = 'test')"


@query("baseline_majority", f"""{BASE}
SELECT sample_id, label, 0 AS pred, round((SELECT 1 - avg(label) FROM train), 6) AS score FROM test""")
def baseline_majority(spark, sf_dir):
    train, _, test = _folds(spark, sf_dir)
    return _rounded(baselines.always_fail(train, test), "score").select("sample_id", "label", "pred", "score")


@query("baseline_random", f"""{BASE}, tossed AS (
  SELECT sample_id, label, (SELECT avg(label) FROM train) AS p,
         (('0x' || substr(md5('{SEED}:' || sample_id), 1, 15))::BIGINT / 1152921504606846976::DOUBLE
          < (SELECT avg(label) FROM train))::INTEGER AS pred FROM test)
SELECT sample_id, label, pred, round(CASE WHEN pred = 1 THEN p ELSE 1 - p END, 6) AS score FROM tossed""")
def baseline_random(spark, sf_dir):
    train, _, test = _folds(spark, sf_dir)
    return _rounded(baselines.random_at_class_rate(train, test), "score").select("sample_id", "label", "pred", "score")


@query("baseline_task_median", f"""{BASE}, med AS (SELECT split, median({LOC}) AS m FROM train GROUP BY split)
SELECT t.sample_id, t.label,
       (t.{LOC} > coalesce(med.m, (SELECT median({LOC}) FROM train)))::INTEGER AS pred,
       round(t.{LOC}::DOUBLE / (SELECT max({LOC}) FROM test), 6) AS score
FROM test t LEFT JOIN (SELECT * FROM med WHERE split <> 'en') med ON t.split = med.split""")
def baseline_task_median(spark, sf_dir):
    """Grouped by language with one language missing from train, so both the per-group
    median and the overall fallback are taken."""
    train, _, test = _folds(spark, sf_dir)
    # The overall median needs every train row, the group medians must lack one group.
    marked = train.withColumn("group", F.when(F.col("split") != "en", F.col("split")))
    judged = baselines.longer_than_median(marked, test.withColumn("group", F.col("split")), "group", LOC)
    return _rounded(judged, "score").select("sample_id", "label", "pred", "score")


@query("baseline_loc_threshold", f"""{BASE}, cuts AS (
  SELECT p AS percent, (SELECT quantile_cont({LOC}, [0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60,
    0.65, 0.70, 0.75, 0.80, 0.85, 0.90]) FROM train)[(p - 10) // 5 + 1] AS cutoff
  FROM (SELECT unnest(range(10, 91, 5)) AS p)),
judged AS (SELECT c.percent, c.cutoff, v.label, (v.{LOC} > c.cutoff)::INTEGER AS pred FROM val v, cuts c),
best AS (SELECT cutoff FROM (SELECT percent, cutoff, {F1_SQL} AS f1 FROM judged GROUP BY percent, cutoff)
         WHERE f1 > 0 ORDER BY f1 DESC, percent LIMIT 1)
SELECT sample_id, label, ({LOC} > coalesce((SELECT cutoff FROM best), 0))::INTEGER AS pred,
       round({LOC}::DOUBLE / (SELECT max({LOC}) FROM test), 6) AS score FROM test""")
def baseline_loc_threshold(spark, sf_dir):
    train, val, test = _folds(spark, sf_dir)
    judged = baselines.longer_than_cutoff(train, val, test, LOC)
    return _rounded(judged, "score").select("sample_id", "label", "pred", "score")


# ---------------------------------------------------------------- metrics

PREDICTED = f"WITH {SCORED_TEXTS}, predicted AS (SELECT *, (score >= 0.5::DOUBLE)::INTEGER AS pred FROM scored_texts)"


def _predicted(spark, sf_dir):
    return scored_texts(spark, sf_dir).withColumn("pred", (F.col("score") >= 0.5).cast("int"))


@query("auc", f"{PREDICTED} SELECT round(auc, 6) AS auc FROM ({auc_sql('predicted')})")
def auc(spark, sf_dir):
    return _rounded(evaluation.auc(_predicted(spark, sf_dir)), "auc")


LINE_SCORES = """WITH lines AS (
  SELECT l_linestatus, (l_returnflag = 'R')::INTEGER AS label, l_extendedprice * (1 - l_discount) AS score FROM lineitem)"""


def _line_scores(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("score"),
    )


@query("auc_by_group", f"{LINE_SCORES} SELECT l_linestatus, round(auc, 6) AS auc FROM ({auc_sql('lines', by='l_linestatus')})")
def auc_by_group(spark, sf_dir):
    return _rounded(evaluation.auc(_line_scores(spark, sf_dir), keys=["l_linestatus"]), "auc")


@query("f1_accuracy", f"{PREDICTED} SELECT round({F1_SQL}, 6) AS f1, round({ACC_SQL}, 6) AS accuracy FROM predicted")
def f1_accuracy(spark, sf_dir):
    return _rounded(evaluation.f1_accuracy(_predicted(spark, sf_dir)), "f1", "accuracy")


@query("confusion_matrix", f"""{PREDICTED}
SELECT split, count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp,
       count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp
FROM predicted GROUP BY split""")
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(_predicted(spark, sf_dir), keys=["split"])


@query("classification_report", f"""{PREDICTED}, c AS (
  SELECT cls, count(*) FILTER (label = cls) AS s, count(*) FILTER (label = cls AND pred = cls) AS hit,
         count(*) FILTER (pred = cls) AS called
  FROM predicted, (VALUES (0), (1)) v(cls) GROUP BY cls), m AS (
  SELECT cls, s, coalesce(hit::DOUBLE / nullif(called, 0), 0) AS p, coalesce(hit::DOUBLE / nullif(s, 0), 0) AS r,
         coalesce(2.0::DOUBLE * hit / nullif(s + called, 0), 0) AS f FROM c)
SELECT cls::VARCHAR AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s AS support FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, round((SELECT {ACC_SQL} FROM predicted), 6), sum(s)::BIGINT FROM m
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(s)::BIGINT FROM m
UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6),
                 round(sum(f * s) / sum(s), 6), sum(s)::BIGINT FROM m""")
def classification_report(spark, sf_dir):
    return evaluation.classification_report(_predicted(spark, sf_dir))


PR_SQL = """steps AS (
  SELECT score, sum(sum(label)) OVER w AS tp, sum(count(*)) OVER w AS called, sum(sum(label)) OVER () AS pos
  FROM {relation} GROUP BY score WINDOW w AS (ORDER BY score DESC)), points AS (
  SELECT score AS threshold, tp::DOUBLE / called AS precision, tp::DOUBLE / pos AS recall FROM steps
  UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE)"""


@query("pr_curve", f"""{PREDICTED}, {PR_SQL.format(relation='predicted')}
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM points""")
def pr_curve(spark, sf_dir):
    return _rounded(evaluation.pr_curve(_predicted(spark, sf_dir)), "precision", "recall")


@query("pr_auc", f"""{LINE_SCORES}, {PR_SQL.format(relation='lines')}
SELECT round(sum(area), 6) AS pr_auc FROM (
  SELECT (recall - lag(recall) OVER w) * (precision + lag(precision) OVER w) / 2 AS area FROM points
  WINDOW w AS (ORDER BY threshold DESC NULLS FIRST))""")
def pr_auc(spark, sf_dir):
    return _rounded(evaluation.pr_auc(_line_scores(spark, sf_dir)), "pr_auc")


def sweep_sql(relation):
    return f"""(SELECT t AS threshold, coalesce({F1_SQL}, 0) AS f1
  FROM (SELECT t, label, (score >= t)::INTEGER AS pred FROM {relation}, (SELECT unnest(range(10, 91)) / 100.0::DOUBLE AS t))
  GROUP BY t)"""


@query("threshold_sweep", f"{PREDICTED} SELECT threshold, round(f1, 6) AS f1 FROM {sweep_sql('scored_texts')}")
def threshold_sweep(spark, sf_dir):
    return _rounded(evaluation.threshold_sweep(scored_texts(spark, sf_dir)), "f1")


@query("best_threshold", f"""{PREDICTED}
SELECT threshold, round(f1, 6) AS f1 FROM {sweep_sql('scored_texts')} ORDER BY f1 DESC, threshold LIMIT 1""")
def best_threshold(spark, sf_dir):
    return _rounded(evaluation.best_threshold(scored_texts(spark, sf_dir)), "f1")


@query("threshold_apply", f"""{BASE}, best AS (
  SELECT threshold FROM {sweep_sql('val')} ORDER BY f1 DESC, threshold LIMIT 1), settings AS (
  SELECT 'default' AS setting, 0.5::DOUBLE AS threshold UNION ALL SELECT 'tuned', threshold FROM best), judged AS (
  SELECT s.setting, s.threshold, t.label, (t.score >= s.threshold)::INTEGER AS pred FROM test t, settings s)
SELECT setting, threshold, (SELECT round(auc, 6) FROM ({auc_sql('test')})) AS auc,
       round(coalesce({F1_SQL}, 0), 6) AS f1, round({ACC_SQL}, 6) AS accuracy
FROM judged GROUP BY setting, threshold""")
def threshold_apply(spark, sf_dir):
    df = stored_split(spark, sf_dir)
    return _rounded(evaluation.threshold_apply(_fold(df, "val"), _fold(df, "test")), "auc", "f1", "accuracy")


@query("model_comparison", f"""WITH {SCORED_TEXTS}, tall AS (
  SELECT 'length' AS model, label, score FROM scored_texts
  UNION ALL SELECT 'lines', label, n_text_lines::DOUBLE / 100 FROM scored_texts
  UNION ALL SELECT 'shortness', label, 1 - score FROM scored_texts), a AS ({auc_sql('tall', by='model')})
SELECT model, round(auc, 6) AS auc,
       (SELECT round(coalesce({F1_SQL}, 0), 6) FROM (SELECT label, (score >= 0.5::DOUBLE)::INTEGER AS pred FROM tall t WHERE t.model = a.model)) AS f1,
       (SELECT round({ACC_SQL}, 6) FROM (SELECT label, (score >= 0.5::DOUBLE)::INTEGER AS pred FROM tall t WHERE t.model = a.model)) AS accuracy
FROM a""")
def model_comparison(spark, sf_dir):
    scored = scored_texts(spark, sf_dir).select(
        "label", F.col("score").alias("length"), (F.col("n_text_lines") / 100).alias("lines"),
        (1 - F.col("score")).alias("shortness"),
    )
    return _rounded(evaluation.model_comparison(scored, ["length", "lines", "shortness"]), "auc", "f1", "accuracy")


@query("entry_report", f"""{BASE}, cuts AS (
  SELECT p AS percent, (SELECT quantile_cont({LOC}, [0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60,
    0.65, 0.70, 0.75, 0.80, 0.85, 0.90]) FROM train)[(p - 10) // 5 + 1] AS cutoff
  FROM (SELECT unnest(range(10, 91, 5)) AS p)),
judged AS (SELECT c.percent, c.cutoff, v.label, (v.{LOC} > c.cutoff)::INTEGER AS pred FROM val v, cuts c),
best AS (SELECT cutoff FROM (SELECT percent, cutoff, {F1_SQL} AS f1 FROM judged GROUP BY percent, cutoff)
         WHERE f1 > 0 ORDER BY f1 DESC, percent LIMIT 1),
predicted AS (SELECT label, ({LOC} > coalesce((SELECT cutoff FROM best), 0))::INTEGER AS pred, {LOC}::DOUBLE AS score FROM test)
SELECT (SELECT round(auc, 6) FROM ({auc_sql('predicted')})) AS auc, round(coalesce({F1_SQL}, 0), 6) AS f1,
       round({ACC_SQL}, 6) AS accuracy, count(*) AS n_rows FROM predicted""")
def entry_report(spark, sf_dir):
    """How well does length alone predict the label? Cutoff from train and validation,
    measured once on test."""
    train, val, test = _folds(spark, sf_dir)
    judged = baselines.longer_than_cutoff(train, val, test, LOC)
    return _rounded(evaluation.report_metrics(judged), "auc", "f1", "accuracy")


@query("baseline_comparison", f"""{BASE}, judged AS (
  SELECT 'always fail' AS model, label, 0 AS pred, (SELECT 1 - avg(label) FROM train) AS score FROM test
  UNION ALL
  SELECT 'lines > median', label, ({LOC} > (SELECT median({LOC}) FROM train))::INTEGER, {LOC}::DOUBLE FROM test),
a AS ({auc_sql('judged', by='model')}),
f AS (SELECT model, coalesce({F1_SQL}, 0) AS f1, {ACC_SQL} AS accuracy, count(*) AS n_rows FROM judged GROUP BY model)
SELECT f.model, round(a.auc, 6) AS auc, round(f.f1, 6) AS f1, round(f.accuracy, 6) AS accuracy, f.n_rows
FROM f JOIN a ON f.model = a.model""")
def baseline_comparison(spark, sf_dir):
    """Two baselines side by side; tasks of test are never in train, so the overall median holds."""
    train, _, test = _folds(spark, sf_dir)
    judged = {
        "always fail": baselines.always_fail(train, test),
        "lines > median": baselines.longer_than_median(train, test, loc=LOC),
    }
    tall = [df.select(F.lit(m).alias("model"), "label", "pred", "score") for m, df in judged.items()]
    measured = evaluation.report_metrics(tall[0].unionByName(tall[1]), keys=["model"])
    return _rounded(measured, "auc", "f1", "accuracy").orderBy(F.desc("auc"), "model")


# ---------------------------------------------------------------- bootstrap

BOOTSTRAPS = 1000


def _log_factorial_sql(x):
    y = f"greatest({x}, 1)::DOUBLE"
    series = f"{y} * ln({y}) - {y} + ln(2 * pi() * {y}) / 2 + 1 / (12 * {y}) - 1 / (360 * pow({y}, 3)) + 1 / (1260 * pow({y}, 5))"
    return f"CASE WHEN ({x}) <= 20 THEN ln(factorial(least({x}, 20)::INTEGER)::DOUBLE) ELSE {series} END"


def _draws_sql(relation, value):
    """Multinomial counts of the (value, label) cells of each replicate, one binomial after the other.

    The first cells' quantiles of hashes, by mass from the mode outwards; of at most 4,096 values.
    """
    return f"""cells AS (
  SELECT row_number() OVER (ORDER BY v, label) AS i, 2 * (dense_rank() OVER (ORDER BY v) - 1) + label AS place, v, label, c,
         sum(c) OVER (ORDER BY v DESC, label DESC) AS mass
  FROM (SELECT {value}::DOUBLE AS v, label, count(*) AS c FROM {relation} GROUP BY ALL)),
walk AS (
  SELECT r AS replicate, 0::BIGINT AS i, (SELECT count(*) FROM {relation}) AS rest, 0::BIGINT AS w
  FROM (SELECT unnest(range({BOOTSTRAPS})) AS r)
  UNION ALL
  SELECT replicate, i, (n - w)::BIGINT, w::BIGINT FROM (
    SELECT *, CASE WHEN c = mass THEN n WHEN n = 0 THEN 0 ELSE coalesce(list_reduce(
        list_prepend({{'rest': u - top, 'up': top, 'down': top, 'k': CASE WHEN u < top THEN mode END, 'j': 0::BIGINT}},
          list_transform(range(1, CASE WHEN u < top THEN 1 ELSE floor(12 * sqrt(n * p * (1 - p)))::BIGINT + 21 END),
            lambda j: {{'rest': 0::DOUBLE, 'up': 0::DOUBLE, 'down': 0::DOUBLE, 'k': NULL::BIGINT, 'j': j}})),
        lambda s, e: CASE WHEN s.k IS NOT NULL THEN s
          WHEN s.rest - s.up * (greatest(n - mode - e.j + 1, 0) / (mode + e.j)::DOUBLE * (p / (1 - p))) < 0
          THEN {{'rest': 0::DOUBLE, 'up': 0::DOUBLE, 'down': 0::DOUBLE, 'k': (mode + e.j)::BIGINT, 'j': e.j}}
          ELSE {{'rest': s.rest - s.up * (greatest(n - mode - e.j + 1, 0) / (mode + e.j)::DOUBLE * (p / (1 - p)))
                       - s.down * (greatest(mode - e.j + 1, 0) / (n - mode + e.j)::DOUBLE * ((1 - p) / p)),
                'up': s.up * (greatest(n - mode - e.j + 1, 0) / (mode + e.j)::DOUBLE * (p / (1 - p))),
                'down': s.down * (greatest(mode - e.j + 1, 0) / (n - mode + e.j)::DOUBLE * ((1 - p) / p)),
                'k': CASE WHEN s.rest - s.up * (greatest(n - mode - e.j + 1, 0) / (mode + e.j)::DOUBLE * (p / (1 - p)))
                       - s.down * (greatest(mode - e.j + 1, 0) / (n - mode + e.j)::DOUBLE * ((1 - p) / p)) < 0
                     THEN (mode - e.j)::BIGINT END, 'j': e.j}} END).k, mode) END AS w
    FROM (
      SELECT *, exp({_log_factorial_sql("n")} - ({_log_factorial_sql("mode")}) - ({_log_factorial_sql("n - mode")})
                    + mode * ln(p) + (n - mode) * ln(CASE WHEN p < 1 THEN 1 - p ELSE 0.5 END)) AS top
      FROM (
        SELECT *, least(floor((n + 1) * p)::BIGINT, n) AS mode,
          ('0x' || substr(md5('{SEED}:' || replicate || ':0:' || place), 1, 15))::BIGINT / 1152921504606846976::DOUBLE AS u
        FROM (SELECT w.replicate, c.i, c.place, c.c, c.mass, w.rest AS n, c.c::DOUBLE / c.mass AS p
              FROM walk w JOIN cells c ON c.i = w.i + 1))))),
resampled AS (SELECT replicate, label, v AS score, v AS pred, unnest(range(w)) AS copy FROM walk JOIN cells USING (i))"""


def _interval_sql(metric, point, per_replicate):
    return f"""SELECT '{metric}' AS metric, round(({point}), 6) AS point, round(quantile_cont(v, 0.025), 6) AS low,
       round(quantile_cont(v, 0.975), 6) AS high FROM ({per_replicate})"""


_RESAMPLED = PREDICTED.replace("WITH", "WITH RECURSIVE", 1)


@query("bootstrap_f1", f"{_RESAMPLED}, {_draws_sql('predicted', 'pred')} " + _interval_sql(
    "f1", f"SELECT coalesce({F1_SQL}, 0) FROM predicted",
    f"SELECT coalesce({F1_SQL}, 0) AS v FROM resampled GROUP BY replicate"))
def bootstrap_f1(spark, sf_dir):
    result = evaluation.bootstrap_interval(_predicted(spark, sf_dir), "f1", "pred", n_boot=BOOTSTRAPS, seed=SEED)
    return _rounded(result, "point", "low", "high")


@query("bootstrap_auc", f"{_RESAMPLED}, {_draws_sql('predicted', 'score')} " + _interval_sql(
    "auc", f"SELECT auc FROM ({auc_sql('predicted')})",
    f"SELECT auc AS v FROM ({auc_sql('resampled', by='replicate')})"))
def bootstrap_auc(spark, sf_dir):
    result = evaluation.bootstrap_interval(_predicted(spark, sf_dir), "auc", "score", n_boot=BOOTSTRAPS, seed=SEED)
    return _rounded(result, "point", "low", "high")


def _poisson_sql(relation):
    """A Poisson(count) weight of each (label, pred) cell and replicate, by mass from the mode outwards."""
    up, down = "s.up * c / (c + e.j)", "CASE WHEN c >= e.j THEN s.down * (c - e.j + 1) / c ELSE 0 END"
    none = "0::DOUBLE"
    return f"""cells AS (SELECT label, pred, count(*)::DOUBLE AS c FROM {relation} GROUP BY label, pred),
started AS (
  SELECT *, ('0x' || substr(md5('{SEED}:' || replicate || ':' || label || ':' || pred), 1, 15))::BIGINT / 1152921504606846976::DOUBLE AS u,
         exp(c * ln(c) - c - ({_log_factorial_sql("c")})) AS top
  FROM cells, (SELECT unnest(range({BOOTSTRAPS})) AS replicate)),
resampled AS (
  SELECT replicate, label, pred, coalesce(list_reduce(
      list_prepend({{'rest': u - top, 'up': top, 'down': top, 'k': CASE WHEN u < top THEN c END, 'j': 0::BIGINT}},
        list_transform(range(1, CASE WHEN u < top THEN 1 ELSE floor(12 * sqrt(c))::BIGINT + 21 END),
          lambda j: {{'rest': {none}, 'up': {none}, 'down': {none}, 'k': NULL::DOUBLE, 'j': j}})),
      lambda s, e: CASE WHEN s.k IS NOT NULL THEN s
        WHEN s.rest - {up} < 0 THEN {{'rest': {none}, 'up': {none}, 'down': {none}, 'k': c + e.j, 'j': e.j}}
        ELSE {{'rest': s.rest - {up} - {down}, 'up': {up}, 'down': {down},
              'k': CASE WHEN s.rest - {up} - {down} < 0 THEN c - e.j END, 'j': e.j}} END).k, c) AS w
  FROM started)"""


_WEIGHTED_F1 = """2 * sum(w) FILTER (label = 1 AND pred = 1)
  / nullif(2 * sum(w) FILTER (label = 1 AND pred = 1) + sum(w) FILTER (label <> pred), 0)"""


@query("bootstrap_poisson", f"{LINE_SCORES}, predicted AS (SELECT *, (score >= 30000)::INTEGER AS pred FROM lines), "
       + _poisson_sql("predicted") + " " + _interval_sql(
    "f1", f"SELECT coalesce({F1_SQL}, 0) FROM predicted",
    f"SELECT coalesce({_WEIGHTED_F1}, 0) AS v FROM resampled GROUP BY replicate"))
def bootstrap_poisson(spark, sf_dir):
    """All of lineitem, grouped before it is resampled, with weights drawn apart."""
    lines = _line_scores(spark, sf_dir).withColumn("pred", (F.col("score") >= 30000).cast("int"))
    result = evaluation.bootstrap_interval(lines, "f1", "pred", n_boot=1000, seed=SEED, mode="poisson")
    return _rounded(result, "point", "low", "high")


# ---------------------------------------------------------------- families

@query("family_eval", f"""{PREDICTED}, fam AS (
  SELECT label, score, {TEXT_FAMILY} AS family, (score >= 0.39::DOUBLE)::INTEGER AS pred FROM predicted),
a AS ({auc_sql('fam', by='family')}), f AS (SELECT family, coalesce({F1_SQL}, 0) AS f1 FROM fam GROUP BY family)
SELECT a.family, round(a.auc, 6) AS auc, round(f.f1, 6) AS f1 FROM a JOIN f ON a.family = f.family""")
def family_eval(spark, sf_dir):
    scored = scored_texts(spark, sf_dir)
    return _rounded(evaluation.family_metrics(scored, text_families(scored)), "auc", "f1")


_HALF = "sample_id % 2 = 0"


@query("family_drop_given", f"""{PREDICTED}, fam AS (
  SELECT sample_id, model_name, label, score, {TEXT_FAMILY} AS family, (score >= 0.39::DOUBLE)::INTEGER AS pred FROM predicted),
half AS (SELECT * FROM fam WHERE {_HALF}),
a AS ({auc_sql('fam', by='family')}), f AS (SELECT family, coalesce({F1_SQL}, 0) AS f1 FROM fam GROUP BY family),
b AS ({auc_sql('half', by='family')}),
g AS (SELECT family, coalesce({F1_SQL}, 0) AS f1, count(*) AS n FROM half GROUP BY family),
m AS (SELECT family, count(DISTINCT model_name) AS n FROM fam GROUP BY family)
SELECT a.family, m.n AS n_models, g.n AS n_test_rows, round(a.auc, 4) AS in_dist_auc, round(b.auc, 4) AS ood_auc,
       round(a.auc - b.auc, 4) AS auc_drop, round(f.f1, 4) AS in_dist_f1, round(g.f1, 4) AS ood_f1,
       round(f.f1 - g.f1, 4) AS f1_drop, 0.39::DOUBLE AS ood_threshold, round(a.auc * 100, 1) AS full_pct,
       round(b.auc * 100, 1) AS loo_pct
FROM a JOIN f USING (family) JOIN b USING (family) JOIN g USING (family) JOIN m USING (family)""")
def family_drop_given(spark, sf_dir):
    """The loss per family between two given results: on all rows, and on every other row."""
    scored = scored_texts(spark, sf_dir)
    families = text_families(scored)
    half = scored.where(_HALF)
    sizes = half.join(families, "model_name").groupBy("family").agg(F.count("*").alias("n_test_rows"))
    held_out = evaluation.family_metrics(half, families).select(
        "family", F.col("auc").alias("ood_auc"), F.col("f1").alias("ood_f1"), F.lit(0.39).alias("ood_threshold")
    ).join(sizes, "family")
    return evaluation.family_drop(evaluation.family_metrics(scored, families), held_out, families)


# ---------------------------------------------------------------- explanation

WEIGHTS = {"l_quantity": -0.031, "l_extendedprice": 0.00002, "l_discount": 1.7, "l_tax": -2.5}
INTERCEPT = -0.4
_LOGIT_SQL = f"({INTERCEPT}::DOUBLE" + "".join(f" + {w!r}::DOUBLE * {f}" for f, w in WEIGHTS.items()) + ")"


@query("linear_score", f"""
SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-{_LOGIT_SQL})), 6) AS score FROM lineitem""")
def linear_score(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(explain.linear_score(WEIGHTS, INTERCEPT), 6).alias("score")
    )


_SHAP_SQL = {f: f"{w!r}::DOUBLE * ({f} - (SELECT avg({f}) FROM lineitem WHERE l_linestatus = 'F'))" for f, w in WEIGHTS.items()}


# Adding 0.0 turns a rounded negative zero into zero.
@query("linear_shap", f"""
SELECT l_orderkey, l_linenumber, {', '.join(f'round({sql}, 6) + 0.0::DOUBLE AS shap_{f}' for f, sql in _SHAP_SQL.items())}
FROM lineitem""")
def linear_shap(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    explained = explain.linear_shap(lines, lines.where(F.col("l_linestatus") == "F"), WEIGHTS)
    return explained.select(
        "l_orderkey", "l_linenumber", *[(F.round(f"shap_{f}", 6) + 0.0).alias(f"shap_{f}") for f in WEIGHTS]
    )


@query("shap_ranking", f"""
WITH bg AS (SELECT * FROM orders WHERE o_orderstatus = 'F'),
te AS (SELECT * FROM orders WHERE o_orderstatus <> 'F'),
s AS (SELECT 0.00001::DOUBLE * (o_totalprice - (SELECT avg(o_totalprice) FROM bg)) AS price,
             -0.003::DOUBLE * (o_custkey - (SELECT avg(o_custkey) FROM bg)) AS cust FROM te),
r AS (SELECT 'o_totalprice' AS feature, round(avg(abs(price)), 6) AS mean_abs_shap, round(avg(price), 6) AS mean_signed_shap FROM s
      UNION ALL SELECT 'o_custkey', round(avg(abs(cust)), 6), round(avg(cust), 6) FROM s)
SELECT feature, feature AS label, mean_abs_shap, mean_signed_shap,
       CASE WHEN mean_signed_shap < 0 THEN 'failure' ELSE 'passing' END AS direction FROM r""")
def shap_ranking(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    done, open_ = orders.where(F.col("o_orderstatus") == "F"), orders.where(F.col("o_orderstatus") != "F")
    return explain.explain_linear(done, open_, {"o_totalprice": 0.00001, "o_custkey": -0.003}, key="o_orderkey")


@query("top_coefficients_given", """
WITH c AS (SELECT s_name AS name, s_acctbal AS coefficient FROM supplier)
SELECT * FROM (SELECT name, coefficient, 'fail' AS side FROM c ORDER BY coefficient, name LIMIT 20)
UNION ALL SELECT * FROM (SELECT name, coefficient, 'pass' AS side FROM c ORDER BY coefficient DESC, name LIMIT 20)""")
def top_coefficients_given(spark, sf_dir):
    given = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("coefficient"))
    return explain.top_coefficients(given)


# ---------------------------------------------------------------- triage

@query("risk_ranking", f"""WITH {SCORED_TEXTS}, r AS (
  SELECT sample_id, score, row_number() OVER (ORDER BY score, md5('tie:' || sample_id), sample_id) AS rn,
         count(*) OVER () AS n FROM scored_texts)
SELECT sample_id, round(1 - score, 6) AS risk, rn AS risk_rank, ((rn - 1) * 10 // n + 1)::INTEGER AS risk_band FROM r""")
def risk_ranking(spark, sf_dir):
    return triage.risk_ranking(scored_texts(spark, sf_dir), "sample_id", "score")


@query("risk_routing", f"""WITH {SCORED_TEXTS}
SELECT CASE WHEN 1 - score >= 0.6::DOUBLE THEN 'senior' WHEN 1 - score < 0.3::DOUBLE THEN 'automated' ELSE 'junior' END AS route,
       (1 - score >= 0.5::DOUBLE)::INTEGER AS retry, count(*) AS n_rows, sum(1 - label)::BIGINT AS n_failures
FROM scored_texts GROUP BY ALL""")
def risk_routing(spark, sf_dir):
    routed = triage.retry_flag(triage.route(scored_texts(spark, sf_dir), "score"), "score", 0.5)
    return routed.groupBy("route", "retry").agg(
        F.count("*").alias("n_rows"), F.sum(1 - F.col("label")).alias("n_failures")
    )


@query("capacity_curve", """
WITH logged AS (SELECT (event_type <> 'error')::INTEGER AS label, round(1 - exp(-value / 40), 6) AS risk FROM events),
cuts AS (SELECT unnest(range(10, 91)) / 100.0::DOUBLE AS t)
SELECT t AS threshold, count(*) FILTER (risk >= t) AS n_flagged, round(count(*) FILTER (risk >= t)::DOUBLE / count(*), 6) AS load,
       round(coalesce(count(*) FILTER (risk >= t AND label = 0)::DOUBLE / nullif(count(*) FILTER (label = 0), 0), 0), 6) AS catch_rate,
       round(coalesce(count(*) FILTER (risk >= t AND label = 0)::DOUBLE / nullif(count(*) FILTER (risk >= t), 0), 0), 6) AS precision
FROM logged, cuts GROUP BY t""")
def capacity_curve(spark, sf_dir):
    logged = table(spark, sf_dir, "events").select(
        (F.col("event_type") != "error").cast("int").alias("label"),
        F.round(1 - F.exp(-F.col("value") / 40), 6).alias("risk"),
    )
    return triage.capacity_curve(logged, "label", "risk")
