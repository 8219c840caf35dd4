"""Trained models. Training has no SQL twin, so most of these are checked by rows."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.sql import functions as F

from ..learning import forest, holdout, optimality, preparation, scorer, store, training
from ..operators import codefeatures, evaluation, explain
from ..operators.relational import label_at, union_all
from ..operators.splits import group_split, stratified_group_folds
from ..schema import FEATURE_COLUMNS
from ..session import materialise, scratch_folder
from .registry import query
from .text_queries import held_out_vocabulary_sql, train_moments_sql
from .views import FULL_CODE_FEATURES, SEED, TEXT_SAMPLES, code_samples, folds_sql, table, text_families, text_samples

# All searches walk the library's own grids, in full: a round of boosting is a few cluster jobs, and
# the tree searches are thousands of rounds.
FOLDS = ("train", "val", "test")


def _features(spark, sf_dir):
    """Features of all programs with their fold; medians are taken inside each fold."""
    split = group_split(code_samples(spark, sf_dir), seed=SEED)
    return codefeatures.feature_table(split, median_keys=("fold", "task_id"))


def _by_fold(df):
    return {f: df.where(F.col("fold") == f) for f in FOLDS}


def _static(spark, sf_dir, features=None):
    """Rows by fold: sample_id, task_id, label, the features, nulls as 0, and their vector."""
    vectors = preparation.static_vectors(_features(spark, sf_dir) if features is None else features, FEATURE_COLUMNS)
    return _by_fold(materialise(vectors.select("sample_id", "task_id", "label", "fold", *FEATURE_COLUMNS, "features")))


def _fitted(spark, folds, name, search, load):
    """The model of a search on train and validation rows, fitted once in an application."""
    rows = [folds[f].drop("features") for f in ("train", "val")]
    return store.stored(spark, name, rows, lambda: search(folds["train"], folds["val"]).model, load)


def _static_logistic(spark, folds):
    return _fitted(spark, folds, "logistic_static", training.search_logistic, LogisticRegressionModel.load)


def _static_trees(spark, folds):
    return _fitted(spark, folds, "boosted_static", training.search_boosted, GBTClassificationModel.load)


def _static_models(spark, folds):
    return {"logreg": _static_logistic(spark, folds), "boosted": _static_trees(spark, folds)}


@query("class_weights", """
WITH c AS (SELECT count(*) FILTER (quality = 0) AS n0, count(*) FILTER (quality = 1) AS n1 FROM labels)
SELECT round((n0 + n1)::DOUBLE / (2 * n0), 6) AS weight_fail, round((n0 + n1)::DOUBLE / (2 * n1), 6) AS weight_pass,
       round(n0::DOUBLE / n1, 6) AS fail_per_pass FROM c""")
def class_weights(spark, sf_dir):
    return preparation.class_weights(table(spark, sf_dir, "labels"), "quality")




@query("impute_median", """
WITH holed AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS price,
                      CASE WHEN l_linenumber <> 3 THEN l_quantity END AS quantity FROM lineitem)
SELECT l_orderkey, l_linenumber, round(coalesce(price, (SELECT median(price) FROM holed)), 6) AS price,
       coalesce(quantity, (SELECT median(quantity) FROM holed)) AS quantity FROM holed""")
def impute_median(spark, sf_dir):
    holed = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("quantity"),
    )
    return preparation.impute_median(holed, ["price", "quantity"]).withColumn("price", F.round("price", 6))


@query("standardise", """
SELECT l_orderkey, l_linenumber,
       round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_pop(l_extendedprice) FROM lineitem), 6) + 0.0::DOUBLE AS l_extendedprice,
       round((l_tax - (SELECT avg(l_tax) FROM lineitem)) / (SELECT stddev_pop(l_tax) FROM lineitem), 6) + 0.0::DOUBLE AS l_tax
FROM lineitem""")
def standardise(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax")
    scaled = preparation.standardise(lines, ["l_extendedprice", "l_tax"])
    return scaled.withColumns({c: F.round(c, 6) + 0.0 for c in ("l_extendedprice", "l_tax")})


@query("lr_static")
def lr_static(spark, sf_dir):
    folds = _static(spark, sf_dir)
    return training.report(_static_logistic(spark, folds), folds, "logistic regression, static")


_SPLIT_FEATURES = f"""WITH {FULL_CODE_FEATURES}, {folds_sql('code_samples')},
  rows AS (SELECT f.*, g.fold FROM full_features f JOIN folds g ON f.task_id = g.task_id)"""


def _moments_sql(rows, value):
    """What a solved balanced model must fulfil: half of each column's mean over the passes."""
    passes = f"FROM ({rows}) WHERE label = 1"
    return " UNION ALL ".join(
        [f"SELECT '{c}' AS name, round(avg({value.format(c=c)}) / 2, 6) AS moment {passes}" for c in FEATURE_COLUMNS]
        + ["SELECT 'intercept', 0.5::DOUBLE"])


@query("lr_static_optimality", f"""{_SPLIT_FEATURES}, moments AS (
{_moments_sql("SELECT * FROM rows WHERE fold = 'train'", "{c}::DOUBLE")})
SELECT c::DOUBLE AS c, name, moment, true AS solved FROM moments, (SELECT unnest({list(training.STATIC_C)}) AS c)""")
def lr_static_optimality(spark, sf_dir):
    """Whether the fits of all candidate settings solve their problem: see ``learning.optimality``."""
    train = _static(spark, sf_dir)["train"]
    weighted, n = preparation.with_balanced_weight(train), train.count()
    fits = zip(training.STATIC_C, training.fit_logistic(train, training.STATIC_C))
    return union_all(*[
        optimality.named(optimality.certificate(m, weighted, 1.0 / (c * n), standardised=True), FEATURE_COLUMNS)
        .withColumn("c", F.lit(float(c)))
        for c, m in fits])


@query("gbt_static")
def gbt_static(spark, sf_dir):
    folds = _static(spark, sf_dir)
    model = _static_trees(spark, folds)
    return training.report(model, folds, "boosted trees, static").withColumn("n_trees", F.lit(model.getNumTrees))


@query("rf_static")
def rf_static(spark, sf_dir):
    folds = _static(spark, sf_dir)
    return training.report(training.fit_forest(folds["train"]), folds, "random forest, static")


@query("gbt_fixed")
def gbt_fixed(spark, sf_dir):
    """One fixed setting without validation rows."""
    folds = _static(spark, sf_dir)
    model = training.fit_boosted(folds["train"])
    return training.report(model, folds, "boosted trees, one setting")


@query("model_predictions")
def model_predictions(spark, sf_dir):
    """The predictions table of the test fold: probability and call of each model."""
    folds = _static(spark, sf_dir)
    rows = folds["test"].select("sample_id", "label", "features")
    return training.with_predictions(rows, _static_models(spark, folds)).drop("features")


@query("model_contributions")
def model_contributions(spark, sf_dir):
    """What each feature adds to the fitted logistic model's scores on test."""
    folds = _static(spark, sf_dir)
    weights = dict(zip(FEATURE_COLUMNS, _static_logistic(spark, folds).coefficients.toArray().tolist()))
    return explain.explain_linear(folds["train"], folds["test"], weights)


@query("tree_importance")
def tree_importance(spark, sf_dir):
    folds = _static(spark, sf_dir)
    return training.tree_importance(_static_trees(spark, folds), FEATURE_COLUMNS)


def _crossval(features):
    """Features by fold, the rows of train and validation, and the search over group folds of train."""
    folds = _by_fold(features)
    train = materialise(folds["train"].join(stratified_group_folds(folds["train"], seed=SEED), "task_id"))
    search = training.crossval_logistic(train, FEATURE_COLUMNS, parallelism=4)
    return folds, features.where(F.col("fold").isin("train", "val")), search


@query("tree_contributions")
def tree_contributions(spark, sf_dir):
    """What each feature adds to the fitted boosted model's scores on test, over the ways of its rows."""
    folds = _static(spark, sf_dir)
    found = forest.contributions(_static_trees(spark, folds), folds["test"])
    return forest.contribution_ranking(found, folds["test"].count(), FEATURE_COLUMNS)


@query("lr_crossval")
def lr_crossval(spark, sf_dir):
    """Grid search over group folds of train, then the best setting on train and validation."""
    folds, both, search = _crossval(materialise(_features(spark, sf_dir)))
    final = training.refit_logistic(both, FEATURE_COLUMNS, search.best)
    return training.report(final, folds, "logistic regression, cross-validated")


@query("lr_crossval_optimality", f"""{_SPLIT_FEATURES}, both_folds AS (SELECT * FROM rows WHERE fold IN ('train', 'val')),
spread AS (SELECT {', '.join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in FEATURE_COLUMNS)} FROM both_folds)
SELECT *, true AS solved FROM (
{_moments_sql("SELECT * FROM both_folds, spread", "CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0 END")})""")
def lr_crossval_optimality(spark, sf_dir):
    """Whether the final fit of the cross-validated search solves its problem, on imputed and scaled columns."""
    _, both, search = _crossval(materialise(_features(spark, sf_dir)))
    final = training.refit_logistic(both, FEATURE_COLUMNS, search.best)
    rows = preparation.with_balanced_weight(PipelineModel(final.stages[:-1]).transform(both))
    certified = optimality.certificate(final.stages[-1], rows, 1.0 / (search.best * both.count()), standardised=False)
    return optimality.named(certified, FEATURE_COLUMNS).withColumn("moment", F.col("moment") + 0.0)


@query("gbt_random_search")
def gbt_random_search(spark, sf_dir):
    features = materialise(_features(spark, sf_dir))
    folds = _by_fold(features)
    train = materialise(folds["train"].join(stratified_group_folds(folds["train"], seed=SEED), "task_id"))
    search = training.crossval_boosted(train, FEATURE_COLUMNS)
    return training.report(search.model, folds, "boosted trees, random search")


def _text_tables(spark, sf_dir):
    """Labelled texts with their static features and folds, for the text models."""
    split = group_split(text_samples(spark, sf_dir), seed=SEED)
    features = codefeatures.feature_table(split, median_keys=("fold", "task_id"))
    return holdout.TextTables.build(features.join(split.select("sample_id", "solution"), "sample_id"))


@query("lr_tfidf")
def lr_tfidf(spark, sf_dir):
    model = holdout.TextModel(_text_tables(spark, sf_dir), FEATURE_COLUMNS)
    return evaluation.binary_metrics(model.scored(), keys=["fold"]).select(
        F.lit("logistic regression, static + TF-IDF").alias("model"), "fold",
        *[F.round(m, 4).alias(m) for m in ("auc", "f1", "accuracy")],
    )


@query("lr_tfidf_optimality", train_moments_sql())
def lr_tfidf_optimality(spark, sf_dir):
    """Whether the chosen fit on static and text columns solves its problem, in each text column."""
    model = holdout.TextModel(_text_tables(spark, sf_dir), FEATURE_COLUMNS)
    return model.certificate().withColumn("moment", F.round("moment", 6))


_SERVED_SQL = f"""WITH {TEXT_SAMPLES}, {folds_sql('text_samples')}
SELECT sample_id, fold, label, true AS same FROM split_text_samples"""


@query("lr_tfidf_served", _SERVED_SQL)
def lr_tfidf_served(spark, sf_dir):
    """Raw texts scored by the stored artefact, against the scores of the run that fitted it."""
    model = holdout.TextModel(_text_tables(spark, sf_dir), FEATURE_COLUMNS)
    path = f"{scratch_folder(spark).rstrip('/')}/scorer-{uuid.uuid4().hex}"
    scorer.TextScorer(FEATURE_COLUMNS, model.fitted, model.search.model).save(path)
    split = group_split(text_samples(spark, sf_dir), seed=SEED)
    served = scorer.TextScorer.load(spark, path).score(split, median_keys=("fold", "task_id"))
    there = model.scored().select("sample_id", F.col("score").alias("fitted_score"))
    return served.join(there, "sample_id").select(
        "sample_id", "fold", "label", (F.abs(F.col("score") - F.col("fitted_score")) < 1e-9).alias("same"))


@query("top_coefficients")
def top_coefficients(spark, sf_dir):
    model = holdout.TextModel(_text_tables(spark, sf_dir), FEATURE_COLUMNS)
    weights = model.search.model.coefficients.toArray()
    ranked = explain.coefficient_table(spark, model.names(), weights, FEATURE_COLUMNS)
    return explain.top_coefficients(ranked).select("name", F.round("coefficient", 6).alias("coefficient"), "side")


@query("gbt_tfidf")
def gbt_tfidf(spark, sf_dir):
    """Boosted trees on all static and text columns that a split could use."""
    tables = _text_tables(spark, sf_dir)
    folds = _by_fold(materialise(holdout.text_vectors(tables, FEATURE_COLUMNS).select("sample_id", "label", "fold", "features")))
    cut = dict(zip(FOLDS, training.with_splittable(folds["train"], [folds["val"], folds["test"]])))
    model = store.stored(
        spark, "boosted_tfidf", [tables.static, *tables.units.values()],
        lambda: training.search_boosted(cut["train"], cut["val"], training.TFIDF_TREES).model, GBTClassificationModel.load)
    return training.report(model, cut, "boosted trees, static + TF-IDF")


def _scored_models(spark, sf_dir):
    """fold, label and score of all rows under each trained model: static, cross-validated, with text.

    The last is fitted on the labelled texts, the others on the programs. Each is fitted once in an
    application. They do not need each other, and each leaves cores idle between its many short jobs:
    all are fitted at a time. Scores are written, as reports read them several times.
    """
    features = materialise(_features(spark, sf_dir))
    folds = _static(spark, sf_dir, features)
    rows = union_all(*folds.values())

    def crossval():
        # Its imputer needs the nulls.
        folds, both, search = _crossval(features)
        return training.score(training.refit_logistic(both, FEATURE_COLUMNS, search.best), union_all(*folds.values()))

    def text():
        tables = _text_tables(spark, sf_dir)
        return store.stored_table(
            spark, "scored_tfidf", [tables.static, *tables.units.values()],
            lambda: holdout.TextModel(tables, FEATURE_COLUMNS).scored())

    def scored(make):
        return materialise(make().select("sample_id", "fold", "label", "score"))

    makers = {
        "logreg": lambda: training.score(_static_logistic(spark, folds), rows),
        "boosted": lambda: training.score(_static_trees(spark, folds), rows),
        "logreg_crossval": lambda: store.stored_table(spark, "scored_crossval", [features], crossval),
        "logreg_tfidf": text,
    }
    with ThreadPoolExecutor(len(makers)) as pool:
        return dict(zip(makers, pool.map(scored, makers.values())))


@query("model_cutoffs")
def model_cutoffs(spark, sf_dir):
    """Each model on test at the default cutoff and at the one that is best on validation."""
    return union_all(*[
        evaluation.threshold_apply(df.where("fold = 'val'"), df.where("fold = 'test'")).select(
            F.lit(name).alias("model"), "setting", "threshold", *[F.round(c, 4).alias(c) for c in ("auc", "f1", "accuracy")])
        for name, df in _scored_models(spark, sf_dir).items()
    ])


@query("model_reports")
def model_reports(spark, sf_dir):
    """The report by class of each model on test, at the cutoff that is best on validation."""
    reports = []
    for name, df in _scored_models(spark, sf_dir).items():
        cutoff = evaluation.best_threshold(df.where("fold = 'val'")).select("threshold").scalar()
        called = df.where("fold = 'test'").withColumn("pred", label_at(F.col("score"), cutoff))
        reports.append(evaluation.classification_report(called).select(F.lit(name).alias("model"), "*"))
    return union_all(*reports)


@query("model_intervals")
def model_intervals(spark, sf_dir):
    """Resampled intervals of AUC and F1 on test, one row per model."""
    rows = []
    for name, df in _scored_models(spark, sf_dir).items():
        test = materialise(df.where("fold = 'test'").withColumn("pred", label_at(F.col("score"), 0.5)))
        interval = {
            metric: evaluation.bootstrap_interval(test, metric, column, seed=SEED).select(
                F.round("point", 4).alias(metric), F.round("low", 4).alias(f"{metric}_low"), F.round("high", 4).alias(f"{metric}_high"))
            for metric, column in (("auc", "score"), ("f1", "pred"))
        }
        # Both sides are one row.
        rows.append(interval["auc"].crossJoin(interval["f1"]).select(F.lit(name).alias("model"), "*"))
    return union_all(*rows)


@query("text_model_contributions")
def text_model_contributions(spark, sf_dir):
    """What each static feature adds to the scores of the model with text on test."""
    tables = _text_tables(spark, sf_dir)
    model = holdout.TextModel(tables, FEATURE_COLUMNS)
    weights = dict(zip(FEATURE_COLUMNS, model.search.model.coefficients.toArray().tolist()))
    return explain.explain_linear(tables.fold("train").static, tables.fold("test").static, weights)


_FAMILIES = [f"family{i}" for i in range(4)]


@query("lofo_vocabulary", held_out_vocabulary_sql(_FAMILIES))
def lofo_vocabulary(spark, sf_dir):
    """Terms, frequencies and weights of the vectorisers of each held-out family, by subtraction."""
    tables = _text_tables(spark, sf_dir)
    terms = holdout.FamilyTerms(tables, materialise(text_families(tables.static)), _FAMILIES)
    return union_all(*[
        fitted.select(F.lit(family).alias("family"), F.lit(kind).alias("kind"), "term", F.col("idx").cast("long").alias("idx"),
                      F.col("df").cast("long").alias("df"), F.round("idf", 6).alias("idf"))
        for family in _FAMILIES for kind, (fitted, _) in terms.without(family).items()])


@query("lofo_eval")
def lofo_eval(spark, sf_dir):
    tables = _text_tables(spark, sf_dir)
    families = materialise(text_families(tables.static))
    return holdout.leave_families_out(tables, families, FEATURE_COLUMNS).select(
        "family", "n_test_rows", *[F.round(c, 4).alias(c) for c in ("ood_auc", "ood_f1")], "ood_threshold"
    )


@query("family_drop")
def family_drop(spark, sf_dir):
    tables = _text_tables(spark, sf_dir)
    families = materialise(text_families(tables.static))
    held_out = holdout.leave_families_out(tables, families, FEATURE_COLUMNS)
    scored = holdout.TextModel(tables, FEATURE_COLUMNS).scored()
    in_family = evaluation.family_metrics(scored.where(F.col("fold") == "test"), families)
    return evaluation.family_drop(in_family, held_out, families)
