"""Weights, solvers, searches and explanations."""

import inspect
import threading
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from defectlens.learning import forest, growing, holdout, learners, optimality, preparation as P, scorer, store, training as M
from defectlens.operators import explain
from defectlens.operators.codefeatures import feature_table
from defectlens.operators.evaluation import auc, model_comparison
from defectlens.operators.splits import stratified_group_folds
from defectlens.operators.textvectors import UNITS, fit_and_weigh, fit_tfidf
from defectlens.plans import learning_queries as Q, registered
from defectlens.schema import FEATURE_COLUMNS
from defectlens.session import written_tables
from defectlens.sources import writers

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * [1.0, 5.0, 0.2] + [0.0, 2.0, 1.0]
    y = (rng.random(400) < 1 / (1 + np.exp(-(1.2 * x[:, 0] - 0.3 * x[:, 1])))).astype(int)
    return x, y


@pytest.fixture(scope="module")
def table(spark, rows):
    x, y = rows
    data = [(i, f"t{i % 40}", int(y[i]), *map(float, x[i])) for i in range(len(y))]
    df = spark.createDataFrame(data, "sample_id int, task_id string, label int, a double, b double, c double")
    return P.static_vectors(df, COLUMNS).cache()


def numpy_logistic(x, y, c):
    """Newton steps on the penalised, class-balanced logistic loss; free intercept."""
    z = (x - x.mean(0)) / x.std(0)
    z = np.c_[np.ones(len(y)), z]
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    penalty = np.diag([0.0, 1.0, 1.0, 1.0]) / c
    beta = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        gradient = z.T @ (weight * (p - y)) + penalty @ beta
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + penalty
        beta -= np.linalg.solve(hessian, gradient)
    return 1 / (1 + np.exp(-z @ beta))


@pytest.mark.parametrize("c", [0.01, 1.0])
def test_logistic_matches_a_numpy_solver(table, rows, c):
    x, y = rows
    search = M.search_logistic(table, table, [c])
    got = M.score(search.model, table).orderBy("sample_id").toPandas()["score"].to_numpy()
    assert np.abs(got - numpy_logistic(x, y, c)).max() < 0.01


def test_search_keeps_the_best_candidate(table):
    search = M.search_logistic(table, table, [0.001, 1.0])
    assert search.best in (0.001, 1.0)
    top = max(value for _, value in search.scores)
    assert auc(M.score(search.model, table)).first()["auc"] == pytest.approx(top)


def test_weights(table):
    row = P.class_weights(table).first()
    balanced = P.with_balanced_weight(table).agg(F.sum("weight")).first()[0]
    assert balanced == pytest.approx(400)
    assert row["fail_per_pass"] == pytest.approx(row["weight_pass"] / row["weight_fail"], abs=1e-5)


def test_impute_and_standardise(spark):
    df = spark.createDataFrame([(1.0, 4.0), (None, 4.0), (3.0, 4.0), (8.0, None)], "a double, b double")
    filled = P.impute_median(df, ["a", "b"])
    assert sorted(r["a"] for r in filled.collect()) == [1.0, 3.0, 3.0, 8.0]
    scaled = P.standardise(filled, ["a", "b"]).toPandas()
    assert scaled["a"].mean() == pytest.approx(0)
    assert scaled["a"].std(ddof=0) == pytest.approx(1)
    assert scaled["b"].tolist() == [0.0] * 4


def test_trees_and_importance(table):
    search = M.search_boosted(table, table, [{"rounds": 3, "step": 0.1, "depth": 3, "columns": "all"}])
    shares = {r["feature"]: r["importance"] for r in M.tree_importance(search.model, COLUMNS).collect()}
    assert sum(shares.values()) == pytest.approx(1)
    assert min(shares, key=shares.get) == "c"
    assert M.report(M.fit_forest(table, trees=5), {"train": table}, "forest").first()["auc"] > 0.7


def test_predictions_table(spark, table, tmp_path):
    models = {"logreg": M.search_logistic(table, table, [1.0]).model, "gbt": M.fit_boosted(table, {**M.PLAIN_TREES, "rounds": 2})}
    predicted = M.with_predictions(table, models).drop("features")
    assert predicted.columns[-4:] == ["logreg_prob", "logreg_pred", "gbt_prob", "gbt_pred"]
    path = str(tmp_path / "predictions")
    writers.write_table(predicted, path)
    back = spark.read.parquet(path)
    assert back.where("gbt_pred <> cast(gbt_prob >= 0.5 as int)").count() == 0
    writers.write_metrics(model_comparison(back, ["logreg_prob", "gbt_prob"]), str(tmp_path / "metrics"))
    assert {r["model"] for r in spark.read.json(str(tmp_path / "metrics")).collect()} == {"logreg_prob", "gbt_prob"}


def test_crossval(table):
    folds = table.drop("features").join(stratified_group_folds(table, k=3), "task_id")
    search = M.crossval_logistic(folds, COLUMNS, grid=(0.1, 1.0), iterations=50)
    assert isinstance(search.model, PipelineModel)
    assert len(search.scores) == 2
    final = M.refit_logistic(table.drop("features"), COLUMNS, search.best, iterations=50)
    assert M.report(final, {"all": table.drop("features")}, "refit").first()["auc"] > 0.7


def test_random_settings_stay_in_range():
    settings = M.random_tree_settings()
    assert len(settings) == 20
    assert settings == M.random_tree_settings()
    for s in settings:
        assert 100 <= s["rounds"] <= 400 and 2 <= s["depth"] <= 5 and 1 <= s["leaf"] <= 7
        assert 0.01 <= s["step"] <= 0.10 and 0.6 <= float(s["columns"]) <= 0.9


def test_model_and_vectoriser_round_trip(spark, table, tmp_path):
    model = M.search_logistic(table, table, [1.0]).model
    writers.save_model(model, str(tmp_path / "m"))
    back = LogisticRegressionModel.load(str(tmp_path / "m"))
    assert back.coefficients == model.coefficients
    docs = spark.createDataFrame([(1, "a b"), (2, "a")], "id int, t string")
    fitted = fit_tfidf(UNITS["word"](docs, "id", "t"), "id", "word", F.lit(2))
    writers.save_vectoriser(fitted, str(tmp_path / "v"))
    assert writers.load_vectoriser(spark, str(tmp_path / "v")).exceptAll(fitted).count() == 0


def test_shap_adds_up_to_the_logit(table):
    weights = {"a": 0.7, "b": -0.2}
    explained = explain.linear_shap(table, table, weights).withColumn(
        "logit", explain.linear_logit(weights, 0.1)
    ).toPandas()
    base = explained["logit"].mean()
    total = explained["shap_a"] + explained["shap_b"] + base
    assert np.abs(total - explained["logit"]).max() < 1e-9
    ranking = explain.explain_linear(table, table, weights).collect()
    assert [r["feature"] for r in ranking] == ["b", "a"]


def test_top_coefficients(spark):
    names = spark.createDataFrame([(1, "word:x"), (2, "char:y")], "idx int, name string")
    table = explain.coefficient_table(spark, names, [0.5, -1.0, 2.0], ["loc"])
    got = {(r["name"], r["side"]) for r in explain.top_coefficients(table, 1).collect()}
    assert got == {("word:x", "fail"), ("char:y", "pass")}


def test_held_out_family_never_reaches_training(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    rows = []
    for i in range(160):
        family, label = i % 2, (i // 2) % 2
        fold = ("train", "train", "val", "test")[(i // 4) % 4]
        marker = "secret" if family else words[i % 3]
        rows.append((i, f"m{family}", fold, label, f"{marker} {'good' if label else 'bad'} x{i % 7}", float(i % 5)))
    samples = spark.createDataFrame(rows, "sample_id int, model_name string, fold string, label int, solution string, loc double")
    families = spark.createDataFrame([("f1", "m1"), ("f9", "m9")], "family string, model_name string")
    tables = holdout.TextTables.build(samples)
    result = holdout.leave_families_out(tables, families, ["loc"], grid=(10.0,), iterations=30).collect()
    assert [(r["family"], r["n_test_rows"]) for r in result] == [("f1", 20)]
    assert result[0]["ood_auc"] == 1.0

    others = tables.subset(lambda df: df.where("model_name <> 'm1'"))
    model = holdout.TextModel(others, ["loc"], grid=(1.0,), iterations=10)
    assert model.names().where("name like '%secret%'").count() == 0
    assert model.scored().count() == 80


def test_vocabularies_by_subtraction(spark):
    """All but one family: the same vectoriser and weights as from a pass over the other families."""
    rng = np.random.default_rng(4)
    rows = [
        (i, f"m{i % 5}", ("train", "train", "val", "test")[i // 5 % 4], int(rng.integers(2)),
         None if i == 3 else " ".join(f"w{x}" for x in rng.integers(0, 12 + 5 * (i % 5), rng.integers(0, 9))))
        for i in range(120)]
    samples = spark.createDataFrame(rows, "sample_id int, model_name string, fold string, label int, solution string")
    families = spark.createDataFrame([("f0", "m0"), ("f1", "m1"), ("f1", "m2"), ("f9", "m9")], "family string, model_name string")
    tables = holdout.TextTables.build(samples)
    terms = holdout.FamilyTerms(tables, families, ["f0", "f1"], max_features=15)
    for name, models in (("f0", ["m0"]), ("f1", ["m1", "m2"])):
        own, is_test = F.col("model_name").isin(models), F.col("fold") == "test"
        others = tables.subset(lambda df: df.where(is_test == own))
        n = F.lit(others.fold("train").static.count())
        for kind, (fitted, weights) in terms.without(name).items():
            want, heavy = fit_and_weigh(others.units[kind], "sample_id", kind, n, 15, F.col("fold") == "train")
            columns = ["term", "idx", "df", F.round("idf", 9).alias("idf")]
            assert sorted(fitted.select(columns).collect()) == sorted(want.select(columns).collect())
            columns = ["sample_id", "idx", F.round("weight", 9).alias("weight")]
            assert sorted(weights.select(columns).collect()) == sorted(heavy.select(columns).collect())
            assert want.count() == 15


def test_medians_of_a_pipeline_stage(spark, tmp_path):
    rows = [(1.0, None, 5), (None, None, 1), (4.0, None, None), (10.0, None, 2)]
    df = spark.createDataFrame(rows, "a double, b double, c int")
    stage = P.MedianFiller(inputCols=["a", "b", "c"], outputCols=["x", "y", "z"])
    model = Pipeline(stages=[stage]).fit(df)
    writers.save_model(model, str(tmp_path / "m"))
    for fitted in (model, writers.load_model(str(tmp_path / "m"))):
        got = sorted(tuple(r) for r in fitted.transform(df).select("x", "y", "z").collect())
        assert got == [(1.0, 0.0, 5.0), (4.0, 0.0, 1.0), (4.0, 0.0, 2.0), (10.0, 0.0, 2.0)]


@pytest.mark.parametrize("standardised", [True, False])
def test_certificate_tells_a_solved_fit(table, standardised):
    weighted = P.with_balanced_weight(table)
    model = M.fit_logistic(table, [0.5], standardise=standardised)[0]
    found = optimality.named(optimality.certificate(model, weighted, 1 / (0.5 * 400), standardised), COLUMNS).collect()
    assert {r["name"] for r in found} == {"intercept", *COLUMNS} and all(r["solved"] for r in found)
    passes = table.where("label = 1").agg(F.avg("b") / 2).first()[0]
    assert {r["name"]: r["moment"] for r in found}["b"] == pytest.approx(passes, abs=1e-6)
    early = M.fit_logistic(table, [0.5], iterations=2, standardise=standardised)[0]
    other = optimality.certificate(early, weighted, 1 / (0.5 * 400), standardised).collect()
    assert not all(r["solved"] for r in other)


def test_boosting_goes_on_past_one_tree(spark, table):
    params = {"rounds": 30, "step": 0.1, "depth": 3, "columns": "all"}
    search = M.search_boosted(table.where("sample_id % 4 <> 0"), table.where("sample_id % 4 = 0"), [params])
    assert 1 < search.model.getNumTrees <= 30


@pytest.mark.parametrize("patience", [2, 4])
def test_staged_fits_keep_the_trees_of_the_full_fit(table, patience):
    train, val = table.where("sample_id % 4 <> 0").withColumn("weight", F.lit(1.0)), table.where("sample_id % 4 = 0")
    train, val = M.placed(train, "sample_id").cache(), val.withColumn("weight", F.lit(1.0)).cache()
    learner = M.boosted({"rounds": 1, "step": 0.3, "depth": 3, "columns": "0.7"})
    limits = [3, 12, 16]
    full = learner.copy({learner.maxIter: 16}).fit(train)
    losses = full.evaluateEachIteration(val)
    staged = M.fit_staged(learner, limits, train, val, patience)
    for limit in limits:
        want = learner.copy({learner.maxIter: M.best_round(losses[:limit], patience)}).fit(train)
        assert staged[limit].toDebugString.split("\n")[1:] == want.toDebugString.split("\n")[1:]
        assert staged[limit].treeWeights == want.treeWeights
        assert staged[limit].featureImportances == want.featureImportances


def test_no_staged_fit_that_cannot_end(table, monkeypatch):
    """Each fit but the last is thrown away, so the first one has rounds enough to see the best one behind."""
    train, val = (M.placed(table.where(part).withColumn("weight", F.lit(1.0)), "sample_id").cache()
                  for part in ("sample_id % 4 <> 0", "sample_id % 4 = 0"))
    fits, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, df: fits.append(self.getMaxIter()) or fit(self, df))
    learner = M.boosted({"rounds": 1, "step": 1.0, "depth": 5, "columns": "all", "leaf": 1})
    losses = fit(learner.copy({learner.maxIter: 16}), train).evaluateEachIteration(val)
    assert M.best_round(losses, 4) <= 4  # steps so long that the loss soon rises
    found = M.fit_staged(learner, [16], train, val, 4)
    assert fits == [8] and found[16].getNumTrees == M.best_round(losses, 4)


def test_contributions_add_up_to_the_raw_score(spark, table):
    model = M.fit_boosted(table, {**M.PLAIN_TREES, "rounds": 7, "depth": 4})
    nodes = forest.forest_nodes(model)
    assert nodes.count() == model.totalNumNodes and nodes.where("(left IS NULL) = (feature IS NOT NULL)").count() == 0
    base = forest.base_score(nodes).first()[0]
    found = forest.contributions(model, table)
    got = {r["sample_id"]: base + r["s"] for r in found.groupBy("sample_id").agg(F.sum("contribution").alias("s")).collect()}
    raw = {r["sample_id"]: r["rawPrediction"][1] for r in model.transform(table).collect()}
    assert len(got) == 400 and all(got[i] == pytest.approx(raw[i], abs=1e-9) for i in raw)
    ranking = forest.contribution_ranking(found, 400, COLUMNS).collect()
    assert {r["feature"] for r in ranking} == set(COLUMNS) and ranking[0]["feature"] in ("a", "b")


def test_columns_that_no_split_can_use_change_no_tree(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        common = {0: float(rng.normal()), 1: float(rng.integers(0, 3)), 4: float(rng.random())}
        rare = {j: float(rng.random()) for j in (2, 3, 5) if rng.random() < 0.05}
        label = int(common[0] + (1 if rare else 0) > 0.2)
        rows.append((i, label, Vectors.sparse(6, sorted((common | rare).items()))))
    df = spark.createDataFrame(rows, ["sample_id", "label", "features"])
    cut, other = M.with_splittable(df, [df.limit(5)], leaf=40)
    assert cut.first()["features"].size == other.first()["features"].size == 3
    params = {**M.PLAIN_TREES, "rounds": 5, "columns": "all", "leaf": 40}
    whole, part = M.fit_boosted(df, params), M.fit_boosted(cut, params)
    assert [r["score"] for r in M.score(whole, df).orderBy("sample_id").collect()] == [
        r["score"] for r in M.score(part, cut).orderBy("sample_id").collect()]


def test_a_stored_scorer_scores_raw_text_as_its_run_did(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, f"t{i % 9}", f"m{i % 3}", ("train", "train", "val", "test")[i % 4], int(rng.integers(2)),
             None if i == 7 else "x = " + " + ".join(f"w{k}" for k in rng.integers(0, 20, rng.integers(1, 9))), "", "[]")
            for i in range(80)]
    samples = spark.createDataFrame(rows, "sample_id int, task_id string, model_name string, fold string, label int, "
                                          "solution string, instruct_prompt string, libs string")
    static = feature_table(samples, median_keys=("fold", "task_id"))
    tables = holdout.TextTables.build(static.join(samples.select("sample_id", "solution"), "sample_id"))
    model = holdout.TextModel(tables, FEATURE_COLUMNS, grid=(1.0,), iterations=10, max_features=30)
    scorer.TextScorer(FEATURE_COLUMNS, model.fitted, model.search.model).save(str(tmp_path / "s"))
    served = scorer.TextScorer.load(spark, str(tmp_path / "s")).score(samples, median_keys=("fold", "task_id"))
    want = {r["sample_id"]: r["score"] for r in model.scored().collect()}
    got = {r["sample_id"]: r["score"] for r in served.collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    new = spark.createDataFrame([(1, "t", "m", "f", 0, "unseen", "", "[]")], samples.schema)
    assert 0 < scorer.TextScorer.load(spark, str(tmp_path / "s")).score(new).first()["score"] < 1


def test_settings_that_differ_in_rounds_share_a_fit(table, monkeypatch):
    fits = []
    whole = M.fit_staged
    monkeypatch.setattr(M, "fit_staged", lambda *a: fits.append(a[1]) or whole(*a))
    grid = [{"rounds": n, "step": s, "depth": 2, "columns": "all"} for n in (2, 4) for s in (0.1, 0.3)]
    search = M.search_boosted(table, table, grid, patience=2)
    assert sorted(fits) == [[2, 4], [2, 4]] and [p for p, _ in search.scores] == grid


def test_models_are_fitted_once_per_data(spark, table):
    fits = []

    def model(rows):
        return store.stored(spark, "once", [rows.drop("features")], lambda: fits.append(1) or M.fit_boosted(
            rows, {**M.PLAIN_TREES, "rounds": 2}), GBTClassificationModel.load)

    first, again, other = model(table), model(table.repartition(3)), model(table.where("sample_id > 50"))
    assert len(fits) == 2
    assert first.toDebugString.split("\n")[1:] == again.toDebugString.split("\n")[1:] != other.toDebugString.split("\n")[1:]


def test_placing_does_not_depend_on_the_session(spark):
    assert M.placed(spark.range(10).toDF("id"), "id").rdd.getNumPartitions() == 1
    assert M.placed(spark.range(10).toDF("id"), "id", 4).rdd.getNumPartitions() == 3


def test_best_round():
    assert M.best_round([3.0, 2.0, 1.0]) == 3
    assert M.best_round([3.0, 1.0, 1.0, 2.0, 0.5], patience=3) == 5
    assert M.best_round([3.0, 1.0, 1.0, 2.0, 2.0, 0.5], patience=3) == 2


def test_trees_do_not_depend_on_files(spark, table, tmp_path):
    params = {"rounds": 4, "step": 0.1, "depth": 3, "columns": "0.7"}
    rows = table.drop("features")
    models = []
    for n in (1, 8):
        rows.repartition(n).write.parquet(str(tmp_path / str(n)))
        models.append(M.fit_boosted(P.static_vectors(spark.read.parquet(str(tmp_path / str(n))), COLUMNS), {**M.PLAIN_TREES, **params}))
    assert models[0].toDebugString.split("\n")[1:] == models[1].toDebugString.split("\n")[1:]


def test_fits_take_frames_made_in_memory(spark, rows):
    x, y = rows
    data = [(i, int(y[i]), *map(float, x[i])) for i in range(60)]
    frame = P.static_vectors(spark.createDataFrame(data, "sample_id int, label int, a double, b double, c double"), COLUMNS)
    assert M.search_logistic(frame, frame, [1.0]).best == 1.0


class Taken(Exception):
    """A search's arguments, in place of the search."""


@pytest.mark.parametrize("name, place, function, want", [
    ("gbt_static", M, "search_boosted", {"grid": M.STATIC_TREES}),
    ("model_predictions", M, "search_boosted", {"grid": M.STATIC_TREES}),
    ("tree_importance", M, "search_boosted", {"grid": M.STATIC_TREES}),
    ("gbt_fixed", M, "fit_boosted", {"params": None}),
    ("gbt_random_search", M, "crossval_boosted", {"settings": None, "folds": 5}),
    ("lr_tfidf", holdout, "TextModel", {"grid": M.TFIDF_C, "iterations": 1000}),
    ("top_coefficients", holdout, "TextModel", {"grid": M.TFIDF_C, "iterations": 1000}),
    ("gbt_tfidf", M, "search_boosted", {"grid": M.TFIDF_TREES, "columns": 3}),
    ("lofo_eval", holdout, "held_out_family", {"grid": M.HOLDOUT_C, "iterations": 200}),
    ("family_drop", holdout, "held_out_family", {"grid": M.HOLDOUT_C, "iterations": 200}),
    ("family_drop", holdout, "TextModel", {"grid": M.TFIDF_C, "iterations": 1000}),
])
def test_registered_searches_are_whole(spark, table, monkeypatch, name, place, function, want):
    """Each registered query hands its learner the library's whole grid, on all columns and folds."""
    signature = inspect.signature(getattr(place, function))

    def take(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        taken = dict(bound.arguments) | dict(bound.arguments.get("options", {}))
        if "folds" in want:
            taken["folds"] = taken["train"].agg(F.max("foldCol")).first()[0] + 1
        if "columns" in want:
            taken["columns"] = taken["train"].first()["features"].size
        raise Taken({k: taken[k] for k in want})

    folded = table.select(
        "sample_id", "task_id", "label", "features", F.lit("m").alias("model_name"),
        F.element_at(F.array(*map(F.lit, Q.FOLDS)), 1 + (F.col("sample_id") % 3).cast("int")).alias("fold"))

    class Tables:
        static, units = folded, {}

        def fold(self, _):
            return self

    monkeypatch.setattr(Q, "_features", lambda *_: folded)
    monkeypatch.setattr(Q, "_static", lambda *_: Q._by_fold(folded))
    monkeypatch.setattr(Q.preparation, "static_vectors", lambda df, _: df)
    monkeypatch.setattr(Q, "_text_tables", lambda *_: Tables())
    monkeypatch.setattr(Q, "text_families", lambda df: df.select(F.lit("f").alias("family"), "model_name").distinct())
    monkeypatch.setattr(M, "search_logistic", lambda *_: M.Search(None, None))
    monkeypatch.setattr(Q.store, "stored", lambda spark, name, tables, fit, load: fit())
    monkeypatch.setattr(holdout, "FamilyTerms", lambda *_: type("Terms", (), {"without": lambda *_: {}})())
    monkeypatch.setattr(holdout, "text_vectors", lambda *_: folded)
    if function == "TextModel":
        monkeypatch.setattr(holdout, "leave_families_out", lambda *_, **__: None)
    monkeypatch.setattr(place, function, take)
    with pytest.raises(Taken) as taken:
        registered()[name](spark, None)
    assert taken.value.args[0] == want


def test_reports_of_all_models(spark, sf_dir, monkeypatch):
    """The registered reports over the four trained models, with searches cut short."""
    boosted, crossval, text = M.search_boosted, M.crossval_logistic, holdout.TextModel
    small = [{"rounds": 2, "step": 0.1, "depth": 2, "columns": "all"}]
    monkeypatch.setattr(M, "search_logistic", lambda train, val: M.Search(M.fit_logistic(train, [1.0], 20)[0], 1.0))
    monkeypatch.setattr(M, "search_boosted", lambda train, val, grid=None: boosted(train, val, small, patience=2))
    monkeypatch.setattr(M, "crossval_logistic", lambda train, columns, **_: crossval(train, columns[:3], grid=(1.0,), iterations=5))
    monkeypatch.setattr(holdout, "TextModel", lambda tables, columns: text(tables, columns, 50, (1.0,), 5))
    models = {"logreg", "boosted", "logreg_crossval", "logreg_tfidf"}
    run = {name: registered()[name](spark, sf_dir).collect() for name in (
        "model_cutoffs", "model_reports", "model_intervals", "tree_contributions", "text_model_contributions")}
    assert sorted((r["model"], r["setting"]) for r in run["model_cutoffs"]) == sorted(
        (m, s) for m in models for s in ("default", "tuned"))
    assert {(r["model"], r["class"]) for r in run["model_reports"]} == {
        (m, c) for m in models for c in ("0", "1", "accuracy", "macro avg", "weighted avg")}
    assert {r["model"] for r in run["model_intervals"]} == models
    for r in run["model_intervals"]:
        assert r["f1_low"] <= r["f1"] <= r["f1_high"]
    for name in ("tree_contributions", "text_model_contributions"):
        assert {r["feature"] for r in run[name]} == set(FEATURE_COLUMNS)


def test_logistic_fits_move_no_rows_and_leave_no_core_twice(spark, table):
    """Rows are read where they lie, and there are as many fits at a time as leave no core idle."""
    cores, running, most = spark.sparkContext.defaultParallelism, set(), []

    class Learner:
        def fit(self, train):
            running.add(self)
            most.append(len(running))
            time.sleep(0.2)
            running.remove(self)
            return train._jdf.queryExecution().executedPlan().toString()

    wide = spark.range(10 * cores, numPartitions=cores).withColumnRenamed("id", "sample_id")
    plans = M.fit_all([Learner() for _ in range(3)], wide, fit_rows=10)
    assert max(most) == 1
    assert not any("Exchange" in plan for plan in plans)
    most.clear()
    M.fit_all([Learner() for _ in range(3)], wide, parallelism=2)
    assert max(most) == min(2, cores)


def test_text_models_keep_no_table_twice(spark):
    """Counts are deleted once they are vectors, and the vectors of a held-out family with its turn."""
    rows = [(i, f"m{i % 2}", ("train", "train", "val", "test")[i // 4 % 4], i // 2 % 2, f"w{i % 7} x{i % 3}", float(i % 5)) for i in range(96)]
    tables = holdout.TextTables.build(spark.createDataFrame(
        rows, "sample_id int, model_name string, fold string, label int, solution string, loc double"))
    model = holdout.TextModel(tables, ["loc"], grid=(1.0,), iterations=5)
    columns = [set(spark.read.parquet(path).columns) for path in written_tables()]
    assert {"sample_id", "features"} <= set.union(*[c for c in columns if "features" in c])
    assert model.vectors.count() == model.scored().count() == 96

    families = spark.createDataFrame([("f0", "m0"), ("f1", "m1")], "family string, model_name string")
    before = set(written_tables())
    found = holdout.leave_families_out(tables, families, ["loc"], grid=(1.0,), iterations=5)
    assert found.count() == 2
    left = [spark.read.parquet(path).columns for path in written_tables() if path not in before]
    assert left and not any("features" in columns for columns in left)

    before = set(written_tables())
    holdout.text_vectors(tables, ["loc"])
    counts = [c for c in (spark.read.parquet(path).columns for path in written_tables() if path not in before) if "sample_id" in c]
    assert [("features" in c) for c in counts] == [True]


def test_crossval_prepares_a_fold_once(table, monkeypatch):
    """The stages before the learner are fitted once per fold and once for the model, and scores are as by MLlib's search."""
    rows = table.drop("features").withColumn("foldCol", F.col("sample_id") % 2)
    fitted, fit = [], P.MedianFiller._fit
    monkeypatch.setattr(P.MedianFiller, "_fit", lambda self, df: fitted.append(1) or fit(self, df))
    search = M.crossval_logistic(rows, COLUMNS, grid=[0.1, 10.0], iterations=20)
    assert len(fitted) == 3

    weighted, learner = P.with_balanced_weight(rows), M.logistic(1.0, 1, 20, standardise=False)
    want = CrossValidator(
        estimator=Pipeline(stages=[*M._impute_stages(COLUMNS, scale=True), learner]), numFolds=2, foldCol="foldCol",
        estimatorParamMaps=[{learner.regParam: 1.0 / (c * 200)} for c in (0.1, 10.0)],
        evaluator=BinaryClassificationEvaluator(labelCol="label", numBins=0)).fit(M.placed(weighted, "sample_id"))
    assert [value for _, value in search.scores] == pytest.approx(want.avgMetrics)
    got, model = search.model.stages[-1], want.bestModel.stages[-1]
    assert got.coefficients.toArray() == pytest.approx(model.coefficients.toArray())


def test_a_forest_is_grown_in_groups(spark, table, monkeypatch, tmp_path):
    """Several fits with seeds of their own, none of which sends its trees with every level; one forest of their trees."""
    parts, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df: parts.append((self, fit(self, df))) or parts[-1][1])
    forest = M.fit_forest(table, trees=5, depth=4, together=2)
    assert sorted(one.getNumTrees() for one, _ in parts) == [1, 2, 2] and len({one.getSeed() for one, _ in parts}) == 3
    assert all(one.getCacheNodeIds() and one.getFeatureSubsetStrategy() == "sqrt" for one, _ in parts)
    assert forest.getNumTrees == len(forest.trees) == 5 and len({tree.toDebugString.split("\n", 1)[1] for tree in forest.trees}) == 5

    got = [r["score"] for r in M.score(forest, table).orderBy("sample_id").collect()]
    each = [(one.getNumTrees(), [r["score"] for r in M.score(part, table).orderBy("sample_id").collect()]) for one, part in parts]
    assert got == pytest.approx(sum(n * np.array(scores) for n, scores in each) / 5)
    forest.write().save(str(tmp_path / "f"))
    back = RandomForestClassificationModel.load(str(tmp_path / "f"))
    assert [r["score"] for r in M.score(back, table).orderBy("sample_id").collect()] == got

    again = M.fit_forest(table.repartition(3), trees=5, depth=4, together=2)
    assert again.toDebugString.split("\n")[1:] == forest.toDebugString.split("\n")[1:]


def test_a_report_runs_its_model_once(table, monkeypatch):
    model = M.fit_boosted(table, {**M.PLAIN_TREES, "rounds": 2})
    folds = {"train": table.where("sample_id % 2 = 0"), "test": table.where("sample_id % 2 = 1")}
    want = {fold: auc(M.score(model, df)).first()["auc"] for fold, df in folds.items()}
    runs, transform = [], GBTClassificationModel.transform
    monkeypatch.setattr(GBTClassificationModel, "transform", lambda self, df: runs.append(1) or transform(self, df))
    found = M.report(model, folds, "m")
    assert "UDF" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["fold"]: r["auc"] for r in found.collect()} == pytest.approx(want, abs=1e-4) and len(runs) == 1


def test_models_of_a_report_are_fitted_at_a_time(spark, table, monkeypatch):
    """None waits for another, programs are parsed once, nulls reach the imputer, and reports read written scores."""
    folded = table.withColumn("fold", F.element_at(F.array(*map(F.lit, Q.FOLDS)), 1 + (F.col("sample_id") % 3).cast("int")))
    holed = folded.drop("features").withColumn("a", F.when(F.col("sample_id") % 5 > 0, F.col("a")))
    together, fitted, parsed, given = threading.Barrier(4, timeout=60), M.search_logistic(table, table, [1.0]).model, [], []

    def crossval(features):
        together.wait()
        given.append(features.where("a IS NULL").count())
        return Q._by_fold(folded), folded, M.Search(None, None)

    def text(*_):
        together.wait()
        return type("Tables", (), {"static": folded, "units": {}})()

    monkeypatch.setattr(Q, "FEATURE_COLUMNS", COLUMNS)
    monkeypatch.setattr(Q, "_features", lambda *_: parsed.append(1) or holed)
    monkeypatch.setattr(Q, "_static_logistic", lambda *_: together.wait() >= 0 and fitted)
    monkeypatch.setattr(Q, "_static_trees", lambda *_: together.wait() >= 0 and fitted)
    monkeypatch.setattr(Q, "_crossval", crossval)
    monkeypatch.setattr(M, "refit_logistic", lambda *_: fitted)
    monkeypatch.setattr(Q, "_text_tables", text)
    monkeypatch.setattr(holdout, "TextModel", lambda *_: type("Model", (), {"scored": lambda _: folded.withColumn("score", F.rand(1))})())
    scored = Q._scored_models(spark, None)
    assert list(scored) == ["logreg", "boosted", "logreg_crossval", "logreg_tfidf"]
    assert parsed == [1] and given == [80]
    for df in scored.values():
        assert df.columns == ["sample_id", "fold", "label", "score"] and df.count() == 400
        assert "UDF" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("dense", [256, 1])
def test_trees_grown_in_a_task_are_those_of_mllib(spark, rows, monkeypatch, dense):
    """A fit is one job over stored bins, whatever the rounds, and its trees are MLlib's where nothing is drawn."""
    x, y = rows
    rng = np.random.default_rng(4)
    x = np.c_[np.where(rng.random(x.shape) < 0.4, 0.0, x), rng.integers(0, 4, 400)]
    data = [(i, int(y[i]), float(1 + y[i]), Vectors.dense(x[i]) if i % 3 else Vectors.sparse(4, [(j, v) for j, v in enumerate(x[i]) if v]))
            for i in range(400)]
    df = spark.createDataFrame(data, ["sample_id", "label", "weight", "features"]).cache()
    monkeypatch.setattr(learners, "DENSE_COLUMNS", dense)
    options = {"weightCol": "weight", "maxDepth": 3, "minInstancesPerNode": 30, "stepSize": 0.3, "seed": 5}
    model, want = (kind(maxIter=12, **options).fit(df) for kind in (learners.BoostedTrees, GBTClassifier))
    assert isinstance(model, learners.GrownTrees) and model._loaded is None
    assert model.evaluateEachIteration(df) == pytest.approx(want.evaluateEachIteration(df), abs=1e-6)
    scores = {i: r["score"] for i, r in enumerate(M.score(want, df).orderBy("sample_id").collect())}
    assert [r["score"] for r in M.score(model, df).orderBy("sample_id").collect()] == pytest.approx(list(scores.values()), abs=1e-6)
    assert model.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=1e-6)
    assert model.totalNumNodes == want.totalNumNodes and model.treeWeights == want.treeWeights

    options |= {"subsamplingRate": 0.8, "featureSubsetStrategy": "0.5"}
    long = learners.BoostedTrees(maxIter=9, **options).fit(df)
    short, again = (learners.BoostedTrees(maxIter=4, **options).fit(frame) for frame in (df, df.select("*").cache()))
    assert short.toDebugString.split("\n")[1:] == again.toDebugString.split("\n")[1:] == long.first(4).toDebugString.split("\n")[1:]
    found = learners.candidate_scores([long, short], df).where("candidate = 1").select("score").collect()
    assert sorted(r["score"] for r in found) == pytest.approx(sorted(r["score"] for r in M.score(short, df).collect()))

    monkeypatch.setattr(learners, "IN_TASK_BYTES", 100)
    assert not isinstance(learners.BoostedTrees(maxIter=2, **options).fit(df.select("*")), learners.GrownTrees)


def test_a_random_search_measures_a_fold_in_one_pass(table, monkeypatch):
    """No candidate of a fold becomes a model of the JVM; the measure is the AUC of each."""
    rows = table.drop("features").withColumn("foldCol", F.col("sample_id") % 2)
    settings = [{**s, "rounds": 5} for s in M.random_tree_settings(draws=3)]
    loaded, measured = [], []
    save, scores = learners._Writer.saveImpl, M.candidate_scores
    monkeypatch.setattr(learners._Writer, "saveImpl", lambda self, path: loaded.append(1) or save(self, path))
    monkeypatch.setattr(M, "candidate_scores", lambda models, held: measured.append((models, held.cache())) or scores(models, held))
    search = M.crossval_boosted(rows, COLUMNS, settings=settings)
    assert len(loaded) <= 1 and len(measured) == 2
    want = np.mean([[auc(M.score(m, held)).first()["auc"] for m in models] for models, held in measured], axis=0)
    assert [value for _, value in search.scores] == pytest.approx(want.tolist())


def test_a_longer_staged_fit_goes_on_from_the_shorter_one(table, monkeypatch):
    train, val = (table.where(part).withColumn("weight", F.lit(1.0)).cache() for part in ("sample_id % 4 <> 0", "sample_id % 4 = 0"))
    grown, boost = [], learners.BoostedTrees._fit

    def fit(self, df):
        model = boost(self, df)
        grown.append((len(self.earlier.weights) if self.earlier else 0, len(model.weights)))
        return model

    monkeypatch.setattr(learners.BoostedTrees, "_fit", fit)
    learner = M.boosted({"rounds": 1, "step": 0.01, "depth": 2, "columns": "0.7"})
    found = M.fit_staged(learner, [7], train, val, 2)[7]
    assert grown == [(0, 4), (4, 7)]
    whole = learner.copy({learner.maxIter: 7}).fit(train)
    assert found.nodes.equals(whole.first(len(found.weights)).nodes)


def test_growing_keeps_little_of_a_row(monkeypatch):
    """What is needed of a row for a while is made for a block of rows; blocks change no tree."""
    rng = np.random.default_rng(7)
    n = 40_000
    store = growing.Dense(rng.integers(0, 12, (6, n)).astype(np.uint8), np.full(6, 11))
    label, weight = (rng.random(n) < 0.3 + 0.04 * store.codes[0]).astype(float), 1.0 + rng.random(n)

    def trees():
        rules = growing.Rules(5, 20, 0.0, 4, 1)
        return [{k: v.tolist() for k, v in tree.items()} for tree in growing.boost(store, label, weight, np.arange(n), rules, 2, 0.1, 0.8)]

    want = trees()
    monkeypatch.setattr(growing, "_ROWS", 1 << 10)
    tracemalloc.start()
    got = trees()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want and peak / n < learners.ROW_BYTES
