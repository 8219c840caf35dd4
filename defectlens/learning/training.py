"""Model searches. Every candidate is fitted by MLlib over the cluster."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, UnivariateFeatureSelector, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.evaluation import auc, binary_metrics
from ..operators.relational import label_at, union_all
from ..session import FIT_ROWS, materialise, placed
from .learners import BoostedTrees, GrownTrees, candidate_scores
from .preparation import MedianFiller, with_balanced_weight, with_positive_weight

# The parameter grids of the searches.
STATIC_C = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
TFIDF_C = (0.01, 0.1, 1.0, 10.0)
CROSSVAL_C = (0.01, 0.1, 1.0, 10.0)
HOLDOUT_C = (0.1, 1.0, 10.0)
STATIC_TREES = [
    {"rounds": n, "step": lr, "depth": d, "columns": "0.8"}
    for n in (200, 500) for lr in (0.05, 0.1) for d in (4, 7)
]
TFIDF_TREES = [
    {"rounds": n, "step": lr, "depth": 6, "columns": "0.3"} for n in (300, 500) for lr in (0.05, 0.1)
]
PLAIN_TREES = {"rounds": 400, "step": 0.05, "depth": 6, "columns": "0.8", "leaf": 1}
ROW_SHARE, LEAF_ROWS, STOP_AFTER = 0.8, 20, 50
#: Relative gain of an iteration at which the logistic solver ends: coefficients are those of the
#: problem, not of the solver's patience (see :mod:`optimality`).
TOLERANCE = 1e-10
FOREST_TREES, FOREST_LEAF, FOREST_DEPTH = 400, 2, 30
#: Trees of one fit of a forest, and the distance of the seeds of two fits: partitions take the numbers next to a seed.
FOREST_GROUP, SEED_STEP = 50, 1_000_003


@dataclass
class Search:
    """The chosen model and the AUC of each candidate."""

    model: object
    best: object
    scores: list = field(default_factory=list)


def score(model, df: DataFrame, out: str = "score") -> DataFrame:
    """Add the probability of pass; the model's working columns are dropped."""
    scored = model.transform(df)
    added = [c for c in scored.columns if c not in df.columns]
    return scored.withColumn(out, vector_to_array(F.col("probability"))[1]).drop(
        *[c for c in added if c != out]
    )


def fit_all(estimators: Sequence, train: DataFrame, parallelism: int = 4, fit_rows: int = FIT_ROWS) -> list:
    """Fitted candidates, for learners that draw no rows: these are read where they lie, nothing moves.

    Files are read together up to some ``fit_rows`` a task, as an iteration costs a task each. A fit
    keeps blocks of all rows while it runs. So there are several at a time only as long as one leaves
    cores idle: what is kept does not grow with the number of candidates.
    """
    train = train.coalesce(max(1, -(-train.count() // fit_rows)))
    cores = train.sparkSession.sparkContext.defaultParallelism
    together = max(1, min(parallelism, cores // max(1, train.rdd.getNumPartitions())))
    with ThreadPoolExecutor(together) as pool:
        return list(pool.map(lambda estimator: estimator.fit(train), estimators))


def with_predictions(df: DataFrame, models: dict[str, object], cutoff: float = 0.5) -> DataFrame:
    """Add ``<name>_prob`` and ``<name>_pred`` per model: the predictions table."""
    for name, model in models.items():
        df = score(model, df, f"{name}_prob")
        df = df.withColumn(f"{name}_pred", label_at(F.col(f"{name}_prob"), cutoff))
    return df


def pick_best(models: Sequence, candidates: Sequence, val: DataFrame) -> Search:
    """The candidate with the best validation AUC, the first one on ties.

    All candidates are scored and measured in one job; a single one needs no measuring.
    """
    if len(models) == 1:
        return Search(models[0], candidates[0], [(candidates[0], None)])
    if all(isinstance(model, GrownTrees) for model in models):
        scored = materialise(candidate_scores(models, val))
    else:
        scored = union_all(*[
            score(model, val).select("label", "score", F.lit(i).alias("candidate"))
            for i, model in enumerate(models)
        ])
    # One number per candidate comes back to the driver.
    measured = {r["candidate"]: r["auc"] for r in auc(scored, keys=["candidate"]).collect()}
    scores = [measured.get(i) for i in range(len(models))]
    best = max(range(len(models)), key=lambda i: (-1.0 if scores[i] is None else scores[i], -i))
    return Search(models[best], candidates[best], list(zip(candidates, scores)))


def logistic(c: float, n_rows: int, iterations: int, standardise: bool) -> LogisticRegression:
    """L2 logistic regression with inverse strength C: the loss is a mean here, so the
    penalty is divided by the sum of the weights, which is the row count."""
    return LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="weight",
        regParam=1.0 / (c * n_rows), elasticNetParam=0.0,
        standardization=standardise, maxIter=iterations, tol=TOLERANCE,
    )


def search_logistic(
    train: DataFrame, val: DataFrame, grid: Iterable[float] = STATIC_C,
    iterations: int = 1000, standardise: bool = True, fit_rows: int = FIT_ROWS,
) -> Search:
    grid = list(grid)
    return pick_best(fit_logistic(train, grid, iterations, standardise, fit_rows), grid, val)


def fit_logistic(
    train: DataFrame, grid: Sequence[float], iterations: int = 1000, standardise: bool = True, fit_rows: int = FIT_ROWS,
) -> list:
    """A balanced model per C."""
    n_rows = train.count()
    return fit_all([logistic(c, n_rows, iterations, standardise) for c in grid], with_balanced_weight(train), fit_rows=fit_rows)


def boosted(params: dict, seed: int = 42) -> GBTClassifier:
    return BoostedTrees(
        featuresCol="features", labelCol="label", weightCol="weight",
        maxIter=params["rounds"], stepSize=params["step"], maxDepth=params["depth"],
        featureSubsetStrategy=params["columns"], subsamplingRate=params.get("rows", ROW_SHARE),
        minInstancesPerNode=params.get("leaf", LEAF_ROWS), minInfoGain=params.get("gain", 0.0), seed=seed,
    )


def best_round(losses: Sequence[float], patience: int = STOP_AFTER) -> int:
    """Number of rounds up to the least loss, if rounds stop once ``patience`` of them in a row
    have not gone below it; the first of equal ones."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def first_rounds(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model of the first ``rounds`` trees, which are those a fit of so many rounds grows."""
    if isinstance(model, GrownTrees):
        return model.first(rounds)
    java, gateway = model._java_obj, SparkContext._active_spark_context._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    all_trees, all_weights = java.trees(), java.treeWeights()
    for i in range(rounds):
        trees[i], weights[i] = all_trees[i], all_weights[i]
    cut = GBTClassificationModel(gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        model.uid, trees, weights, model.numFeatures, model.numClasses))
    return model._copyValues(cut)


def fit_staged(
    estimator: GBTClassifier, rounds: Sequence[int], train: DataFrame, val: DataFrame, patience: int = STOP_AFTER,
) -> dict[int, GBTClassificationModel]:
    """For each of ``rounds`` the model of the best of so many rounds on the validation rows.

    Every round draws from the seed and its number, so a shorter fit is the beginning of a longer
    one. Twice ``patience`` rounds are fitted, then twice as many, and so on, until the best round
    lies ``patience`` behind or the largest of ``rounds`` is reached; the models kept are cut out of
    the last fit. A fit inside a task goes on from the trees of the one before. No more than ``patience`` can tell nothing, as the best round may still come. At
    most four times the rounds up to the stop are fitted, or twice ``patience``, whatever the limit is.
    """
    most, n, model = max(rounds), 2 * patience, None
    while True:
        n = min(n, most)
        learner = estimator.copy({estimator.maxIter: n})
        if isinstance(model, GrownTrees):
            learner.earlier = model
        model = learner.fit(train)
        losses = model.evaluateEachIteration(val)
        if n == most or n - best_round(losses, patience) >= patience:
            return {r: first_rounds(model, best_round(losses[:r], patience)) for r in rounds}
        n *= 2


def search_boosted(
    train: DataFrame, val: DataFrame, grid: Sequence[dict] = STATIC_TREES, seed: int = 42,
    patience: int = STOP_AFTER, parallelism: int = 8, ident: str = "sample_id",
) -> Search:
    """Each setting with its best number of rounds; those that differ in rounds only share a fit."""
    grid = list(grid)
    shared = defaultdict(list)
    for params in grid:
        shared[tuple(sorted((k, v) for k, v in params.items() if k != "rounds"))].append(params)
    weighted = placed(with_positive_weight(train), ident).persist()
    measured = placed(val.withColumn("weight", F.lit(1.0)), ident).persist()

    def fitted(group):
        found = fit_staged(boosted(group[0], seed), [p["rounds"] for p in group], weighted, measured, patience)
        return [(p, found[p["rounds"]]) for p in group]

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            pairs = [pair for group in pool.map(fitted, shared.values()) for pair in group]
        models = [next(m for p, m in pairs if p is params) for params in grid]
        return pick_best(models, grid, val)
    finally:
        weighted.unpersist()
        measured.unpersist()


def fit_boosted(train: DataFrame, params: dict | None = None, seed: int = 42, ident: str = "sample_id"):
    """One fixed setting, unweighted."""
    flat = train.withColumn("weight", F.lit(1.0))
    return boosted(PLAIN_TREES if params is None else params, seed).fit(placed(flat, ident))


def with_splittable(
    train: DataFrame, others: Sequence[DataFrame], leaf: int = LEAF_ROWS, features: str = "features",
) -> list[DataFrame]:
    """The frames with the columns of ``features`` that a split could use, train first.

    A split leaves ``leaf`` train rows on either side, so one on a sparse column needs as many rows
    in which it is not 0: columns of fewer are left out and no tree that could grow is lost. The
    counts are one aggregate, as wide as the vectors; nothing is made dense.
    """
    counts = train.agg(Summarizer.numNonZeros(F.col(features)).alias("n")).first()["n"]
    kept = [i for i, n in enumerate(counts.toArray()) if n >= leaf] if counts is not None else []
    cut = VectorSlicer(inputCol=features, outputCol="_kept", indices=kept or [0])
    return [cut.transform(df).drop(features).withColumnRenamed("_kept", features) for df in (train, *others)]


def select_columns(train: DataFrame, n_features: int, features: str = "features"):
    """Keep the ``n_features`` columns that separate the classes best, before tree growing."""
    selector = UnivariateFeatureSelector(
        featuresCol=features, labelCol="label", outputCol="selected", selectionMode="numTopFeatures"
    )
    return selector.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(
        n_features
    ).fit(train)


def fit_forest(
    train: DataFrame, trees: int = FOREST_TREES, seed: int = 42, depth: int = FOREST_DEPTH, ident: str = "sample_id",
    together: int = FOREST_GROUP, fit_rows: int = FIT_ROWS,
) -> RandomForestClassificationModel:
    """Trees grow until leaves are pure or small; the library's largest depth ends them.

    A level of a fit is a job that reads every row for every tree, in a task per partition, and sends
    all trees with it. Trees do not depend on each other: ``together`` of them are a fit with a seed of
    its own, there are as many fits at a time as leave no core idle, and their trees are one forest.
    """
    rows = placed(with_balanced_weight(train), ident, fit_rows).persist()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    learner = RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", maxDepth=depth, minInstancesPerNode=FOREST_LEAF,
        # Rows keep the node they are in: a level does not send the trees grown so far, nor walk down them.
        cacheNodeIds=True,
        # A group of one tree is still part of a forest.
        featureSubsetStrategy="sqrt" if trees > 1 else "auto")
    groups = [(seed + SEED_STEP * i, min(together, trees - start)) for i, start in enumerate(range(0, trees, together))]

    def fitted(group):
        return learner.copy({learner.seed: group[0], learner.numTrees: group[1]}).fit(rows)

    try:
        with ThreadPoolExecutor(max(1, min(len(groups), cores // rows.rdd.getNumPartitions()))) as pool:
            return joined_forest(list(pool.map(fitted, groups)))
    finally:
        rows.unpersist()


def joined_forest(parts: Sequence[RandomForestClassificationModel]) -> RandomForestClassificationModel:
    """One forest of the trees of several, in their order."""
    if len(parts) == 1:
        return parts[0]
    gateway, first = SparkContext._active_spark_context._gateway, parts[0]
    grown = [tree for part in parts for tree in part._java_obj.trees()]
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, len(grown))
    for i, tree in enumerate(grown):
        trees[i] = tree
    joined = RandomForestClassificationModel(gateway.jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(
        first.uid, trees, first.numFeatures, first.numClasses))
    first._copyValues(joined, {first.numTrees: len(grown)})._transfer_params_to_java()
    return joined


def _impute_stages(columns: Sequence[str], scale: bool) -> list:
    filled = [f"{c}_filled" for c in columns]
    stages = [
        MedianFiller(inputCols=list(columns), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="assembled" if scale else "features"),
    ]
    if scale:
        stages.append(StandardScaler(inputCol="assembled", outputCol="features", withMean=True, withStd=True))
    return stages


def _crossval(
    stages: Sequence, learner, changes: Sequence[dict], rows: DataFrame, fold_col: str, folds: int, parallelism: int,
    together: int = 1,
) -> tuple[PipelineModel, list[float]]:
    """Mean AUC over group folds of each of ``changes`` to the learner, and the best one fitted on all rows.

    What comes before the learner does not depend on its settings, so it is fitted once per fold.
    ``together`` folds are worked on at a time.
    """
    evaluator = BinaryClassificationEvaluator(labelCol="label", numBins=0)
    learners = [learner.copy(change) for change in changes]

    def measured_on(fold):
        prepared = Pipeline(stages=list(stages)).fit(rows.where(F.col(fold_col) != fold))
        train, held = (
            prepared.transform(rows.where(part)).select("label", "weight", "features").persist()
            for part in (F.col(fold_col) != fold, F.col(fold_col) == fold))
        try:
            with ThreadPoolExecutor(parallelism) as pool:
                models = list(pool.map(lambda one: one.fit(train), learners))
                if not all(isinstance(model, GrownTrees) for model in models):
                    return list(pool.map(lambda model: evaluator.evaluate(model.transform(held)), models))
            found = auc(materialise(candidate_scores(models, held)), keys=["candidate"]).collect()
            return [r["auc"] for r in sorted(found, key=lambda r: r["candidate"])]
        finally:
            train.unpersist()
            held.unpersist()

    with ThreadPoolExecutor(together) as pool:
        scores = np.mean(list(pool.map(measured_on, range(folds))), axis=0)
    prepared = Pipeline(stages=list(stages)).fit(rows)
    best = learners[int(np.argmax(scores))].fit(prepared.transform(rows))
    return PipelineModel(stages=[*prepared.stages, best]), scores.tolist()


def crossval_logistic(
    train: DataFrame, columns: Sequence[str], fold_col: str = "foldCol",
    grid: Iterable[float] = CROSSVAL_C, iterations: int = 2000, parallelism: int = 4, ident: str = "sample_id",
) -> Search:
    """Grid search over given group folds by AUC, refitted on all of train."""
    grid = list(grid)
    folds = train.agg(F.max(fold_col)).first()[0] + 1
    # A fit inside the search sees the other folds, so that is the count it divides by.
    n_rows = train.count() * (folds - 1) / folds
    weighted = with_balanced_weight(train).withColumns({c: F.col(c).cast("double") for c in columns})
    learner = logistic(1.0, 1, iterations, standardise=False)
    model, scores = _crossval(
        _impute_stages(columns, scale=True), learner, [{learner.regParam: 1.0 / (c * n_rows)} for c in grid],
        placed(weighted, ident), fold_col, folds, parallelism)
    return Search(model, grid[int(np.argmax(scores))], list(zip(grid, scores)))


def refit_logistic(
    df: DataFrame, columns: Sequence[str], c: float, iterations: int = 2000, ident: str = "sample_id"
):
    """The chosen setting fitted again, on train and validation together."""
    weighted = with_balanced_weight(df).withColumns({x: F.col(x).cast("double") for x in columns})
    learner = logistic(c, df.count(), iterations, standardise=False)
    return Pipeline(stages=[*_impute_stages(columns, scale=True), learner]).fit(placed(weighted, ident))


def random_tree_settings(draws: int = 20, seed: int = 42) -> list[dict]:
    """Seeded draws from fixed ranges: rounds 100-400, depth 2-5, step 0.01-0.1, row and
    column shares 0.6-0.9, rows per leaf 1-7, least gain 0-3 (scaled to a per-row gain)."""
    rng = np.random.default_rng(seed)
    return [
        {
            "rounds": int(rng.integers(100, 401)),
            "depth": int(rng.integers(2, 6)),
            "step": float(rng.uniform(0.01, 0.10)),
            "rows": float(rng.uniform(0.6, 0.9)),
            "columns": str(round(float(rng.uniform(0.6, 0.9)), 4)),
            "leaf": int(rng.integers(1, 8)),
            "gain": float(rng.uniform(0.0, 3.0)) / 1000.0,
        }
        for _ in range(draws)
    ]


def crossval_boosted(
    train: DataFrame, columns: Sequence[str], fold_col: str = "foldCol",
    settings: Sequence[dict] | None = None, parallelism: int = 4, seed: int = 42, ident: str = "sample_id",
) -> Search:
    """Random search over given group folds by AUC."""
    settings = random_tree_settings() if settings is None else list(settings)
    folds = train.agg(F.max(fold_col)).first()[0] + 1
    flat = train.withColumn("weight", F.lit(1.0)).withColumns({c: F.col(c).cast("double") for c in columns})
    learner = boosted(settings[0], seed)
    maps = [
        {
            learner.maxIter: s["rounds"], learner.maxDepth: s["depth"], learner.stepSize: s["step"],
            learner.subsamplingRate: s["rows"], learner.featureSubsetStrategy: s["columns"],
            learner.minInstancesPerNode: s["leaf"], learner.minInfoGain: s["gain"],
        }
        for s in settings
    ]
    rows = placed(flat, ident)
    # Small fits leave cores idle: there are as many at a time as there is room for.
    room = rows.sparkSession.sparkContext.defaultParallelism // rows.rdd.getNumPartitions()
    model, scores = _crossval(
        _impute_stages(columns, scale=False), learner, maps, rows, fold_col, folds, max(parallelism, room), folds)
    return Search(model, settings[int(np.argmax(scores))], list(zip(settings, scores)))


def report(model, folds: dict[str, DataFrame], name: str, cutoff: float = 0.5) -> DataFrame:
    """AUC, F1 and accuracy of one model on several folds, which have the same columns."""
    rows = union_all(*[df.withColumn("fold", F.lit(fold)) for fold, df in folds.items()])
    # The metrics read the scores several times; the model goes out and runs once.
    scored = materialise(score(model, rows).select("label", "score", "fold"))
    return binary_metrics(scored, "label", "score", cutoff, ["fold"]).select(
        F.lit(name).alias("model"), "fold",
        *[F.round(m, 4).alias(m) for m in ("auc", "f1", "accuracy")],
    )


def tree_importance(model, columns: Sequence[str]) -> DataFrame:
    """Share of each feature in the split gains of a fitted tree model."""
    values = model.featureImportances.toArray()
    rows = [(c, float(v)) for c, v in zip(columns, values)]
    table = SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")
