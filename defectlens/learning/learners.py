"""MLlib's tree learners, grown inside tasks (:mod:`growing`) as long as the rows of a fit fit into one.

A fit finds thresholds, bins its rows in parallel and writes them, a byte a column; one task reads them
back and grows the trees, and the model is MLlib's own, read from its stored form. A fit of more than
``IN_TASK_BYTES`` is left to MLlib, which sends a job over all rows for every level of every tree.
"""

from __future__ import annotations

import json
import math
import threading
import time
import uuid
import weakref
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.shipping import ship_by_value
from ..session import materialise, release_read, scratch_folder
from .growing import _CELLS, Dense, Rules, Sparse, binned as bins_of, boost, entries, thresholds

ship_by_value(__name__)

#: What the rows of a fit may take in a task; two tasks of an executor of 3 GB hold this and a JVM.
IN_TASK_BYTES = 600 << 20
#: Columns up to which rows hold all of them, what a row takes besides its bins, and what an entry takes where they do not.
DENSE_COLUMNS, ROW_BYTES, ENTRY_BYTES = 256, 100, 24
#: Rows that thresholds are looked for in, at least, as in MLlib.
THRESHOLD_ROWS = 10_000

_NODE = pa.struct([
    ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
    ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
    ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())]))])
_NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
          "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


@dataclass
class Binned:
    """The rows of a fit as a written table of bins, or None if they are too many for a task."""

    rows: DataFrame | None
    limits: list | None
    width: int


_known: weakref.WeakKeyDictionary[DataFrame, Binned] = weakref.WeakKeyDictionary()
_looked = threading.Lock()


def binned(dataset: DataFrame, features: str, label: str, weight: str | None, bins: int) -> Binned:
    """The bins of a frame, found once as long as it is held."""
    with _looked:
        if dataset not in _known:
            _known[dataset] = found = _binned(dataset, features, label, weight, bins)
            if found.rows is not None:
                weakref.finalize(dataset, release_read, found.rows).atexit = False
        return _known[dataset]


def _binned(dataset: DataFrame, features: str, label: str, weight: str | None, bins: int) -> Binned:
    given = dataset.select(
        F.monotonically_increasing_id().alias("number"), F.col(label).cast("double").alias("label"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"), F.col(features).alias("features"))
    about = given.agg(F.count("*").alias("n"), F.count_if(~F.col("label").isin(0.0, 1.0)).alias("other"),
                      F.max(F.size(vector_to_array("features"))).alias("width")).first()
    n, width = about["n"], about["width"]
    if not n or about["other"] or (width <= DENSE_COLUMNS and n * (width + ROW_BYTES) > IN_TASK_BYTES):
        return Binned(None, None, width or 0)
    some = max(bins * bins, THRESHOLD_ROWS)
    sampled = given if n <= some else given.where(F.pmod(F.xxhash64("number"), F.lit(1 << 30)) < int(some / n * (1 << 30)))
    limits = [np.empty(0)] * width
    found = sampled.select("weight", "features").coalesce(1).mapInArrow(_thresholds(width, min(bins, n)), "at int, limits array<double>")
    for row in found.collect():  # at most the number of bins for each column
        limits[row["at"]] = np.array(row["limits"])
    shared = dataset.sparkSession.sparkContext.broadcast(limits)
    rows = materialise(given.mapInArrow(
        _bins(shared, width), "number bigint, label double, weight double, columns array<int>, bins binary"))
    if width > DENSE_COLUMNS:
        size = rows.agg(F.sum(ENTRY_BYTES * F.octet_length("bins") + ROW_BYTES)).first()[0]
        if size > IN_TASK_BYTES:
            release_read(rows)
            return Binned(None, None, width)
    return Binned(rows, limits, width)


def _thresholds(width, bins):
    def find(batches):
        parts, total = [], 0.0
        for batch in batches:
            rows, columns, values = entries(batch.column("features"))
            weights = batch.column("weight").to_numpy()
            total += weights.sum()
            kept = values != 0
            parts.append((columns[kept].astype(np.int32), values[kept], weights[rows[kept]]))
        columns, values, weights = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0) for i in range(3))
        found = thresholds(columns, values, weights, total, width, bins)
        yield pa.RecordBatch.from_pydict({
            "at": pa.array(range(width), pa.int32()), "limits": pa.array([x.tolist() for x in found], pa.list_(pa.float64()))})

    return find


def _bins(shared, width):
    def find(batches):
        limits = shared.value
        zero = bins_of(np.arange(width), np.zeros(width), limits)
        for batch in batches:
            n = batch.num_rows
            rows, columns, values = entries(batch.column("features"))
            codes = bins_of(columns, values, limits)
            if width <= DENSE_COLUMNS:
                full = np.tile(zero, (n, 1))
                full[rows, columns] = codes
                bins, ends, kept = full.ravel(), np.arange(n + 1) * width, None
            else:
                kept = codes != zero[columns]
                rows, columns, bins = rows[kept], columns[kept], codes[kept]
                ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n))))
            offsets = pa.array(ends, pa.int32())
            listed = pa.nulls(n, pa.list_(pa.int32())) if kept is None else pa.ListArray.from_arrays(offsets, pa.array(columns.astype(np.int32)))
            packed = pa.Array.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(bins).tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("number"), batch.column("label"), batch.column("weight"), listed, packed],
                names=["number", "label", "weight", "columns", "bins"])

    return find


def stored_rows(batches, limits):
    """Number, label and weight of the rows of a task, and their bins."""
    width, plain, bins, columns, sizes = len(limits), [], [], [], []
    for batch in batches:
        plain.append([batch.column(c).to_numpy() for c in ("number", "label", "weight")])
        packed = batch.column("bins")
        ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1]
        flat = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0]:ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
        if width <= DENSE_COLUMNS:
            bins.append(np.ascontiguousarray(flat.reshape(len(packed), width).T))
        else:
            bins.append(flat.copy())
            columns.append(batch.column("columns").flatten().to_numpy())
            sizes.append(np.diff(ends))
    number, label, weight = (np.concatenate([p[i] for p in plain]) for i in range(3))
    n_splits = np.array([len(x) for x in limits])
    if width <= DENSE_COLUMNS:
        return number, label, weight, Dense(np.concatenate(bins, axis=1), n_splits)
    starts = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    zero = bins_of(np.arange(width), np.zeros(width), limits)
    return number, label, weight, Sparse(starts, np.concatenate(columns), np.concatenate(bins), zero, n_splits)


def node_batch(at: int, tree: dict, limits) -> pa.RecordBatch:
    """A tree in MLlib's stored form; ``stats`` are what its impurity is made of."""
    n, inner = len(tree["left"]), tree["left"] >= 0
    column, split = np.where(inner, tree["column"], -1), tree["split"]
    bounds = [[float(limits[c][s])] if c >= 0 else [] for c, s in zip(column, split)]
    splits = pa.StructArray.from_arrays(
        [pa.array(column.astype(np.int32)), pa.array(bounds, pa.list_(pa.float64())), pa.array(np.full(n, -1, np.int32))],
        fields=list(_NODE.field("split").type))
    stats = tree["stats"]
    listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * stats.shape[1], pa.int32()), pa.array(stats.ravel()))
    nodes = pa.StructArray.from_arrays([
        pa.array(np.arange(n, dtype=np.int32)), pa.array(tree["value"]), pa.array(tree["impurity"]), listed,
        pa.array(np.rint(tree["rows"]).astype(np.int64)), pa.array(np.where(inner, tree["gain"], -1.0)),
        pa.array(tree["left"].astype(np.int32)), pa.array(tree["right"].astype(np.int32)), splits], fields=list(_NODE))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, at, np.int32)), nodes], names=["treeID", "nodeData"])


class _Writer(MLWriter):
    """MLlib's stored form of a model, without a model of the JVM."""

    def __init__(self, model: GrownTrees):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model, spark = self.model, self.sparkSession
        learner, about = model.learner, {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
        params, defaults = ({p.name: v for p, v in known.items()} for known in (learner._paramMap, learner._defaultParamMap))
        whole = {"class": "org.apache.spark.ml.classification.GBTClassificationModel", **about, "uid": model.uid, "paramMap": params,
                 "defaultParamMap": defaults, "numFeatures": model.width, "numTrees": len(model.weights)}
        kept = {"maxDepth": learner.getMaxDepth(), "seed": learner.getSeed()}
        each = {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", **about, "uid": f"tree_{uuid.uuid4().hex[:12]}",
                "paramMap": kept, "defaultParamMap": {}, "numFeatures": model.width}
        spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        weights = [(i, json.dumps(each), w) for i, w in enumerate(model.weights)]
        spark.createDataFrame(weights, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        spark.createDataFrame(model.nodes).coalesce(1).write.parquet(f"{path}/data")


class GrownTrees(GBTClassificationModel):
    """A fitted model as a table of its nodes, at most rounds * 2 ** (depth + 1). It becomes a model of the JVM
    when it is asked for what only that can tell; what a search asks of its candidates is told from the table."""

    def __init__(self, learner: BoostedTrees, nodes: pa.Table, width: int, rounds: int):
        self.learner, self.nodes, self.width = learner, nodes, width
        self.weights = [1.0] + [learner.getStepSize()] * (rounds - 1)
        self._loaded = None
        self._loading = threading.Lock()
        super().__init__(None)
        self._resetUid(learner.uid)

    @property
    def _java_obj(self):
        with self._loading:
            if self._loaded is None:
                path = f"{scratch_folder(SparkSession.active()).rstrip('/')}/trees-{uuid.uuid4().hex}"
                _Writer(self).save(path)
                self._loaded = GBTClassificationModel.load(path)
        return self._loaded._java_obj

    @_java_obj.setter
    def _java_obj(self, _):
        """The JVM's model belongs to ``_loaded``."""

    def __del__(self):
        """As above."""

    @property
    def trees(self) -> list:  # not a cached property: looking for parameters would ask for it
        return self._java_obj and self._loaded.trees

    def copy(self, extra=None):
        self._java_obj  # noqa: B018
        return self._loaded.copy(extra)

    def write(self) -> MLWriter:
        return _Writer(self)

    def first(self, rounds: int) -> GrownTrees:
        """The model of the first trees."""
        kept = self.nodes.filter(pc.less(self.nodes["treeID"], rounds))
        return self.learner._copyValues(GrownTrees(self.learner, kept, self.width, rounds))

    def trees_by_row(self, weighted: bool = True) -> list:
        """Column, threshold, left, right and value of the nodes of each tree, values with their weight or without."""
        flat = self.nodes.sort_by("treeID").combine_chunks()
        ids = flat["treeID"].to_numpy()
        node = flat["nodeData"].combine_chunks()
        split = node.field("split")
        bounds = split.field("leftCategoriesOrThreshold")
        column, limit = split.field("featureIndex").to_numpy(), np.zeros(len(ids))
        limit[column >= 0] = bounds.flatten().to_numpy()
        parts = [column, limit, node.field("leftChild").to_numpy(), node.field("rightChild").to_numpy(), node.field("prediction").to_numpy()]
        ends = np.searchsorted(ids, np.arange(len(self.weights) + 1))
        return [[*(p[lo:hi] for p in parts[:4]), parts[4][lo:hi] * (w if weighted else 1.0)] for lo, hi, w in zip(ends[:-1], ends[1:], self.weights)]

    def evaluateEachIteration(self, dataset: DataFrame) -> list[float]:
        learner = self.learner
        weight = F.col(learner.getWeightCol()) if learner.isDefined(learner.weightCol) else F.lit(1.0)
        rows = dataset.select(F.col(learner.getLabelCol()).cast("double").alias("label"), weight.cast("double").alias("weight"),
                              F.col(learner.getFeaturesCol()).alias("features"))
        trees = dataset.sparkSession.sparkContext.broadcast(self.trees_by_row())

        def losses(batches):
            sums, total = 0.0, 0.0
            for batch in batches:
                signs, weights = 2.0 * batch.column("label").to_numpy() - 1.0, batch.column("weight").to_numpy()
                margins = np.cumsum(tree_values(batch.column("features"), trees.value), axis=0)
                sums = sums + np.logaddexp(0.0, -2.0 * signs * margins) @ weights * 2.0
                total += weights.sum()
            if total:
                yield pa.RecordBatch.from_pydict({"sums": pa.array([sums.tolist()], pa.list_(pa.float64())), "total": pa.array([total])})

        parts = rows.mapInArrow(losses, "sums array<double>, total double").collect()  # a row a task
        return (np.sum([p["sums"] for p in parts], axis=0) / sum(p["total"] for p in parts)).tolist()


def candidate_scores(models: Sequence[GrownTrees], rows: DataFrame) -> DataFrame:
    """(candidate, label, score): the probability of pass of each row under each model, in one pass."""
    learner = models[0].learner
    trees = rows.sparkSession.sparkContext.broadcast([model.trees_by_row() for model in models])
    given = rows.select(F.col(learner.getLabelCol()).cast("int").alias("label"), F.col(learner.getFeaturesCol()).alias("features"))

    def scores(batches):
        for batch in batches:
            for at, mine in enumerate(trees.value):
                margin = tree_values(batch.column("features"), mine).sum(0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, at, np.int32)), batch.column("label"), pa.array(passing(margin))],
                    names=["candidate", "label", "score"])

    return given.mapInArrow(scores, "candidate int, label int, score double")


def passing(margin: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-2.0 * margin))


def tree_values(vectors, trees) -> np.ndarray:
    """The weighted value of each row's leaf in each tree, tree by row."""
    used = np.unique(np.concatenate([t[0][t[0] >= 0] for t in trees] or [np.empty(0, int)]))
    rows, columns, values = entries(vectors)
    n, found = len(vectors), np.empty((len(trees), len(vectors)))
    place = np.searchsorted(used, columns)
    kept = np.flatnonzero((place < len(used)) & (used[np.minimum(place, max(len(used) - 1, 0))] == columns)) if len(used) else np.empty(0, int)
    rows, place, values = rows[kept], place[kept], values[kept]
    step = max(1, _CELLS // max(1, len(used)))  # rows that are made dense at a time
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        a, b = np.searchsorted(rows, [lo, hi])
        full = np.zeros((hi - lo, max(1, len(used))))
        full[rows[a:b] - lo, place[a:b]] = values[a:b]
        for at, (column, limit, left, right, value) in enumerate(trees):
            mine, nodes, every = np.searchsorted(used, np.maximum(column, 0)), np.zeros(hi - lo, np.int64), np.arange(hi - lo)
            while len(open_ := every[left[nodes] >= 0]):
                here = nodes[open_]
                nodes[open_] = np.where(full[open_, mine[here]] <= limit[here], left[here], right[here])
            found[at, lo:hi] = value[nodes]
    return found


def _named_columns(strategy: str, width: int) -> int | None:
    """How many columns a split may choose from, or None for a strategy that is not known here."""
    if strategy == "all":
        return width
    if strategy == "sqrt":
        return max(1, math.ceil(math.sqrt(width)))
    if "." in strategy and 0 < float(strategy) <= 1:
        return max(1, math.ceil(float(strategy) * width))
    return None


def grown_rows(store, label, weight, number, settings, earlier=()):
    """The trees of a fit after ``earlier`` ones, with what the stored form of a node has."""
    for tree in boost(store, label, weight, number, *settings, earlier):
        tree["stats"] = np.stack([tree["weight"], tree["sum"], tree["squares"]], axis=1)
        mean = np.where(tree["weight"] > 0, tree["squares"] / np.maximum(tree["weight"], 1e-300), 0.0)
        tree["impurity"] = np.maximum(mean - tree["value"] ** 2, 0.0)
        yield tree


class BoostedTrees(GBTClassifier):
    """:class:`GBTClassifier`, each fit of which is one task where that holds its rows."""

    #: A shorter fit of the same settings on the same frame: this one goes on from its trees.
    earlier: GrownTrees | None = None

    def binned(self, dataset: DataFrame) -> Binned:
        weight = self.getWeightCol() if self.isDefined(self.weightCol) else None
        return binned(dataset, self.getFeaturesCol(), self.getLabelCol(), weight, self.getMaxBins())

    def settings(self, width: int) -> tuple | None:
        """What the growing of trees takes, or None if that does not know these settings."""
        strategy = self.getFeatureSubsetStrategy()
        columns = _named_columns("all" if strategy == "auto" else strategy, width)
        if columns is None or self.isDefined(self.validationIndicatorCol) or self.getMinWeightFractionPerNode() or self.getMaxBins() > 256:
            return None
        rules = Rules(self.getMaxDepth(), self.getMinInstancesPerNode(), self.getMinInfoGain(), columns, self.getSeed())
        return rules, self.getMaxIter(), self.getStepSize(), self.getSubsamplingRate()

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        known = self.binned(dataset)
        settings = self.settings(known.width)
        if known.rows is None or settings is None:
            return super()._fit(dataset)
        limits, before, earlier = known.limits, self.earlier, []
        if before is not None:
            for column, limit, left, right, value in before.trees_by_row(weighted=False):
                split = np.array([np.searchsorted(limits[c], x) if c >= 0 else -1 for c, x in zip(column, limit)])
                earlier.append((column, split, left, right, value))

        def grow(batches):
            number, label, weight, store = stored_rows(batches, limits)
            for at, tree in enumerate(grown_rows(store, label, weight, number, settings, earlier), len(earlier)):
                yield node_batch(at, tree, limits)

        # At most rounds * 2 ** (depth + 1) nodes come back.
        nodes = known.rows.coalesce(1).mapInArrow(grow, _NODES).toArrow()
        if before is not None:
            nodes = pa.concat_tables([before.nodes, nodes.cast(before.nodes.schema)])
        return self._copyValues(GrownTrees(self, nodes, known.width, self.getMaxIter()))

