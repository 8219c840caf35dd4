"""Classification metrics as distributed aggregates. The positive class is pass (1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import hash_uniform
from .ordering import running_totals
from .resampling import resampled

FIRST_CUTOFF, LAST_CUTOFF = 10, 90  # hundredths


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where undefined."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2 * tp, 2 * tp + fp + fn)


def confusion(
    df: DataFrame, label: str = "label", pred: str = "pred", keys: Sequence[str] = (),
    weight: Column | None = None,
) -> DataFrame:
    """tn, fp, fn, tp per key: one map-side combined aggregate, four numbers per task."""
    w = F.lit(1).cast("long") if weight is None else weight

    def cell(y, p):
        return F.coalesce(F.sum(F.when((F.col(label) == y) & (F.col(pred) == p), w)), F.lit(0).cast("long"))

    return df.groupBy(*keys).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
        cell(1, 0).alias("fn"), cell(1, 1).alias("tp"),
    )


def f1_accuracy(df: DataFrame, label: str = "label", pred: str = "pred", keys: Sequence[str] = ()) -> DataFrame:
    tn, fp, fn, tp = map(F.col, ("tn", "fp", "fn", "tp"))
    return confusion(df, label, pred, keys).select(
        *keys, f1_of(tp, fp, fn).alias("f1"), _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy")
    )


def classification_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted means."""
    tn, fp, fn, tp = map(F.col, ("tn", "fp", "fn", "tp"))
    per_class = confusion(df, label, pred).select(
        _ratio(tn, tn + fn).alias("p0"), _ratio(tn, tn + fp).alias("r0"),
        f1_of(tn, fn, fp).alias("f0"), (tn + fp).alias("s0"),
        _ratio(tp, tp + fp).alias("p1"), _ratio(tp, tp + fn).alias("r1"),
        f1_of(tp, fp, fn).alias("f1"), (tp + fn).alias("s1"),
        _ratio(tp + tn, tp + tn + fp + fn).alias("acc"),
    )
    support = F.col("s0") + F.col("s1")

    def macro(m):
        return (F.col(f"{m}0") + F.col(f"{m}1")) / 2

    def weighted(m):
        return _ratio(F.col(f"{m}0") * F.col("s0") + F.col(f"{m}1") * F.col("s1"), support)

    blank = F.lit(None).cast("double")
    rows = [
        ("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        ("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        ("accuracy", blank, blank, F.col("acc"), support),
        ("macro avg", macro("p"), macro("r"), macro("f"), support),
        ("weighted avg", weighted("p"), weighted("r"), weighted("f"), support),
    ]
    return per_class.select(
        F.explode(
            F.array(*[
                F.struct(
                    F.lit(name).alias("class"), F.round(p, 6).alias("precision"),
                    F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"), s.alias("support"),
                )
                for name, p, r, f, s in rows
            ])
        ).alias("r")
    ).select("r.*")


def score_cells(
    df: DataFrame, label: str, score: str, keys: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """Positives and negatives per distinct score: a hot score is one row after this."""
    w = F.lit(1).cast("long") if weight is None else weight
    zero = F.lit(0).cast("long")
    return df.groupBy(*keys, F.col(score).cast("double").alias("_score")).agg(
        F.coalesce(F.sum(F.when(F.col(label) == 1, w)), zero).alias("pos"),
        F.coalesce(F.sum(F.when(F.col(label) == 0, w)), zero).alias("neg"),
    )


def auc(
    df: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = (),
    weight: Column | None = None,
) -> DataFrame:
    """ROC-AUC per key with mid-rank ties; a constant score gives 0.5, one class alone null."""
    ranked = running_totals(score_cells(df, label, score, keys, weight), "_score", ["pos", "neg"], keys)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    pairs = F.max("pos_total").cast("double") * F.max("neg_total")
    return ranked.groupBy(*keys).agg(F.try_divide(wins, pairs).alias("auc"))


def _metrics(
    cells: DataFrame, tp: Column, fp: Column, keys: Sequence[str]
) -> DataFrame:
    """AUC, F1 and accuracy from score cells with the hits and false alarms of each cell."""
    ranked = running_totals(cells, "_score", ["pos", "neg"], keys)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    zero = F.lit(0).cast("long")
    sums = ranked.groupBy(*keys).agg(
        wins.alias("wins"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        F.coalesce(F.sum(tp), zero).alias("tp"), F.coalesce(F.sum(fp), zero).alias("fp"),
    )
    p, n, tp, fp = map(F.col, ("p", "n", "tp", "fp"))
    return sums.select(
        *keys,
        F.try_divide(F.col("wins"), p.cast("double") * n).alias("auc"),
        f1_of(tp, fp, p - tp).alias("f1"),
        _ratio(tp + n - fp, p + n).alias("accuracy"),
        (p + n).alias("n_rows"),
    )


def binary_metrics(
    df: DataFrame, label: str = "label", score: str = "score", cutoff: Column | float = 0.5,
    keys: Sequence[str] = (),
) -> DataFrame:
    """AUC, F1 and accuracy per key, predicting pass where the score reaches the cutoff."""
    cut = cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff))
    hit = F.col("_score") >= cut
    cells = score_cells(df, label, score, keys)
    measured = _metrics(cells, F.when(hit, F.col("pos")), F.when(hit, F.col("neg")), list(keys))
    return measured.drop("n_rows")


def report_metrics(
    df: DataFrame, label: str = "label", pred: str = "pred", score: str = "score", keys: Sequence[str] = ()
) -> DataFrame:
    """AUC of the score, F1 and accuracy of a prediction made in any other way, row count.

    One grouping of the rows serves all of them.
    """
    called = F.col(pred) == 1
    cells = df.groupBy(*keys, F.col(score).cast("double").alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) == 0).alias("neg"),
        F.count_if((F.col(label) == 1) & called).alias("hits"),
        F.count_if((F.col(label) == 0) & called).alias("alarms"),
    )
    return _metrics(cells, F.col("hits"), F.col("alarms"), list(keys))


def _pr_points(df: DataFrame, label: str, score: str, keys: Sequence[str]) -> DataFrame:
    """Per distinct score: precision and recall at it and at the next higher score.

    Counts above a score follow from the totals, so no row has to look at its neighbour.
    """
    cells = running_totals(score_cells(df, label, score, keys), "_score", ["pos", "neg"], keys)
    at_tp = F.col("pos_total") - F.col("pos_below")
    at_all = at_tp + F.col("neg_total") - F.col("neg_below")
    up_tp = at_tp - F.col("pos")
    up_all = at_all - F.col("pos") - F.col("neg")
    return cells.select(
        *keys,
        F.col("_score").alias("threshold"),
        _ratio(at_tp, at_all).alias("precision"),
        _ratio(at_tp, F.col("pos_total")).alias("recall"),
        F.when(up_all == 0, 1.0).otherwise(_ratio(up_tp, up_all)).alias("up_precision"),
        _ratio(up_tp, F.col("pos_total")).alias("up_recall"),
    )


def pr_curve(df: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """Threshold, precision and recall per distinct score, plus the closing point (1, 0)."""
    points = _pr_points(df, label, score, keys).select(*keys, "threshold", "precision", "recall")
    closing = points.groupBy(*keys).agg(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(closing)


def pr_auc(df: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """Area under the precision-recall curve by the trapezoid rule."""
    slice_area = (
        (F.col("recall") - F.col("up_recall")) * (F.col("precision") + F.col("up_precision")) / 2
    )
    return _pr_points(df, label, score, keys).groupBy(*keys).agg(F.sum(slice_area).alias("pr_auc"))


def cutoff_index(score: Column) -> Column:
    """Largest k with k/100 <= score, from one floor and a check of its neighbours."""
    guess = F.floor(score * 100)
    return (
        F.when((guess + 1) / F.lit(100.0) <= score, guess + 1)
        .when(guess / F.lit(100.0) > score, guess - 1)
        .otherwise(guess)
    )


def cutoff_counts(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp and class totals at each of the 81 cutoffs 0.10 ... 0.90, per key.

    Rows fall into 82 buckets, combined before the shuffle; only bucket sums meet a window.
    """
    keys = list(keys)
    bucket = F.greatest(
        F.least(cutoff_index(F.col(score).cast("double")), F.lit(LAST_CUTOFF)), F.lit(FIRST_CUTOFF - 1)
    ).cast("int")
    counts = df.groupBy(*keys, bucket.alias("k")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    # Every cutoff of every key gets a zero row, so that empty buckets are present too.
    zero = F.lit(0).cast("long")
    grid = counts.select(*keys).distinct().select(
        *keys,
        F.explode(F.sequence(F.lit(FIRST_CUTOFF - 1), F.lit(LAST_CUTOFF))).alias("k"),
        zero.alias("pos"), zero.alias("neg"),
    ) if keys else df.sparkSession.range(FIRST_CUTOFF - 1, LAST_CUTOFF + 1).select(
        F.col("id").cast("int").alias("k"), zero.alias("pos"), zero.alias("neg")
    )
    filled = counts.unionByName(grid).groupBy(*keys, "k").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    everything = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    above = everything.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        filled.select(
            *keys, "k",
            F.sum("pos").over(above).alias("tp"),
            F.sum("neg").over(above).alias("fp"),
            F.sum("pos").over(everything).alias("n_pos"),
            F.sum("neg").over(everything).alias("n_neg"),
        )
        .where(F.col("k") >= FIRST_CUTOFF)
        .withColumn("threshold", F.col("k") / F.lit(100.0))
        .drop("k")
    )


def threshold_sweep(df: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """F1 at each cutoff."""
    tp, fp = F.col("tp"), F.col("fp")
    return cutoff_counts(df, label, score, keys).select(
        *keys, "threshold", f1_of(tp, fp, F.col("n_pos") - tp).alias("f1")
    )


def best_threshold(df: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """The cutoff of the highest F1, the lowest such cutoff on ties."""
    best = F.max(F.struct("f1", (-F.col("threshold")).alias("minus")))
    return threshold_sweep(df, label, score, keys).groupBy(*keys).agg(best.alias("b")).select(
        *keys, (-F.col("b.minus")).alias("threshold"), F.col("b.f1").alias("f1")
    )


def threshold_apply(
    validation: DataFrame, test: DataFrame, label: str = "label", score: str = "score"
) -> DataFrame:
    """Test metrics at 0.5 and at the cutoff that is best on validation."""
    tuned = best_threshold(validation, label, score).select("threshold").scalar()
    default = F.lit(0.5)

    def at(setting, cutoff):
        return binary_metrics(test, label, score, cutoff).select(
            F.lit(setting).alias("setting"), cutoff.alias("threshold"), "auc", "f1", "accuracy"
        )

    return at("default", default).unionByName(at("tuned", tuned))


def model_comparison(
    df: DataFrame, scores: Sequence[str], label: str = "label", cutoff: float = 0.5
) -> DataFrame:
    """AUC, F1 and accuracy of several score columns, best AUC first, from one scan."""
    tall = df.select(
        label,
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("score")) for s in scores])
        ).alias("r"),
    ).select(label, "r.*")
    return binary_metrics(tall, label, "score", cutoff, ["model"]).orderBy(F.desc("auc"), "model")


def family_metrics(
    df: DataFrame, families: DataFrame, cutoff: float = 0.39, label: str = "label", score: str = "score"
) -> DataFrame:
    """AUC and F1 on each family's rows at one fixed cutoff."""
    members = df.join(families, "model_name")
    return binary_metrics(members, label, score, cutoff, ["family"]).select("family", "auc", "f1")


def family_drop(in_family: DataFrame, held_out: DataFrame, families: DataFrame) -> DataFrame:
    """In-distribution against held-out results per family, with the loss.

    ``held_out``: family, n_test_rows, ood_auc, ood_f1, ood_threshold.
    """
    sizes = families.groupBy("family").agg(F.count("*").alias("n_models"))
    joined = in_family.join(held_out, "family").join(sizes, "family")
    return joined.select(
        "family",
        "n_models",
        "n_test_rows",
        F.round("auc", 4).alias("in_dist_auc"),
        F.round("ood_auc", 4).alias("ood_auc"),
        F.round(F.col("auc") - F.col("ood_auc"), 4).alias("auc_drop"),
        F.round("f1", 4).alias("in_dist_f1"),
        F.round("ood_f1", 4).alias("ood_f1"),
        F.round(F.col("f1") - F.col("ood_f1"), 4).alias("f1_drop"),
        F.round("ood_threshold", 2).alias("ood_threshold"),
        F.round(F.col("auc") * 100, 1).alias("full_pct"),
        F.round(F.col("ood_auc") * 100, 1).alias("loo_pct"),
    )


def _log_factorial(m: Column) -> Column:
    """ln m!, by the product up to 20 and Stirling's series (to 1e-13) beyond."""
    x = F.greatest(m, F.lit(1)).cast("double")
    series = (
        x * F.log(x) - x + F.log(2 * F.pi() * x) / 2
        + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    )
    return F.when(m <= 20, F.log(F.factorial(F.least(m, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def _poisson_draw(rate: Column, u: Column) -> Column:
    """Poisson count by inversion, at any rate: the mass of the mode, then of its neighbours on
    either side in turn, is taken off ``u`` until nothing is left. About sqrt(rate) steps."""
    mode = F.floor(rate).cast("long")
    mass = F.exp(mode * F.log(rate) - rate - _log_factorial(mode))
    start = F.struct(
        (u - mass).alias("left"), mass.alias("up"), mass.alias("down"), F.when(u < mass, mode).alias("k"))

    def step(s: Column, i: Column) -> Column:
        above, below = mode + i, mode - i
        up = s["up"] * rate / above
        down = F.when(below >= 0, s["down"] * (below + 1) / rate).otherwise(0.0)
        after_up = s["left"] - up
        found = F.when(after_up < 0, above).when(after_up - down < 0, below)
        return F.when(s["k"].isNotNull(), s).otherwise(F.struct(
            (after_up - down).alias("left"), up.alias("up"), down.alias("down"), found.alias("k")))

    # Beyond twelve deviations less mass is left than a double can tell from 1.
    steps = F.sequence(F.lit(1), (12 * F.sqrt(rate) + 20).cast("int"))
    return F.aggregate(steps, start, step, lambda s: F.coalesce(s["k"], mode))


def _poisson_cells(df: DataFrame, label: str, value: str, n_boot: int, seed) -> DataFrame:
    """Replicate weights as one Poisson(count) draw per (label, value) cell.

    Rows are grouped first, so the replicates multiply distinct values, not rows.
    """
    cells = df.groupBy(label, value).agg(F.count("*").alias("c"))
    spread = cells.withColumn(
        "replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_boot - 1).cast("long")))
    )
    names = [F.col("replicate"), F.col(label), F.col(value)]
    weight = _poisson_draw(F.col("c").cast("double"), hash_uniform(seed, *names))
    return spread.withColumn("w", weight).where(F.col("w") > 0)


def bootstrap_interval(
    df: DataFrame, metric: str, value: str, ident: str = "sample_id", label: str = "label",
    n_boot: int = 1000, seed=42, mode: str = "draws",
) -> DataFrame:
    """Point value and 2.5 / 97.5 percentiles of a metric over resamples.

    ``metric`` is ``auc`` (``value`` is a score), ``f1`` or ``accuracy`` (``value`` is a
    0/1 prediction). ``mode="draws"`` resamples n rows of n exactly (see :mod:`resampling`);
    ``mode="poisson"`` weights distinct values. Resamples that have no metric value are
    ignored; rows without a value take no part.
    """
    if metric not in ("auc", "f1", "accuracy"):
        raise ValueError(f"unknown metric {metric!r}")
    tn, fp, fn, tp = map(F.col, ("tn", "fp", "fn", "tp"))
    formula = (f1_of(tp, fp, fn) if metric == "f1" else _ratio(tp + tn, tp + tn + fp + fn)).alias(metric)
    known = df.where(F.col(value).isNotNull())
    point = auc(known, label, value) if metric == "auc" else confusion(known, label, value).select(formula)
    if mode == "draws":
        cells = score_cells(known, label, value).withColumnRenamed("_score", "score")
        sums = resampled(cells, n_boot, seed).groupBy("replicate").agg(
            *[F.sum(c).alias(c) for c in ("pos", "neg", "tp", "fp")],
            F.sum(F.col("won") + F.col("pos") * F.col("lower")).alias("won"))
        if metric == "auc":
            replicates = sums.select("replicate", F.try_divide("won", F.col("pos").cast("double") * F.col("neg")).alias("auc"))
        else:
            drawn = sums.select("replicate", "tp", "fp", (F.col("pos") - tp).alias("fn"), (F.col("neg") - fp).alias("tn"))
            replicates = drawn.select("replicate", formula)
    elif mode == "poisson":
        cells = _poisson_cells(known, label, value, n_boot, seed)
        replicates = (
            auc(cells, label, value, ["replicate"], F.col("w")) if metric == "auc"
            else confusion(cells, label, value, ["replicate"], F.col("w")).select("replicate", formula))
    else:
        raise ValueError(f"unknown bootstrap mode {mode!r}")

    # One value per replicate: n_boot numbers, whatever the size of the data.
    bounds = replicates.agg(F.percentile(metric, F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    ends = bounds.select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    return ends.select(
        F.lit(metric).alias("metric"), point.select(metric).scalar().alias("point"), "low", "high"
    )
