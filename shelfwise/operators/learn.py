"""Model search, classifiers and self-training on Spark ML.

Tables carry (row_id, features vector, label int); predictions add
``prediction`` and the probability array ``p``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import MinMaxScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from shelfwise.functions.vectors import argmax
from shelfwise.operators import metrics as M
from shelfwise.operators.balance import oversample, with_class_weight
from shelfwise.operators.features import important_features
from shelfwise.operators.kernels import Discriminant, FourierMap, LinearMargins, Neighbours
from shelfwise.operators.relational import union_all
from shelfwise.operators.sampling import labeled_fraction, stratified_kfold, stratified_split
from shelfwise.session import materialize

# -- classifiers --------------------------------------------------------------
TREE_KINDS = ("RandomForest", "Bagging", "DecisionTree", "BoostedTrees")
#: class models of one fit that run at the same time
CLASS_MODELS = 8
#: of a written table, read by one task of a fit
TASK_BYTES = 4 << 20
#: rows of a file that fits read, so that large tables are read by many tasks
FILE_ROWS = 8_192
#: steps of a sweep, not bound by its order, that run at the same time
SWEEP_FITS = 8


def _forest(p, seed, weight):
    est = RandomForestClassifier(seed=seed, **p)
    return est.setWeightCol(weight) if weight else est


def _bagging(p, seed, weight):
    return _forest({"featureSubsetStrategy": "all", **p}, seed, weight)


def _tree(p, seed, weight):
    est = DecisionTreeClassifier(seed=seed, **p)
    return est.setWeightCol(weight) if weight else est


def _boosted(p, seed, weight):
    est = OneVsRest(classifier=GBTClassifier(seed=seed, **p), parallelism=CLASS_MODELS)
    return est.setWeightCol(weight) if weight else est


def _svm(p, seed, weight):
    est = LinearMargins(**p)
    return est.setWeightCol(weight) if weight else est


def _mlp(p, seed, weight):
    return MultilayerPerceptronClassifier(seed=seed, **p)


def _logistic(p, seed, weight):
    est = LogisticRegression(**p)
    return est.setWeightCol(weight) if weight else est


def _bayes(p, seed, weight):
    est = NaiveBayes(**{"modelType": "gaussian", **p})
    return est.setWeightCol(weight) if weight else est


def _linear_discriminant(p, seed, weight):
    est = Discriminant(**p)
    return est.setWeightCol(weight) if weight else est


def _quadratic_discriminant(p, seed, weight):
    return _linear_discriminant({"quadratic": True, "ridge": 1e-6, **p}, seed, weight)


def _neighbours(p, seed, weight):
    return Neighbours(**p)


CLASSIFIERS: dict[str, Callable] = {
    "RandomForest": _forest,
    "BoostedTrees": _boosted,
    "DecisionTree": _tree,
    "SVM": _svm,
    "NeuralNetwork": _mlp,
    "Bagging": _bagging,
    "LogisticRegression": _logistic,
    "NaiveBayes": _bayes,
    "KernelSVM": _svm,
    "LinearDiscriminant": _linear_discriminant,
    "QuadraticDiscriminant": _quadratic_discriminant,
    "KNN": _neighbours,
}
#: kinds fitted as one margin per class
MARGINS = ("BoostedTrees", "SVM", "KernelSVM")


class Fitted:
    """A fitted classifier whose ``transform`` always yields probabilities."""

    def __init__(self, kind: str, model, scaler=None, selected: list[int] | None = None):
        self.kind, self.model, self.scaler, self.selected = kind, model, scaler, selected

    def _view(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("__x", F.col("features"))
        if self.selected is not None:
            out = VectorSlicer(inputCol="features", outputCol="__s", indices=self.selected).transform(out)
            out = out.withColumn("__x", F.col("__s")).drop("__s")
        if self.scaler is not None:
            out = self.scaler.transform(out).withColumn("__x", F.col("__z")).drop("__z")
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self._view(df)
        if self.kind in MARGINS:
            # the margin of each class model, logistic, then normalised
            margins = []
            for i, m in enumerate(self.model.models if self.kind == "BoostedTrees" else ()):
                m.setFeaturesCol("__x").setPredictionCol(f"__pred{i}").setRawPredictionCol(f"__raw{i}")
                if m.hasParam("probabilityCol"):
                    m.setProbabilityCol(f"__prob{i}")
                scored = m.transform(scored)
                margins.append(vector_to_array(f"__raw{i}")[1])
            scored = scored.withColumn("__m", F.array(*margins) if margins else self.model.margins("__x"))
            odds = F.transform("__m", lambda m: 1 / (1 + F.exp(-m)))
            total = F.aggregate("__o", F.lit(0.0), lambda s, x: s + x)
            scored = scored.withColumn("__o", odds).withColumn("p", F.transform("__o", lambda x: x / total))
        else:
            scored = self.model.transform(scored).withColumn("p", vector_to_array("__prob"))
        return scored.select(*df.columns, argmax("p").alias("prediction"), "p")

    def importances(self) -> list[float]:
        """Per feature; of boosted trees the mean over the class models."""
        models = self.model.models if self.kind == "BoostedTrees" else [self.model]
        return np.mean([m.featureImportances.toArray() for m in models], axis=0).tolist()


def _columns(est, kind: str):
    est = est.setFeaturesCol("__x").setLabelCol("__y").setPredictionCol("__pred")
    if kind in MARGINS:
        return est
    return est.setRawPredictionCol("__raw").setProbabilityCol("__prob")


def fit_classifier(
    kind: str,
    df: DataFrame,
    params: Mapping | None = None,
    label: str = "label",
    balanced: bool = False,
    seed: int = 42,
    selected: list[int] | None = None,
) -> Fitted:
    """Fit one classifier; ``balanced`` weights rows by inverse class size.

    The neural network gets its features scaled to [0, 1] and, unless given,
    one hidden layer. The kernel SVM gets random Fourier features; ``gamma`` and
    ``n_features`` are theirs.
    """
    params = dict(params or {})
    shell = Fitted(kind, None, None, selected)
    data = shell._view(df.filter(F.col(label).isNotNull())).withColumn("__y", F.col(label).cast("double"))
    if kind == "NeuralNetwork":
        shell.scaler = MinMaxScaler(inputCol="__x", outputCol="__z").fit(data)
        data = shell.scaler.transform(data).withColumn("__x", F.col("__z")).drop("__z")
        if "layers" not in params:
            size = data.select(F.size(vector_to_array("__x")).alias("w"), "__y")
            shape = size.agg(F.max("w").alias("w"), (F.max("__y") + 1).cast("int").alias("k")).first()
            params["layers"] = [shape["w"], 16, shape["k"]]
    if kind == "KernelSVM":
        params["lift"] = FourierMap.fit(data, "__x", params.pop("gamma", None), params.pop("n_features", 512), seed)
    weight = None
    if balanced and kind not in ("NeuralNetwork", "KNN"):
        data = with_class_weight(data, "__y", "__w")
        weight = "__w"
    shell.model = _columns(CLASSIFIERS[kind](params, seed, weight), kind).fit(data)
    return shell


def as_vectors(df: DataFrame, vec: str = "features") -> DataFrame:
    """Array features to ML vectors."""
    if isinstance(df.schema[vec].dataType, T.ArrayType):
        return df.withColumn(vec, array_to_vector(F.col(vec).cast("array<double>")))
    return df


# -- search and cross validation -------------------------------------------------
def _few_tasks(df: DataFrame) -> DataFrame:
    """A written table in tasks of about ``TASK_BYTES``: iterative fits read it
    hundreds of times, and each task of a small table costs more than its rows."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(max(1, -(-size // TASK_BYTES)))


def accuracy(df: DataFrame, label: str = "label") -> float:
    return df.agg(F.avg((F.col(label) == F.col("prediction")).cast("double"))).first()[0]


def _folded(df: DataFrame, folds: int, label: str, seed: int, key: str) -> DataFrame:
    """Rows with their fold, kept until they are unpersisted."""
    rows = materialize(stratified_kfold(df.select(key, "features", label), label, folds, seed, key), "folds")
    return _few_tasks(rows).persist(StorageLevel.MEMORY_AND_DISK)


def cross_validate(
    kind: str,
    df: DataFrame,
    draws: Sequence[Mapping],
    folds: int = 5,
    label: str = "label",
    balanced: bool = False,
    seed: int = 42,
    key: str = "row_id",
    parallelism: int = 6,
    oversampling: str | None = None,
    folded: DataFrame | None = None,
) -> DataFrame:
    """(draw, params, fold, score, fit_time, score_time) for every draw and fold.

    Folds are stratified and fixed before anything else; ``oversampling`` adds
    synthetic rows to the training folds only. ``folded`` may give the rows of
    :func:`_folded`, where several searches share them.
    """
    own = folded is None
    if own:
        folded = _folded(df, folds, label, seed, key)

    def training(f: int) -> DataFrame:
        train = folded.filter(F.col("fold") != f)
        if oversampling is None:
            return train
        arrays = train.select(key, label, vector_to_array("features").alias("features"))
        return as_vectors(materialize(oversample(arrays, label, oversampling, key), "oversampled"))

    train_sets = [training(f) for f in range(folds)]

    def one(task):
        i, f = task
        t0 = time.time()
        model = fit_classifier(kind, train_sets[f], draws[i], label, balanced, seed)
        t1 = time.time()
        score = accuracy(model.transform(folded.filter(F.col("fold") == f)), label)
        return (i, {k: str(v) for k, v in draws[i].items()}, f, score, t1 - t0, time.time() - t1)

    tasks = [(i, f) for i in range(len(draws)) for f in range(folds)]
    with ThreadPool(parallelism) as pool:
        rows = pool.map(one, tasks)
    if own:
        folded.unpersist()
    schema = "draw int, params map<string,string>, fold int, score double, fit_time double, score_time double"
    return df.sparkSession.createDataFrame(rows, schema)


def cv_results(scores: DataFrame, by: Sequence[str] = ("draw",)) -> DataFrame:
    """Per draw: mean and population std of fold scores, times, and rank (1 =
    best, equal means share a rank)."""
    per = scores.groupBy(*by).agg(
        F.avg("score").alias("mean_test_score"),
        F.stddev_pop("score").alias("std_test_score"),
        F.avg("fit_time").alias("mean_fit_time"),
        F.avg("score_time").alias("mean_score_time"),
    )
    search = list(by)[:-1]
    # one row per draw of a search meets in this window
    w = W.partitionBy(*search).orderBy(F.desc(F.round("mean_test_score", 12)))
    return per.withColumn("rank_test_score", F.rank().over(w))


def cv_table(scores: DataFrame, folds: int, params: Sequence[str] = (), by: Sequence[str] = ("draw",)) -> DataFrame:
    """:func:`cv_results` with the std of times, one column per fold
    (``split0_test_score`` ...) and, where ``scores`` has a ``params`` map, one per
    parameter (``param_...``)."""
    by = list(by)
    more = [F.stddev_pop("fit_time").alias("std_fit_time"), F.stddev_pop("score_time").alias("std_score_time")]
    more += [F.max(F.when(F.col("fold") == f, F.col("score"))).alias(f"split{f}_test_score") for f in range(folds)]
    more += [F.max(F.try_element_at("params", F.lit(p))).alias(f"param_{p}") for p in params]
    return cv_results(scores, by).join(scores.groupBy(*by).agg(*more), by)


def random_search(
    kind: str, df: DataFrame, draws: Sequence[Mapping], folds: int = 5, **kw
) -> tuple[Mapping, DataFrame]:
    """(best draw, cv table): cross-validate sampled parameter sets."""
    scores = materialize(cross_validate(kind, df, draws, folds, **kw), "cv")
    best = cv_results(scores).orderBy("rank_test_score", "draw").first()
    return draws[best["draw"]], scores


def refit_best(
    kind: str, df: DataFrame, draws: Sequence[Mapping], folds: int = 5, label: str = "label", balanced: bool = False,
    seed: int = 42, **kw,
) -> tuple[Fitted, Mapping, DataFrame]:
    """(model, best draw, cv table): the search's best draw, fitted on all of ``df``."""
    best, scores = random_search(kind, df, draws, folds, label=label, balanced=balanced, seed=seed, **kw)
    return fit_classifier(kind, df, best, label, balanced, seed), best, scores


def cross_val_score(kind: str, df: DataFrame, folds: int = 5, params: Mapping | None = None, **kw) -> dict:
    """Mean accuracy over the folds, or the error text of a failed fit."""
    try:
        scores = cross_validate(kind, df, [dict(params or {})], folds, **kw)
        return {"model": kind, "cv_score": scores.agg(F.avg("score")).first()[0], "error": None}
    except Exception as e:  # a bake-off reports failures instead of stopping
        return {"model": kind, "cv_score": None, "error": str(e)}


def model_bakeoff(
    df: DataFrame,
    models: Mapping[str, Mapping],
    label: str = "label",
    test: float = 0.2,
    folds: int = 3,
    seed: int = 42,
    key: str = "row_id",
    balanced: bool = False,
    parallelism: int = 12,
) -> tuple[DataFrame, DataFrame]:
    """(scores, predictions) of every classifier on one stratified split, with
    its cross-validated accuracy, best first; ``parallelism`` of them at a time, each
    with its folds beside it. All share the folds, which are kept once."""
    train, hold = stratified_split(df, label, 1 - test, seed, key)
    train, hold = (_few_tasks(materialize(x.hint("rebalance"), "bakeoff")) for x in (train, hold))
    folded = _folded(train, folds, label, seed, key)
    shared = {"label": label, "seed": seed, "key": key, "parallelism": folds, "folded": folded}

    def one(item):
        kind, params = item
        t0 = time.time()
        with ThreadPool(1) as beside:
            wait = beside.apply_async(cross_val_score, (kind, train, folds, params), shared)
            model = fit_classifier(kind, train, params, label, balanced, seed)
            out = materialize(model.transform(hold).select(key, label, "prediction"), "preds")
            m = M.label_metrics(M.confusion_counts(out, (), label, "prediction")).first()
            cv = wait.get()
        row = (kind, m["accuracy"], m["balanced_accuracy"], m["f1"], cv["cv_score"], cv["error"], time.time() - t0)
        return row, out.select(F.lit(kind).alias("model"), key, label, "prediction")

    with ThreadPool(parallelism) as pool:
        done = pool.map(one, models.items(), chunksize=1)
    folded.unpersist()
    rows, preds = [r for r, _ in done], [p for _, p in done]
    schema = "model string, accuracy double, balanced_accuracy double, f1 double, cv_score double, error string, seconds double"
    scores = df.sparkSession.createDataFrame(rows, schema)
    return scores.orderBy(F.desc("accuracy"), "model"), union_all(*preds)


# -- self-training -----------------------------------------------------------------
def accept_confident(scored: DataFrame, threshold: float, inclusive: bool = False) -> DataFrame:
    """Flag rows whose largest probability exceeds (or reaches) the threshold."""
    top = F.array_max("p")
    hit = top >= F.lit(threshold) if inclusive else top > F.lit(threshold)
    return scored.withColumn("accepted", hit)


def self_train(
    kind: str,
    labeled: DataFrame,
    unlabeled: DataFrame,
    threshold: float = 0.8,
    max_iter: int = 10,
    params: Mapping | None = None,
    label: str = "label",
    key: str = "row_id",
    balanced: bool = False,
    seed: int = 42,
    selected: list[int] | None = None,
) -> tuple[Fitted, DataFrame]:
    """(model, labels): labels holds (key, label, labeled_iter) for every row,
    label null and iter -1 where no round was confident enough; rows labelled
    from the start have iter 0.

    Each round writes the scored pool once, in files of a good size; accepted and
    remaining rows are filters over that table, so nothing is joined back.
    """
    known = _fit_table(labeled.select(key, "features", label), "known")
    pool = _fit_table(unlabeled.select(key, "features"), "pool")
    return _self_train(kind, known, pool, threshold, max_iter, params, label, key, balanced, seed, selected)


def _fit_table(df: DataFrame, tag: str) -> DataFrame:
    """Written in files of a good size for the tasks of a fit."""
    return materialize(df.hint("rebalance"), tag, FILE_ROWS)


def _self_train(
    kind: str, known: DataFrame, pool: DataFrame, threshold: float, max_iter: int, params: Mapping | None, label: str,
    key: str, balanced: bool, seed: int, selected: list[int] | None, first: Fitted | None = None,
) -> tuple[Fitted, DataFrame]:
    """:func:`self_train` over written tables; ``first`` may be the model of ``known``.

    The model is fitted anew only if rows were accepted since the last fit.
    """
    gold = [known.select(key, "features", label).withColumn("labeled_iter", F.lit(0))]
    kind_of_label = known.schema[label].dataType

    def fit() -> Fitted:
        return fit_classifier(kind, _few_tasks(union_all(*gold)), params, label, balanced, seed, selected)

    model, open_rows = first, pool.count()
    for it in range(1, max_iter + 1):
        if open_rows == 0:
            break
        model = model or fit()
        scored = accept_confident(model.transform(pool), threshold)
        scored = scored.select(key, "features", F.col("prediction").cast(kind_of_label).alias(label), "accepted")
        scored = _fit_table(scored, "scored")
        taken = scored.filter("accepted").drop("accepted").withColumn("labeled_iter", F.lit(it))
        left = scored.filter("not accepted").count()
        if left == open_rows:
            break
        gold.append(taken)
        model, pool, open_rows = None, scored.filter("not accepted").select(key, "features"), left
    model = model or fit()
    everything = union_all(*gold)
    rest = pool.select(key, F.lit(None).cast(kind_of_label).alias(label), F.lit(-1).alias("labeled_iter"))
    return model, everything.select(key, label, "labeled_iter").unionByName(rest)


def self_train_two_pass(
    kind: str, labeled: DataFrame, unlabeled: DataFrame, threshold: float = 0.8, key: str = "row_id", label: str = "label", **kw
) -> tuple[Fitted, DataFrame]:
    """Self-train, label every pool row at or above the threshold with that
    model, and self-train again from the larger labelled set."""
    model, _ = self_train(kind, labeled, unlabeled, threshold, key=key, label=label, **kw)
    scored = accept_confident(model.transform(unlabeled.select(key, "features")), threshold, inclusive=True)
    scored = materialize(scored.select(key, "features", F.col("prediction").cast(labeled.schema[label].dataType).alias(label), "accepted"), "pass1")
    more = labeled.select(key, "features", label).unionByName(scored.filter("accepted").drop("accepted"))
    return self_train(kind, more, scored.filter("not accepted").select(key, "features"), threshold, key=key, label=label, **kw)


def adaptive_threshold(
    runs: DataFrame,
    by: Sequence[str],
    step: str,
    f1: str,
    start: float = 0.8,
    floor: float = 0.5,
    delta: float = 0.05,
    gain: float = 0.01,
) -> DataFrame:
    """(*by, step, threshold after the step): down by ``delta`` (to ``floor``)
    when F1 beats the best so far by more than ``gain``, up (to ``start``) when
    it falls below the best, else unchanged. A group is one model's short run."""
    by = list(by)
    series = runs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), F.col(f1).alias("f")))).alias("xs"))
    point = "array<struct<s:" + runs.schema[step].dataType.simpleString() + ",t:double>>"
    init = F.struct(F.lit(float(start)).alias("t"), F.lit(0.0).alias("best"), F.array().cast(point).alias("log"))

    def fold(acc: Column, x: Column) -> Column:
        better = x["f"] > acc["best"] * (1 + gain)
        worse = x["f"] < acc["best"]
        t = (
            F.when(better, F.greatest(acc["t"] - delta, F.lit(float(floor))))
            .when(worse, F.least(acc["t"] + delta, F.lit(float(start))))
            .otherwise(acc["t"])
        )
        best = F.when(better, x["f"]).otherwise(acc["best"])
        log = F.array_append(acc["log"], F.struct(x["s"].alias("s"), t.alias("t")))
        return F.struct(t.alias("t"), best.alias("best"), log.alias("log"))

    out = series.select(*by, F.inline(F.aggregate("xs", init, fold, lambda a: a["log"])))
    return out.select(*by, F.col("s").alias(step), F.col("t").alias("threshold"))


def next_threshold(state: tuple[float, float], f1: float, start=0.8, floor=0.5, delta=0.05, gain=0.01) -> tuple[float, float]:
    """(threshold, best F1) after one more run."""
    t, best = state
    if f1 > best * (1 + gain):
        return max(t - delta, floor), f1
    return (min(t + delta, start), best) if f1 < best else (t, best)


def pseudo_label_summary(labels: DataFrame, n_classes: int, threshold: float, label: str = "label") -> DataFrame:
    """One row: pseudo-labelled and remaining counts, counts per class, the
    threshold and the number of rows labelled from the start."""
    pool = F.col("labeled_iter") != 0
    got = pool & F.col(label).isNotNull()
    return labels.agg(
        F.count_if(got).alias("pseudo_label_count"),
        F.count_if(pool & F.col(label).isNull()).alias("not_pseudo_label_count"),
        F.array(*[F.count_if(got & (F.col(label) == c)) for c in range(n_classes)]).alias("pseudo_label_distribution"),
        F.lit(float(threshold)).alias("threshold"),
        F.count_if(~pool).alias("labeled_samples_count"),
    )


# -- sweeps and reports --------------------------------------------------------------
def feature_importances(model: Fitted, names: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, importance) of a tree model, over its selected features."""
    used = model.selected if model.selected is not None else range(len(names))
    return [(names[i], v) for i, v in zip(used, model.importances())]


def select_features(kind: str, df: DataFrame, params: Mapping | None = None, label: str = "label", seed: int = 42) -> list[int]:
    """Indices of the features a fresh fit finds at least averagely important."""
    return important_features(fit_classifier(kind, df, params, label, seed=seed).importances())


def _grown(df: DataFrame, label: str, method: str, key: str, seed: int) -> DataFrame:
    """Vectors with synthetic rows, which get ids of their own below -1."""
    arrays = df.select(key, label, vector_to_array("features").alias("features"))
    grown = oversample(arrays, label, method, key, seed=seed)
    fresh = -(F.monotonically_increasing_id() + 2)
    return as_vectors(materialize(grown.withColumn(key, F.coalesce(F.col(key), fresh)), "grown"))


def fraction_sweep(
    labeled: DataFrame,
    unlabeled: DataFrame,
    fractions: Sequence[float],
    models: Mapping[str, Mapping],
    label: str = "label",
    key: str = "row_id",
    threshold: float = 0.8,
    seed: int = 42,
    n_classes: int | None = None,
    bootstrap: int = 50,
    shared_threshold: bool = False,
    max_iter: int = 10,
    draws: Mapping[str, Sequence[Mapping]] | None = None,
    folds: int = 5,
    oversampling: str | None = None,
) -> DataFrame:
    """One row per (model, label fraction): see :func:`sweep_runs`, whose ``runs`` it returns."""
    return sweep_runs(
        labeled, unlabeled, fractions, models, label, key, threshold, seed, n_classes, bootstrap, shared_threshold,
        max_iter, draws, folds, oversampling,
    ).runs


@dataclass
class Sweep:
    """The result of a sweep, each table keyed by (model, labeled_fraction).

    ``runs``: one row with all scalar results; ``scored``: the rows behind it, with
    ``part`` (train or test), y, yhat and p; ``confusion`` (part, y, yhat, n);
    ``reports`` (part, class, precision, recall, f1, support); ``cv``: every draw and
    fold of the searches; ``importances`` (feature position, importance).
    """

    runs: DataFrame
    scored: DataFrame
    confusion: DataFrame
    reports: DataFrame
    cv: DataFrame | None
    importances: DataFrame


def sweep_runs(
    labeled: DataFrame,
    unlabeled: DataFrame,
    fractions: Sequence[float],
    models: Mapping[str, Mapping],
    label: str = "label",
    key: str = "row_id",
    threshold: float = 0.8,
    seed: int = 42,
    n_classes: int | None = None,
    bootstrap: int = 50,
    shared_threshold: bool = False,
    max_iter: int = 10,
    draws: Mapping[str, Sequence[Mapping]] | None = None,
    folds: int = 5,
    oversampling: str | None = None,
) -> Sweep:
    """Self-training of every model at every share of the labels.

    80/20 test split, 90/10 validation split, a stratified share of the rest,
    optional oversampling, cross-validated search over ``draws`` of a model's
    parameters, feature selection for tree models, self-training, evaluation on
    the labelled training rows and the test rows. The threshold state belongs to
    each model, whose shares follow one another while models run side by side;
    with ``shared_threshold`` all runs follow one another. What no threshold can
    change (search, features, the fit of the given labels) is made ahead, some runs
    at a time. Metrics of all runs are computed together at the end.
    """
    spark = labeled.sparkSession
    train, test = stratified_split(labeled, label, 0.8, seed, key)
    train, val = stratified_split(train, label, 0.9, seed, key)
    with ThreadPool(SWEEP_FITS) as pool:
        train, val, test, rest = pool.map(
            lambda x: _fit_table(x, "split"), (train, val, test, unlabeled.select(key, "features")), chunksize=1
        )
        shares = pool.map(lambda f: _fit_table(labeled_fraction(train, label, f, seed, key), "fraction"), fractions, chunksize=1)
    k = n_classes or labeled.agg(F.max(label)).first()[0] + 1
    parts = dict(zip(fractions, shares))
    grown = {f: x if oversampling is None else _grown(x, label, oversampling, key, seed) for f, x in parts.items()}

    def ready(kind: str, frac: float):
        t0, base, params, found = time.time(), _few_tasks(grown[frac]), models[kind], None
        if draws and draws.get(kind):
            params, found = random_search(
                kind, parts[frac], draws[kind], folds, label=label, seed=seed, key=key, oversampling=oversampling
            )
        chosen = select_features(kind, base, params, label, seed) if kind in TREE_KINDS else None
        return params, found, chosen, fit_classifier(kind, base, params, label, True, seed, chosen), time.time() - t0

    def run(kind: str, frac: float, state: tuple[float, float]):
        params, found, chosen, first, spent = ahead[kind, frac].get()
        t0, (t, best), base = time.time() - spent, state, grown[frac]
        model, labels = _self_train(kind, base, rest, t, max_iter, params, label, key, True, seed, chosen, first)
        f1 = M.label_metrics(M.confusion_counts(model.transform(val), (), label, "prediction")).first()["f1"]
        both = [
            model.transform(x).select(
                F.lit(kind).alias("model"), F.lit(float(frac)).alias("labeled_fraction"), F.lit(name).alias("part"),
                F.col(label).cast("int").alias("y"), F.col("prediction").alias("yhat"), "p",
            )
            for name, x in (("train", base.filter(F.col(label).isNotNull())), ("test", test))
        ]
        scored = materialize(union_all(*both).hint("rebalance"), "scored")
        ps = pseudo_label_summary(labels, k, t, label).first()
        own = cv_results(found).orderBy("rank_test_score", "draw").first() if found is not None else None
        row = (
            kind, float(frac), {a: str(b) for a, b in params.items()},
            own and own["mean_test_score"], own and own["std_test_score"],
            ps["pseudo_label_count"], ps["not_pseudo_label_count"], list(ps["pseudo_label_distribution"]), t,
            ps["labeled_samples_count"], time.time() - t0,
        )
        weights = [(kind, float(frac), i, float(v)) for i, v in feature_importances(model, range(max(chosen) + 1 if chosen else 0))] if chosen else []
        return row, scored, found, weights, next_threshold(state, f1)

    def chain(kinds: Sequence[str]) -> list:
        out, state = [], (threshold, 0.0)
        for frac in fractions:
            for kind in kinds:
                *done, state = run(kind, frac, state)
                out.append(done)
        return out

    chains = [list(models)] if shared_threshold else [[m] for m in models]
    with ThreadPool(SWEEP_FITS) as early, ThreadPool(len(chains)) as pool:
        ahead = {(m, f): early.apply_async(ready, (m, f)) for f in fractions for m in models}
        done = [x for out in pool.map(chain, chains) for x in out]
    by = ["model", "labeled_fraction"]
    tagged = lambda df, r: df.select(F.lit(r[0]).alias(by[0]), F.lit(r[1]).alias(by[1]), "*")
    facts = spark.createDataFrame(
        [r for r, *_ in done],
        "model string, labeled_fraction double, best_params map<string,string>, best_mean_cv_score double, "
        "best_std_cv_score double, pseudo_label_count long, not_pseudo_label_count long, "
        "pseudo_label_distribution array<long>, threshold double, labeled_samples_count long, training_time double",
    )
    scored = union_all(*[x for _, x, *_ in done])
    confusion = materialize(M.confusion_counts(scored, [*by, "part"]), "confusion")
    cv = [tagged(x, r) for r, _, x, _ in done if x is not None]
    runs = facts.join(_run_metrics(done, scored, confusion, k, bootstrap, seed), by)
    return Sweep(
        runs, scored, confusion, M.classification_report(confusion, [*by, "part"]), union_all(*cv) if cv else None,
        spark.createDataFrame([w for *_, own in done for w in own], "model string, labeled_fraction double, position int, importance double"),
    )


def _run_metrics(done: list, scored: DataFrame, confusion: DataFrame, k: int, bootstrap: int, seed: int) -> DataFrame:
    """All runs' scalar metrics; those of the training rows start with ``train_``."""
    spark, by = scored.sparkSession, ["model", "labeled_fraction"]
    names = ["accuracy", "f1", "precision", "recall", "balanced_accuracy", "kappa", "mcc", "error_rate"]
    labels = M.label_metrics(confusion, [*by, "part"]).select(*by, "part", *names)
    probs = scored.groupBy(*by, "part").agg(*M.probability_metrics(top_k=3))
    both = labels.join(probs, [*by, "part"])
    names += ["log_loss", "top_k_accuracy"]

    def one(item):
        row, own = item[0], item[1]
        boot = M.bootstrap_metrics(own.filter("part = 'test'"), bootstrap, seed, "multinomial").first().asDict()
        mean = [areas[row[0], row[1], p] for p in ("test", "train")]
        return (row[0], row[1], *mean, *[boot[f"{a}_{m}"] for m in ("accuracy", "precision", "recall", "f1") for a in ("mean", "std")])

    found = M.class_auc(scored, k, by=[*by, "part"]).filter("class = 'mean'").collect()  # two rows a run
    areas = {(r[by[0]], r[by[1]], r["part"]): r["auc"] for r in found}
    with ThreadPool(SWEEP_FITS) as pool:
        rows = pool.map(one, done, chunksize=1)
    boots = ", ".join(f"{a}_{m} double" for m in ("accuracy", "precision", "recall", "f1") for a in ("mean", "std"))
    areas = spark.createDataFrame(rows, f"model string, labeled_fraction double, roc_auc double, train_roc_auc double, {boots}")
    test = both.filter("part = 'test'").drop("part")
    train = both.filter("part = 'train'").select(*by, *[F.col(c).alias(f"train_{c}") for c in names])
    return test.join(train, by).join(areas, by)
