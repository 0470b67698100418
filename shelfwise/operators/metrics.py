"""Classification metrics over a table (y int, yhat int, p array<double>).

Label metrics come from the k x k confusion counts; score metrics from counts
per distinct score. Running sums are cut into score or rate slices, so no task
holds a whole class.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.functions.hashing import hash_int
from shelfwise.functions.vectors import argmax
from shelfwise.operators.aggregates import histogram, value_counts
from shelfwise.operators.relational import decode_class
from shelfwise.operators.sampling import poisson_weights
from shelfwise.session import materialize

EPS = 2.220446049250313e-16


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_counts(df: DataFrame, by: Sequence[str] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """(*by, y, yhat, n) for the pairs that occur."""
    return df.groupBy(*by, F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, n_classes: int, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """(y, yhat, n) with empty cells as 0."""
    grid = df.sparkSession.range(n_classes * n_classes).select(
        F.floor(F.col("id") / n_classes).cast("int").alias("y"), (F.col("id") % n_classes).cast("int").alias("yhat")
    )
    return grid.join(confusion_counts(df, (), y, yhat), ["y", "yhat"], "left").select(
        "y", "yhat", F.coalesce("n", F.lit(0)).alias("n")
    )


def class_report(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, class, precision, recall, f1, support, predicted, tp) for every
    class seen in y or yhat; 0/0 is 0."""
    by = list(by)
    ends = F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("p"),
                 F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).cast("bigint").alias("t")),
        F.struct(F.col("yhat").alias("class"), F.lit(0).cast("bigint").alias("s"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("t")),
    )
    per = (
        cm.filter(F.col("n") > 0)
        .select(*by, F.inline(ends))
        .groupBy(*by, "class")
        .agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("t").alias("tp"))
    )
    per = per.withColumns(
        {"precision": _ratio(F.col("tp"), F.col("predicted")), "recall": _ratio(F.col("tp"), F.col("support"))}
    )
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return per.withColumn("f1", f1)


def label_metrics(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (per group): accuracy, error_rate, balanced_accuracy, weighted
    precision / recall / F1, kappa and mcc."""
    r = class_report(cm, by)
    n = F.sum("support")
    d = lambda c: F.sum(F.col(c).cast("double") * F.col("support"))
    s = r.groupBy(*by).agg(
        n.cast("double").alias("n"),
        F.sum("tp").cast("double").alias("c"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        (d("precision") / n).alias("precision"),
        (d("recall") / n).alias("recall"),
        (d("f1") / n).alias("f1"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("tpk"),
        F.sum(F.col("support").cast("double") * F.col("support")).alias("tt"),
        F.sum(F.col("predicted").cast("double") * F.col("predicted")).alias("pp"),
    )
    c, n, tpk, tt, pp = (F.col(x) for x in ("c", "n", "tpk", "tt", "pp"))
    kappa = F.try_divide(c / n - tpk / (n * n), 1 - tpk / (n * n))
    mcc = _ratio(c * n - tpk, F.sqrt((n * n - pp) * (n * n - tt)))
    return s.select(
        *by, (c / n).alias("accuracy"), (1 - c / n).alias("error_rate"), "balanced_accuracy", "precision", "recall",
        "f1", kappa.alias("kappa"), mcc.alias("mcc"),
    )


def classification_report(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-class rows plus 'accuracy', 'macro avg' and 'weighted avg'."""
    by = list(by)
    r = class_report(cm, by)
    rows = r.select(*by, F.col("class").cast("string").alias("class"), "precision", "recall", "f1", F.col("support").cast("double").alias("support"))
    total = F.sum("support").cast("double")
    w = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support"))
    macro = r.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], total.alias("support"))
    weighted = r.groupBy(*by).agg(*[w(c).alias(c) for c in ("precision", "recall", "f1")], total.alias("support"))
    acc = r.groupBy(*by).agg((F.sum("tp") / F.sum("support")).alias("a"), total.alias("support"))
    acc = acc.select(*by, *[F.col("a").alias(c) for c in ("precision", "recall", "f1")], "support")
    out = rows
    for name, part in (("accuracy", acc), ("macro avg", macro), ("weighted avg", weighted)):
        out = out.unionByName(part.withColumn("class", F.lit(name)))
    return out


# -- score metrics ------------------------------------------------------------
def _loss(y: str, p: str) -> Column:
    clipped = F.transform(p, lambda x: F.least(F.greatest(x, F.lit(EPS)), F.lit(1 - EPS)))
    total = F.aggregate(clipped, F.lit(0.0), lambda s, x: s + x)
    return F.avg(-F.log(F.get(clipped, F.col(y)) / total)).alias("log_loss")


def _among(k: int, y: str, p: str) -> Column:
    own = F.get(p, F.col(y))
    ahead = F.filter(p, lambda x, j: (x > own) | ((x == own) & (j > F.col(y))))
    return F.avg((F.size(ahead) < k).cast("double")).alias("top_k_accuracy")


def log_loss(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """-mean ln p(true) with clipped, renormalised rows."""
    return df.agg(_loss(y, p))


def top_k_accuracy(df: DataFrame, k: int = 3, y: str = "y", p: str = "p") -> DataFrame:
    """Share of rows whose class is among the k best; of equal scores the higher
    class index ranks first."""
    return df.agg(_among(k, y, p))


def probability_metrics(y: str = "y", p: str = "p", top_k: int = 3) -> list[Column]:
    """The aggregates of :func:`log_loss` and :func:`top_k_accuracy`, for any grouping."""
    return [_loss(y, p), _among(top_k, y, p)]


MICRO = "micro"


def score_counts(df: DataFrame, n_classes: int, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """(*by, class, score, pos, neg) per distinct score, classes 0..k-1 and 'micro'."""
    cells = F.transform(
        F.col(p), lambda x, j: F.struct(j.cast("string").alias("class"), x.alias("score"), (j == F.col(y)).cast("bigint").alias("pos"))
    )
    rows = df.select(*by, F.inline(F.slice(cells, 1, n_classes)))
    counted = rows.groupBy(*by, "class", "score").agg(F.sum("pos").alias("pos"), (F.count("*") - F.sum("pos")).alias("neg"))
    micro = counted.groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return counted.unionByName(micro.select(*by, F.lit(MICRO).alias("class"), "score", "pos", "neg"))


def _running(counts: DataFrame, slices: int, by: Sequence[str] = ()) -> DataFrame:
    """Add positives and negatives scored strictly above each row's score, and
    the class totals. Scores are cut at quantiles into slices."""
    own = [*by, "class"]
    counts = materialize(counts, "scores")
    marks = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    edges = counts.groupBy(*own).agg(
        F.percentile_approx("score", marks, 10 * slices).alias("edges"), F.sum("pos").alias("P"), F.sum("neg").alias("N")
    )
    cut = counts.join(edges, own).withColumn(
        "slice", F.size(F.filter("edges", lambda e: e > F.col("score")))
    ).drop("edges")
    sums = cut.groupBy(*own, "slice").agg(F.sum("pos").alias("sp"), F.sum("neg").alias("sn"))
    earlier = W.partitionBy(*own).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select(
        *own, "slice", F.coalesce(F.sum("sp").over(earlier), F.lit(0)).alias("cp"),
        F.coalesce(F.sum("sn").over(earlier), F.lit(0)).alias("cn"),
    )
    above = W.partitionBy(*own, "slice").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    local = cut.withColumns(
        {"lp": F.coalesce(F.sum("pos").over(above), F.lit(0)), "ln": F.coalesce(F.sum("neg").over(above), F.lit(0))}
    )
    return local.join(carry, [*own, "slice"]).select(
        *own, "score", "pos", "neg", "P", "N", (F.col("cp") + F.col("lp")).alias("tp0"), (F.col("cn") + F.col("ln")).alias("fp0")
    )


def roc_curve(df: DataFrame, n_classes: int, y: str = "y", p: str = "p", slices: int = 256) -> DataFrame:
    """(class, threshold, fpr, tpr) at every distinct score, per class and
    'micro', from (0, 0) at threshold infinity."""
    return _curve(_running(score_counts(df, n_classes, y, p), slices))


def _curve(run: DataFrame) -> DataFrame:
    pts = run.select(
        "class", F.col("score").alias("threshold"),
        _ratio(F.col("fp0") + F.col("neg"), F.col("N")).alias("fpr"), _ratio(F.col("tp0") + F.col("pos"), F.col("P")).alias("tpr"),
    )
    start = run.select("class").distinct().select(
        "class", F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return pts.unionByName(start)


def roc_macro(curve: DataFrame, n_classes: int, slices: int = 256) -> DataFrame:
    """(fpr, tpr): class curves interpolated on the union of their false-positive
    rates and averaged.

    Rates are cut into even slices; each slice learns the nearest curve point
    before and after it, so interpolation never needs a whole class in a task.
    """
    ids = [str(c) for c in range(n_classes)]
    pts = (
        curve.filter(F.col("class").isin(*ids)).groupBy("class", "fpr").agg(F.min("tpr").alias("lo"), F.max("tpr").alias("hi"))
    )
    cut = F.least(F.floor(F.col("fpr") * slices), F.lit(slices - 1)).cast("int")
    pts = materialize(pts.withColumn("slice", cut), "curve")
    classes = F.explode(F.array(*[F.lit(c) for c in ids])).alias("class")
    grid = pts.select("fpr", "slice").distinct().select("fpr", "slice", classes)
    ends = pts.groupBy("class", "slice").agg(
        F.min(F.struct("fpr", F.col("lo").alias("t"))).alias("head"), F.max(F.struct("fpr", F.col("hi").alias("t"))).alias("tail")
    )
    frame = curve.sparkSession.range(slices).select(F.col("id").cast("int").alias("slice"), classes)
    before = W.partitionBy("class").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("class").orderBy("slice").rowsBetween(1, W.unboundedFollowing)
    carry = frame.join(ends, ["class", "slice"], "left").select(
        "class", "slice", F.last("tail", True).over(before).alias("cin"), F.first("head", True).over(after).alias("cout")
    )
    own = grid.join(pts.drop("slice"), ["class", "fpr"], "left").join(carry, ["class", "slice"])
    point = lambda t: F.when(F.col("hi").isNotNull(), F.struct("fpr", F.col(t).alias("t")))
    w = W.partitionBy("class", "slice").orderBy("fpr")
    own = own.withColumns(
        {
            "prev": F.coalesce(F.last(point("hi"), True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.col("cin")),
            "next": F.coalesce(F.first(point("lo"), True).over(w.rowsBetween(1, W.unboundedFollowing)), F.col("cout")),
        }
    )
    slope = F.try_divide(F.col("next.t") - F.col("prev.t"), F.col("next.fpr") - F.col("prev.fpr"))
    at = F.when(F.col("hi").isNotNull(), F.col("hi")).otherwise(
        F.col("prev.t") + F.coalesce(slope, F.lit(0.0)) * (F.col("fpr") - F.col("prev.fpr"))
    )
    return own.select("fpr", at.alias("t")).groupBy("fpr").agg(F.avg("t").alias("tpr"))


def curve_area(curve: DataFrame, slices: int = 256) -> DataFrame:
    """Trapezoid area under one curve (fpr, tpr) with distinct fpr."""
    curve = materialize(curve.select("fpr", "tpr"), "macro")
    cut = F.least(F.floor(F.col("fpr") * slices), F.lit(slices - 1)).cast("int")
    rows = curve.withColumn("slice", cut)
    heads = rows.groupBy("slice").agg(F.min(F.struct("fpr", "tpr")).alias("head"))
    nxt = heads.withColumn("head", F.lead("head").over(W.orderBy("slice")))  # at most ``slices`` rows
    w = W.partitionBy("slice").orderBy("fpr")
    step = rows.withColumn("nx", F.lead(F.struct("fpr", "tpr")).over(w)).join(nxt, "slice", "left")
    step = step.withColumn("nx", F.coalesce("nx", "head")).filter("nx is not null")
    area = (F.col("nx.fpr") - F.col("fpr")) * (F.col("nx.tpr") + F.col("tpr")) / 2
    return step.agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("auc"))


def class_auc(
    df: DataFrame, n_classes: int, y: str = "y", p: str = "p", slices: int = 256, by: Sequence[str] = ()
) -> DataFrame:
    """(*by, class, auc) per class, 'micro' and 'mean' (unweighted class mean)."""
    return _areas(_running(score_counts(df, n_classes, y, p, by), slices, by), by)


def _areas(run: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    part = F.sum(F.col("neg").cast("double") * (F.col("tp0") + F.col("pos") / 2))
    per = run.groupBy(*by, "class").agg(part.alias("a"), F.max("P").alias("P"), F.max("N").alias("N"))
    per = per.select(*by, "class", _ratio(F.col("a"), F.col("P").cast("double") * F.col("N")).alias("auc"))
    mean = per.filter(F.col("class") != MICRO).groupBy(*by).agg(F.avg("auc").alias("auc"))
    mean = mean.select(*by, F.lit("mean").alias("class"), "auc")
    return per.unionByName(mean)


def roc_auc(df: DataFrame, n_classes: int, y: str = "y", p: str = "p", slices: int = 256) -> DataFrame:
    """``class_auc`` plus 'macro', the area of the averaged curve."""
    run = materialize(_running(score_counts(df, n_classes, y, p), slices), "running")
    macro = curve_area(roc_macro(_curve(run), n_classes))
    return _areas(run).unionByName(macro.select(F.lit("macro").alias("class"), "auc"))


# -- bootstrap ----------------------------------------------------------------
def weighted_counts(df: DataFrame, replicates: int, times: str = "times", y: str = "y", yhat: str = "yhat") -> DataFrame:
    """(b, y, yhat, n) from rows with an array of weights, one per replicate: one
    aggregation by confusion cell, its sums taken apart afterwards."""
    sums = F.array(*[F.sum(F.get(times, F.lit(b)).cast("long")) for b in range(replicates)])
    cells = df.groupBy(F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(sums.alias("s"))
    return cells.select(F.posexplode("s").alias("b", "n"), "y", "yhat").filter("n > 0").select("b", "y", "yhat", "n")


def bootstrap_counts(
    df: DataFrame, replicates: int, seed: int = 42, method: str = "draws", key: str = "row_id"
) -> DataFrame:
    """(b, y, yhat, n): confusion counts of resamples as large as the table
    (with 'poisson' on average, for tables of any size: see ``poisson_weights``).

    Rows with the same (y, yhat) are interchangeable, so a resample is a draw
    from the confusion cells and no row is ever copied. 'draws' hashes every
    draw to a cell; 'multinomial' draws all cell counts of a replicate at once.
    """
    if method == "poisson":
        return weighted_counts(poisson_weights(df, replicates, seed, key), replicates)
    spark = df.sparkSession
    cells = sorted((r["y"], r["yhat"], r["n"]) for r in confusion_counts(df).collect())
    n = sum(c[2] for c in cells)
    if method == "multinomial":
        share = [c[2] / n for c in cells]
        rows = []
        for b in range(replicates):
            counts = np.random.default_rng([seed, b]).multinomial(n, share)
            rows += [(b, c[0], c[1], int(m)) for c, m in zip(cells, counts)]
        return spark.createDataFrame(rows, "b int, y int, yhat int, n long")
    if method != "draws":
        raise ValueError(f"method must be 'draws', 'multinomial' or 'poisson', got {method!r}")
    upper = np.cumsum([c[2] for c in cells]).tolist()
    draws = spark.range(n * replicates).select(
        F.floor(F.col("id") / n).cast("int").alias("b"), (F.col("id") % n + 1).alias("draw")
    )
    position = hash_int(F.concat_ws("-", "b", "draw"), seed) % n
    slot = F.size(F.filter(F.array(*[F.lit(u) for u in upper]), lambda u: u <= F.col("position")))
    table = F.array(*[F.struct(F.lit(c[0]).alias("y"), F.lit(c[1]).alias("yhat")) for c in cells])
    counted = draws.select("b", position.alias("position")).select("b", slot.alias("s")).groupBy("b", "s").agg(F.count("*").alias("n"))
    return counted.select("b", F.get(table, F.col("s")).alias("c"), "n").select("b", "c.y", "c.yhat", "n")


def bootstrap_metrics(
    df: DataFrame, replicates: int = 200, seed: int = 42, method: str = "draws", key: str = "row_id"
) -> DataFrame:
    """Mean and population std of accuracy and weighted precision, recall and F1
    over the replicates."""
    per = label_metrics(bootstrap_counts(df, replicates, seed, method, key), ["b"])
    aggs = []
    for m in ("accuracy", "precision", "recall", "f1"):
        aggs += [F.avg(m).alias(f"mean_{m}"), F.stddev_pop(m).alias(f"std_{m}")]
    return per.agg(*aggs)


# -- prediction summaries -------------------------------------------------------
def with_confidence(df: DataFrame, p: str = "p") -> DataFrame:
    """Predicted class and its probability from a probability array."""
    return df.withColumns({"prediction": argmax(p), "confidence": F.array_max(p)})


def confidence_histogram(df: DataFrame, bins: int = 20, p: str = "p") -> DataFrame:
    return histogram(df.select(F.array_max(p).alias("confidence")), "confidence", bins)


def predicted_class_distribution(df: DataFrame, yhat: str = "yhat") -> DataFrame:
    """(class, n) per predicted class under its letter."""
    return value_counts(df.select(decode_class(yhat).alias("class")), "class")
