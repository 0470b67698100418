"""Iterative graph jobs: components, label propagation and spreading.

Every round is one join on the edge source and one pre-aggregated sum per
target; node state is written to the shared folder each round, so the plan
stays short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.vectors import argmax
from shelfwise.operators.neighbors import rbf_affinity, rbf_class_sums
from shelfwise.session import materialize


def connected_components(nodes: DataFrame, edges: DataFrame, key: str = "id", max_rounds: int = 200) -> DataFrame:
    """(id, component): the smallest id reachable from each node.

    Each round takes the smallest label among the neighbours and then follows
    labels one step (label of the label), which halves long chains.
    ``edges`` (src, dst) must hold both directions.
    """
    state = materialize(nodes.select(F.col(key).alias("id"), F.col(key).alias("c")), "cc")
    for _ in range(max_rounds):
        seen = (
            edges.select("src", "dst")
            .join(state.select(F.col("id").alias("src"), "c"), "src")
            .groupBy("dst")
            .agg(F.min("c").alias("m"))
        )
        hooked = state.join(seen, state["id"] == seen["dst"], "left").select(
            "id", F.col("c").alias("old"), F.least("c", "m").alias("c")
        )
        hooked = materialize(hooked, "cchook")
        roots = hooked.select(F.col("id").alias("r"), F.col("c").alias("rc"))
        moved = hooked.join(roots, hooked["c"] == roots["r"]).select("id", "old", F.least("c", "rc").alias("c"))
        state = materialize(moved, "cc")
        if state.filter(F.col("old") != F.col("c")).isEmpty():
            return state.select("id", F.col("c").alias("component"))
        state = state.drop("old")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _seed(nodes: DataFrame, n_classes: int, label: str, key: str) -> DataFrame:
    one_hot = F.array(*[F.coalesce((F.col(label) == c).cast("double"), F.lit(0.0)) for c in range(n_classes)])
    known = F.col(label).isNotNull() & (F.col(label) >= 0)
    zero = F.array(*[F.lit(0.0)] * n_classes)
    return nodes.select(
        F.col(key).alias("id"), known.alias("known"), F.when(known, one_hot).otherwise(zero).alias("y")
    )


def _incoming(state: DataFrame, edges: DataFrame, n_classes: int) -> DataFrame:
    sums = F.array(*[F.sum(F.col("w") * F.col("f")[c]) for c in range(n_classes)])
    return (
        edges.join(state.select(F.col("id").alias("src"), "f"), "src").groupBy("dst").agg(sums.alias("g"))
    )


def _normalized(v: Column) -> Column:
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return F.transform(v, lambda x: F.when(total == 0, F.lit(0.0)).otherwise(x / total))


def _change(old: Column, new: Column) -> Column:
    return F.aggregate(F.zip_with(old, new, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)


def _iterate(state: DataFrame, step, max_iter: int, tol: float | None) -> DataFrame:
    for _ in range(max_iter):
        state = materialize(step(state), "spread")
        if tol is not None and (state.agg(F.sum("delta")).first()[0] or 0.0) < tol:
            break
    return state


def _as_result(state: DataFrame, normalize: bool) -> DataFrame:
    p = _normalized(F.col("f")) if normalize else F.col("f")
    out = state.select("id", p.alias("p"))
    decided = F.aggregate("p", F.lit(0.0), lambda s, x: s + x) > 0
    return out.select("id", "p", F.when(decided, argmax("p")).alias("label"))


def label_propagation(
    nodes: DataFrame,
    edges: DataFrame,
    n_classes: int,
    max_iter: int = 100,
    tol: float | None = 1e-3,
    label: str = "label",
    key: str = "id",
    self_weight: float = 1.0,
) -> DataFrame:
    """(id, p, label): neighbours' class shares, renormalised every round, known
    labels held fixed. ``edges`` (src, dst, w) must hold both directions;
    ``self_weight`` is each node's weight to itself. A node no label reaches
    keeps zero shares and a null label."""
    seed = materialize(_seed(nodes, n_classes, label, key), "lpseed")
    state = seed.withColumn("f", F.col("y"))

    def step(s: DataFrame) -> DataFrame:
        g = _incoming(s, edges, n_classes)
        own = F.transform("f", lambda x: x * F.lit(float(self_weight)))
        mixed = F.when(F.col("g").isNull(), own).otherwise(F.zip_with(own, "g", lambda a, b: a + b))
        new = F.when(F.col("known"), F.col("y")).otherwise(_normalized(mixed))
        joined = s.select("id", "known", "y", "f").join(g, F.col("id") == F.col("dst"), "left")
        return joined.select("id", "known", "y", new.alias("n"), F.col("f").alias("o")).select(
            "id", "known", "y", F.col("n").alias("f"), _change(F.col("o"), F.col("n")).alias("delta")
        )

    return _as_result(_iterate(state, step, max_iter, tol), normalize=True)


def spread_edges(edges: DataFrame) -> DataFrame:
    """Edge weights scaled by both ends' degrees: w / sqrt(d_src d_dst)."""
    degree = edges.groupBy("src").agg(F.sum("w").alias("d"))
    return (
        edges.join(degree, "src")
        .join(degree.toDF("dst", "d2"), "dst")
        .select("src", "dst", (F.col("w") / F.sqrt(F.col("d") * F.col("d2"))).alias("w"))
    )


def label_spreading(
    nodes: DataFrame,
    edges: DataFrame,
    n_classes: int,
    alpha: float = 0.2,
    max_iter: int = 30,
    tol: float | None = 1e-3,
    label: str = "label",
    key: str = "id",
) -> DataFrame:
    """(id, p, label): F <- alpha S F + (1 - alpha) Y with the degree-scaled
    weights S; known labels may soften. Shares are normalised at the end."""
    scaled = materialize(spread_edges(edges), "lsedges")
    seed = materialize(_seed(nodes, n_classes, label, key), "lsseed")
    state = seed.withColumn("f", F.col("y"))
    a = F.lit(float(alpha))

    def step(s: DataFrame) -> DataFrame:
        g = _incoming(s, scaled, n_classes)
        base = F.transform("y", lambda x: x * (1 - a))
        new = F.when(F.col("g").isNull(), base).otherwise(F.zip_with(base, "g", lambda y, x: y + a * x))
        joined = s.select("id", "known", "y", "f").join(g, F.col("id") == F.col("dst"), "left")
        return joined.select("id", "known", "y", new.alias("n"), F.col("f").alias("o")).select(
            "id", "known", "y", F.col("n").alias("f"), _change(F.col("o"), F.col("n")).alias("delta")
        )

    return _as_result(_iterate(state, step, max_iter, tol), normalize=True)


def propagate_inductive(
    train: DataFrame, new: DataFrame, gamma: float, n_classes: int, label: str = "label",
    key: str = "row_id", vec: str = "features", **tiling,
) -> DataFrame:
    """(id, p, label) for rows outside the graph: a vote of all labelled rows
    weighted by exp(-gamma d^2). ``label`` is a class index or an array of class
    shares (as spreading leaves them)."""
    sums = rbf_class_sums(new, train, gamma, label, n_classes, key, vec, **tiling)
    return _as_result(sums.select("id", F.col("sums").alias("f")), normalize=True)


def transductive_propagation(
    df: DataFrame, n_classes: int, gamma: float = 20.0, k: int = 7, method: str = "propagation",
    label: str = "label", key: str = "row_id", vec: str = "features", alpha: float = 0.2,
    max_iter: int = 30, tol: float | None = 1e-3, **tiling,
) -> DataFrame:
    """Labelled and unlabelled rows in one neighbour graph, then propagation or
    spreading over it."""
    edges = materialize(rbf_affinity(df, gamma, k, key, vec, **tiling), "affinity")
    nodes = df.select(F.col(key).alias("id"), label)
    if method == "propagation":
        return label_propagation(nodes, edges, n_classes, max_iter, tol, label)
    if method == "spreading":
        return label_spreading(nodes, edges, n_classes, alpha, max_iter, tol, label)
    raise ValueError(f"method must be 'propagation' or 'spreading', got {method!r}")


def fold_scores(
    folded: DataFrame, n_classes: int, gammas, folds: int, label: str = "label", key: str = "row_id", vec: str = "features", **tiling
) -> dict[float, float]:
    """Cross-validated accuracy of the inductive vote at every width.

    One join for all: votes are summed per width, fold and class, and a row is
    judged by those of the folds it is not in.
    """
    votes = [((F.col("fold") == f) & (F.col(label) == c)).cast("double") for f in range(folds) for c in range(n_classes)]
    voters = folded.withColumn("__votes", F.array(*votes))
    sums = rbf_class_sums(folded, voters, list(gammas), "__votes", len(votes), key, vec, **tiling)

    def others(i: int, c: int) -> Column:
        return sum(
            F.when(F.col("fold") == f, F.lit(0.0)).otherwise(F.col("sums")[(i * folds + f) * n_classes + c]) for f in range(folds)
        )

    shares = F.array(*[F.array(*[others(i, c) for c in range(n_classes)]) for i in range(len(gammas))])
    truth = folded.select(F.col(key).alias("id"), "fold", F.col(label).cast("int").alias("y"))
    per = sums.join(truth, "id").select("fold", "y", F.posexplode(shares).alias("i", "f"))
    decided = F.aggregate("f", F.lit(0.0), lambda s, x: s + x) > 0
    yhat = F.coalesce(F.when(decided, argmax(_normalized(F.col("f")))), F.lit(0))
    hits = per.groupBy("i", "fold").agg(F.avg((F.col("y") == yhat).cast("double")).alias("a")).groupBy("i").agg(F.avg("a").alias("a"))
    found = {r["i"]: r["a"] for r in hits.collect()}
    return {g: found[i] for i, g in enumerate(gammas)}


def graph_learning(
    df: DataFrame,
    n_classes: int,
    method: str = "propagation",
    gammas=(10.0, 20.0, 100.0),
    alpha: float = 0.2,
    k: int = 7,
    label: str = "label",
    fraction: float = 1.0,
    folds: int = 3,
    bootstrap: int = 200,
    seed: int = 42,
    key: str = "row_id",
    vec: str = "features",
    balance: str | None = None,
) -> tuple[dict, DataFrame]:
    """(metrics, predictions): the inductive run over one table whose unlabelled
    rows have a null label.

    80/20 test split, a stratified share of the training labels, optional
    oversampling, the affinity width chosen by cross-validated accuracy, test
    metrics with bootstrap spread, and predictions for the unlabelled rows.
    Spreading first smooths the training labels over their own graph.
    """
    from shelfwise.operators import metrics as M
    from shelfwise.operators.balance import oversample
    from shelfwise.operators.sampling import labeled_fraction, stratified_kfold, stratified_split

    known = df.filter(F.col(label).isNotNull()).select(key, label, F.col(vec).cast("array<double>").alias(vec))
    train, test = stratified_split(known, label, 0.8, seed, key)
    train = materialize(labeled_fraction(train, label, fraction, seed, key), "graphtrain")
    test = materialize(test, "graphtest")
    if balance is not None:
        # synthetic rows get negative ids below every real one
        grown = oversample(train, label, balance, key, vec, seed=seed)
        fresh = -(F.monotonically_increasing_id() + 2)
        train = materialize(grown.withColumn(key, F.coalesce(F.col(key), fresh)), "graphbalanced")

    def predict(tr: DataFrame, new: DataFrame, gamma: float) -> DataFrame:
        votes = label
        if method == "spreading":
            soft = transductive_propagation(tr, n_classes, gamma, k, "spreading", label, key, vec, alpha)
            tr = tr.join(soft.select(F.col("id").alias(key), "p"), key)
            votes = "p"
        out = propagate_inductive(tr, new, gamma, n_classes, votes, key, vec)
        return out.withColumnRenamed("label", "prediction")

    def scored(tr: DataFrame, te: DataFrame, gamma: float) -> DataFrame:
        truth = te.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y"))
        out = predict(tr, te, gamma).join(truth, "id")
        return materialize(out.select("id", "y", F.coalesce("prediction", F.lit(0)).alias("yhat"), "p"), "graphscored")

    folded = materialize(stratified_kfold(train, label, folds, seed, key), "graphfolds")
    if method == "propagation":
        cv = fold_scores(folded, n_classes, gammas, folds, label, key, vec)
    else:  # every fold and width smooths its labels anew
        cv = {}
        for g in gammas:
            hits = [
                scored(folded.filter(F.col("fold") != f), folded.filter(F.col("fold") == f), g)
                .agg(F.avg((F.col("y") == F.col("yhat")).cast("double"))).first()[0]
                for f in range(folds)
            ]
            cv[g] = sum(hits) / len(hits)
    best = max(cv, key=lambda g: (cv[g], -g))
    out = scored(train, test, best)
    report = M.label_metrics(M.confusion_counts(out)).first().asDict()
    report.update(M.bootstrap_metrics(out, bootstrap, seed, "multinomial").first().asDict())
    report.update(model_name=method, gamma=float(best), cv_best_score=cv[best], labeled_fraction=float(fraction))
    pool = df.filter(F.col(label).isNull()).select(key, F.col(vec).cast("array<double>").alias(vec))
    return report, predict(train, pool, best)
