"""Clustering, density components and cluster quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.graph import connected_components
from shelfwise.operators.lloyd import Fit, kmeans_many
from shelfwise.operators.neighbors import cluster_distance_sums, knn_join, nearest_centroid
from shelfwise.operators.quantiles import exact_quantiles
from shelfwise.session import materialize


def _vectors(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("__vec", array_to_vector(F.col(vec).cast("array<double>")))


def kmeans(df: DataFrame, k: int, n_init: int = 10, seed: int = 42, vec: str = "features", max_iter: int = 100) -> Fit:
    """The best of ``n_init`` fits by within-cluster squares."""
    return kmeans_many(df, [k], n_init, seed, vec, max_iter)[0]


def centers(model) -> list[list[float]]:
    return [[float(x) for x in c] for c in model.clusterCenters()]


def kmeans_sweep(df: DataFrame, max_k: int = 10, n_init: int = 10, seed: int = 42, vec: str = "features") -> DataFrame:
    """(k, wcss, silhouette) for k = 2..max_k, all fitted in the same scans."""
    fits = kmeans_many(df, range(2, max_k + 1), n_init, seed, vec)
    rows = [(f.k, f.cost, silhouette_squared(assign_clusters(df, centers(f), vec), "cluster", vec)) for f in fits]
    return df.sparkSession.createDataFrame(rows, "k int, wcss double, silhouette double")


def assign_clusters(df: DataFrame, centroids: Sequence[Sequence[float]], vec: str = "features", prefix: str | None = None) -> DataFrame:
    """Nearest centroid and the distance to it; with ``prefix`` (feature set and
    reduction method) the columns are named after it."""
    out = nearest_centroid(df, centroids, vec)
    if prefix is None:
        return out
    return out.withColumnsRenamed(
        {"cluster": f"{prefix}_Cluster_Labels", "distance": f"{prefix}_Distance_to_Centroid"}
    )


def core_distances(near: DataFrame) -> DataFrame:
    """(id, core): distance to the last of the listed neighbours."""
    return near.groupBy(F.col("left_id").alias("id")).agg(F.max("distance").alias("core"))


def density_clusters(
    df: DataFrame,
    min_samples: int = 5,
    min_cluster_size: int = 10,
    eps: float | None = None,
    eps_quantile: float = 0.9,
    metric: str = "euclidean",
    key: str = "row_id",
    vec: str = "features",
    near: DataFrame | None = None,
    **tiling,
) -> DataFrame:
    """(id, cluster, core, probability): components of near rows, noise = -1.

    Core distance is the distance to the ``min_samples``-th neighbour. Two
    neighbours are linked when the largest of their distance and both core
    distances is at most ``eps`` (by default a quantile of the core distances).
    Components below ``min_cluster_size`` are noise; a cluster's id is its
    smallest row id; probability is 1 - core / largest core of the cluster.
    ``near`` may give the neighbours, as many as ``min_samples`` or more a row.
    """
    if near is not None:
        near = near.filter(F.col("rank") <= min_samples)
    else:
        near = materialize(knn_join(df, df, min_samples, metric, key, key, vec, exclude_self=True, **tiling), "density")
    core = materialize(core_distances(near), "core")
    if eps is None:
        eps = exact_quantiles(core, ["core"], [eps_quantile]).first()["q0"]
    ends = near.join(core.toDF("left_id", "ca"), "left_id").join(core.toDF("right_id", "cb"), "right_id")
    linked = ends.filter(F.greatest("distance", "ca", "cb") <= F.lit(float(eps)))
    e = linked.select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"))
    both = materialize(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    comp = connected_components(df.select(F.col(key).alias("id")), both)
    sizes = comp.groupBy("component").agg(F.count("*").alias("n"))
    kept = comp.join(sizes, "component").join(core, "id", "left").select(
        "id",
        F.when(F.col("n") >= min_cluster_size, F.col("component")).otherwise(F.lit(-1)).cast("bigint").alias("cluster"),
        "core",
    )
    top = kept.filter("cluster <> -1").groupBy("cluster").agg(F.max("core").alias("top"))
    out = kept.join(top, "cluster", "left")
    prob = F.when(F.col("cluster") == -1, F.lit(0.0)).otherwise(
        1 - F.coalesce(F.try_divide(F.col("core"), F.col("top")), F.lit(0.0))
    )
    return out.select("id", "cluster", "core", prob.alias("probability"))


def cluster_score(clustered: DataFrame, limit: float = 0.05) -> DataFrame:
    """Number of labels (noise included) and share of rows below ``limit``
    membership probability: the cost of a clustering."""
    return clustered.agg(
        F.countDistinct("cluster").alias("n_labels"),
        F.avg((F.col("probability") < limit).cast("double")).alias("cost"),
    )


def cluster_random_search(df: DataFrame, params: DataFrame, key: str = "row_id", vec: str = "features", **kw) -> DataFrame:
    """Score each parameter set (min_samples, min_cluster_size), lowest cost first.
    The neighbours are found once, as many as the largest set asks for."""
    rows, sets = [], params.collect()
    most = max((int(p["min_samples"]) for p in sets), default=1)
    metric, tiling = kw.get("metric", "euclidean"), {k: v for k, v in kw.items() if k not in ("eps", "eps_quantile", "metric")}
    near = materialize(knn_join(df, df, most, metric, key, key, vec, exclude_self=True, **tiling), "density")
    for p in sets:
        found = density_clusters(df, int(p["min_samples"]), int(p["min_cluster_size"]), key=key, vec=vec, near=near, **kw)
        s = cluster_score(found).first()
        rows.append((p["min_samples"], p["min_cluster_size"], s["n_labels"], s["cost"]))
    out = df.sparkSession.createDataFrame(rows, "min_samples int, min_cluster_size int, n_labels long, cost double")
    return out.orderBy("cost", "min_samples", "min_cluster_size")


def silhouette_rows(df: DataFrame, cluster: str, key: str = "row_id", vec: str = "features", **tiling) -> DataFrame:
    """(id, silhouette) with Euclidean distances; a row alone in its cluster has 0."""
    sums = cluster_distance_sums(df, cluster, key, vec, **tiling)
    own = df.select(F.col(key).alias("id"), F.col(cluster).alias("own"))
    per = sums.join(own, "id")
    mine = F.col("cluster") == F.col("own")
    folded = per.groupBy("id").agg(
        F.max(F.when(mine, F.col("total"))).alias("own_total"),
        F.max(F.when(mine, F.col("n"))).alias("own_n"),
        F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("b"),
    )
    a = F.try_divide(F.col("own_total"), F.col("own_n") - 1)
    s = F.try_divide(F.col("b") - a, F.greatest(a, F.col("b")))
    return folded.select("id", F.when(F.col("own_n") <= 1, F.lit(0.0)).otherwise(F.coalesce(s, F.lit(0.0))).alias("silhouette"))


def silhouette(df: DataFrame, cluster: str, key: str = "row_id", vec: str = "features", **tiling) -> DataFrame:
    """Mean Euclidean silhouette. The work grows with the square of the distinct
    rows; ``silhouette_squared`` is the linear-time measure for large tables."""
    return silhouette_rows(df, cluster, key, vec, **tiling).agg(F.avg("silhouette").alias("silhouette"))


def silhouette_squared(df: DataFrame, cluster: str, vec: str = "features") -> float:
    """Mean silhouette with squared distances, from per-cluster moments only."""
    data = _vectors(df, vec).select("__vec", F.col(cluster).cast("double").alias("prediction"))
    return ClusteringEvaluator(featuresCol="__vec").evaluate(data)


def cluster_category_table(df: DataFrame, cluster: str, category: str) -> DataFrame:
    """Per cluster: size, its most frequent category and that category's share."""
    counts = df.groupBy(cluster, category).agg(F.count("*").alias("n"))
    best = F.min_by(F.col(category), F.struct((-F.col("n")).alias("n"), F.col(category).alias("c")))
    return counts.groupBy(cluster).agg(
        F.sum("n").alias("n"), best.alias("top_category"), (F.max("n") / F.sum("n")).alias("purity")
    )
