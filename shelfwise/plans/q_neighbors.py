"""Neighbour joins and clustering with their SQL twins."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.operators import clusters as K
from shelfwise.operators import neighbors as N
from shelfwise.operators.descent import knn_descent, recall
from shelfwise.operators.knn_vote import knn_classify
from shelfwise.operators.sampling import stratified_split
from shelfwise.plans import standins as D
from shelfwise.plans.q_features import vectors
from shelfwise.plans.registry import query, sql_hash_order
from shelfwise.session import materialize

#: draws of the reference's search; the grid here has fewer sets, all of which are drawn
SETS = 50

_E = "e as (select vec_id as id, embedding::double[] as v, label from embeddings)"
# class means serve as centroids
_CENT = """x as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
  m as (select label, i, avg(x) as mu from x group by label, i), cent as (select label as c, list(mu order by i) as mu from m group by label)"""
_NEAREST = f"""{_E}, {_CENT}, nd as (select id, label, c, list_distance(v, mu) as d, row_number() over (partition by id order by list_distance(v, mu), c) as rn from e, cent),
  near as (select id, label, c::int as cluster, d as distance from nd where rn = 1)"""


def class_centroids(spark, d):
    """Mean vector of each class: ten rows."""
    cells = vectors(spark, d).select("label", F.posexplode("features").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg("x").alias("mu"))
    rows = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "mu"))).alias("m")).orderBy("label").collect()
    return [[c["mu"] for c in r["m"]] for r in rows]


def clustered(spark, d):
    return N.nearest_centroid(vectors(spark, d), class_centroids(spark, d))


@query("j10_nearest_centroid", f"with {_NEAREST} select id as row_id, cluster, round(distance, 6) as distance from near")
def j10(spark, d):
    return clustered(spark, d).select("row_id", "cluster", F.round("distance", 6).alias("distance"))


def _knn_sql(k: int, dist: str = "list_distance(a.v, b.v)") -> str:
    return f"""kn as (select a.id as l, b.id as r, {dist} as d, row_number() over (partition by a.id order by {dist}, b.id) as rank
       from e a join e b on a.id <> b.id), kn{k} as (select * from kn where rank <= {k})"""


@query("j11_knn_join", f"with {_E}, {_knn_sql(5)} select l as left_id, r as right_id, round(d, 6) as distance, rank::int as rank from kn5")
def j11(spark, d):
    v = vectors(spark, d)
    return N.knn_join(v, v, 5, exclude_self=True).withColumn("distance", F.round("distance", 6))


@query(
    "j11_knn_join_cosine",
    f"with {_E}, {_knn_sql(5, 'list_cosine_distance(a.v, b.v)')} select l as left_id, r as right_id, round(d, 6) as distance, rank::int as rank from kn5",
)
def j11_cosine(spark, d):
    v = vectors(spark, d)
    return N.knn_join(v, v, 5, "cosine", exclude_self=True).withColumn("distance", F.round("distance", 6))


@query(
    "k8_knn_graph",
    f"""with {_E}, {_knn_sql(7)}, g as (select l as src, r as dst, d from kn7 union all select r, l, d from kn7)
        select src, dst, round(min(d), 6) as distance from g group by src, dst""",
)
def k8(spark, d):
    return N.knn_graph(vectors(spark, d), 7).withColumn("distance", F.round("distance", 6))


@query("k8_knn_graph_descent", "select count(*) as asked, 7 * count(*) as links, true as found, 0::bigint as wrong from embeddings")
def k8_descent(spark, d):
    """Neighbour descent against the exact join: nine of ten neighbours or more, no distance off."""
    v = vectors(spark, d)
    near = materialize(knn_descent(v, 7), "k8")
    row = recall(near, v, 7)
    return row.select("asked", near.agg(F.count("*")).scalar().alias("links"), (F.col("recall") >= 0.9).alias("found"), "wrong")


_SPLIT = f"""s as (select id, v, label, row_number() over (partition by label order by {sql_hash_order('id', 42)}, id)
   <= floor(count(*) over (partition by label) * 0.8::double + 0.5) as train from e)"""


@query(
    "c12_knn_classify",
    f"""with {_E}, {_SPLIT}, p as (select a.id, b.label, row_number() over (partition by a.id order by list_distance(a.v, b.v), b.id) as rank from s a join s b on not a.train and b.train),
        vt as (select id, label, count(*) as n from p where rank <= 5 group by id, label)
        select id, label as prediction, n / 5.0::double as share from vt qualify row_number() over (partition by id order by n desc, label) = 1""",
)
def c12(spark, d):
    train, test = stratified_split(vectors(spark, d), "label", 0.8)
    return knn_classify(train, test, 5)


# -- clusters -------------------------------------------------------------------
@query("k1_kmeans")
def k1(spark, d):
    v = vectors(spark, d)
    model = K.kmeans(v, 10)
    return K.assign_clusters(v, K.centers(model)).groupBy("cluster").agg(
        F.count("*").alias("n"), F.sum(F.col("distance") * F.col("distance")).alias("wcss")
    )


_SPREAD = f"""with {_E}, x as (select id, unnest(v) as c, unnest(range(len(v))) as i from e),
  m as (select i, avg(c) as c from x group by i), ss as (select sum((x.c - m.c) * (x.c - m.c)) as s from x join m using (i))"""


@query("k1_kmeans_balance", _SPREAD + " select 10::bigint as clusters, (select count(*) from e) as n, round(s, 3) as spread, true as settled from ss")
def k1_balance(spark, d):
    """What holds for any fit that has settled: the squares within the clusters and
    between them add up to those of the table, and each center is its rows' mean."""
    v = vectors(spark, d)
    c = np.array(K.centers(K.kmeans(v, 10)))
    rows = K.assign_clusters(v, c)
    mean = F.array(*[F.avg(F.get("features", i)) for i in range(c.shape[1])])
    per = rows.groupBy("cluster").agg(F.count("*").alias("n"), mean.alias("mean"), F.sum(F.col("distance") ** 2).alias("within")).collect()
    n = np.array([r["n"] for r in per])
    means = np.array([r["mean"] for r in per])
    overall = n @ means / n.sum()
    spread = sum(r["within"] for r in per) + float(n @ ((means - overall) ** 2).sum(1))
    settled = bool(np.abs(means - c[[r["cluster"] for r in per]]).max() < 1e-3)
    return spark.createDataFrame([(len(per), int(n.sum()), round(spread, 3), settled)], "clusters long, n long, spread double, settled boolean")


@query("k2_kmeans_sweep")
def k2(spark, d):
    return K.kmeans_sweep(vectors(spark, d))


@query("k2_kmeans_sweep_falls", _SPREAD + " select unnest(range(2, 11))::int as k, true as falls, true as bounded from ss")
def k2_falls(spark, d):
    """The cost falls with every cluster more, from below the table's own squares."""
    v = vectors(spark, d)
    sweep = K.kmeans_sweep(v)
    before = F.lag("wcss", 1, float("inf")).over(Window.orderBy("k"))  # nine rows
    return sweep.select("k", (F.col("wcss") < before).alias("falls"), F.col("silhouette").between(-1, 1).alias("bounded"))


@query(
    "k3_assign_clusters",
    f'with {_NEAREST} select id as row_id, cluster as "BERT_PCA_Cluster_Labels", round(distance, 6) as "BERT_PCA_Distance_to_Centroid" from near',
)
def k3(spark, d):
    out = K.assign_clusters(vectors(spark, d), class_centroids(spark, d), prefix="BERT_PCA")
    name = "BERT_PCA_Distance_to_Centroid"
    return out.select("row_id", "BERT_PCA_Cluster_Labels", F.round(name, 6).alias(name))


_DENSITY = f"""{_E}, {_knn_sql(5)}, core as (select l as id, max(d) as core from kn5 group by l),
  cut as (select quantile_cont(core, 0.6) as eps from core),
  lk as (select l, r from kn5 join core ca on ca.id = l join core cb on cb.id = r, cut where greatest(d, ca.core, cb.core) <= eps),
  ed as (select l as a, r as b from lk union select r, l from lk),
  reach as (with recursive w(id, c) as (select id, id from e union select ed.b, w.c from w join ed on ed.a = w.id where w.c < ed.b) select id, min(c) as c from w group by id),
  sz as (select c, count(*) as n from reach group by c),
  dc as (select id, case when n >= 8 then c else -1 end as cluster, core from reach join sz using (c) join core using (id)),
  tp as (select cluster, max(core) as top from dc where cluster <> -1 group by cluster),
  dens as (select id, cluster, core, case when cluster = -1 then 0.0 else 1 - core / top end as probability from dc left join tp using (cluster))"""


def density(spark, d):
    return K.density_clusters(vectors(spark, d), 5, 8, eps_quantile=0.6)


@query("k4_density_clusters", f"with {_DENSITY} select id, cluster, round(core, 6) as core, round(probability, 6) + 0.0 as probability from dens")
def k4(spark, d):
    c = density(spark, d)
    return c.select("id", "cluster", F.round("core", 6).alias("core"), (F.round("probability", 6) + F.lit(0.0)).alias("probability"))


@query(
    "k5_cluster_score",
    f"with {_DENSITY} select count(distinct cluster) as n_labels, round(count(*) filter (probability < 0.05) / count(*)::double, 9) as cost from dens",
)
def k5(spark, d):
    return K.cluster_score(density(spark, d)).withColumn("cost", F.round("cost", 9))


@query("k6_cluster_random_search")
def k6(spark, d):
    # the ranges come from the data: label values as sample and size choices
    v = vectors(spark, d)
    ranges = v.agg(
        F.array_sort(F.transform(F.collect_set("label"), lambda x: x % 3 + 4)).alias("min_samples"),
        F.array_sort(F.transform(F.collect_set("label"), lambda x: x % 2 * 5 + 5)).alias("min_cluster_size"),
    )
    from shelfwise.operators.relational import param_grid
    from shelfwise.operators.sampling import sample_params

    grid = param_grid(ranges, ["min_samples", "min_cluster_size"]).distinct()
    return K.cluster_random_search(v, sample_params(grid, SETS, 42))


@query(
    "k7_silhouette",
    f"""with {_NEAREST}, p as (select a.id, a.cluster as ca, b.cluster as cb, sum(list_distance(x.v, y.v)) as total, count(*) as n
          from near a join near b on true join e x on x.id = a.id join e y on y.id = b.id group by all),
        s as (select id, max(total) filter (ca = cb) / nullif(max(n) filter (ca = cb) - 1, 0) as a, min(total / n) filter (ca <> cb) as b from p group by id)
        select round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) as silhouette from s""",
)
def k7(spark, d):
    return K.silhouette(clustered(spark, d), "cluster").withColumn("silhouette", F.round("silhouette", 6))


@query(
    "k9_cluster_category_table",
    f"""with {_NEAREST}, c as (select cluster, label % 5 as category, count(*) as n from near group by all)
        select cluster, sum(n)::bigint as n, arg_min(category, (-n, category)) as top_category, round(max(n) / sum(n)::double, 9) as purity from c group by cluster""",
)
def k9(spark, d):
    c = clustered(spark, d).withColumn("category", F.col("label") % 5)
    return K.cluster_category_table(c, "cluster", "category").withColumn("purity", F.round("purity", 9))
