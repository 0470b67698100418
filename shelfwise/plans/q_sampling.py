"""Top-k, samples, splits and bootstrap with their SQL twins."""

from pyspark.sql import functions as F

from shelfwise.functions import vectors as V
from shelfwise.operators import sampling as W
from shelfwise.plans import standins as D
from shelfwise.plans.q_relational import LABELED_PARTS, _GRID, labeled_parts, order_grid
from shelfwise.plans.registry import query, sql_hash_int, sql_hash_order, sql_uniform


def _dist_sql(n: int, order: str) -> str:
    return f"""select row_id, p_size, distance_to_center, category, rank from (
      select *, row_number() over (partition by p_size order by distance_to_center {order}, row_id) as rank from (
        select p_partkey as row_id, p_size, abs(p_partkey % 101 - 50)::double as distance_to_center, category from ({LABELED_PARTS})
        where category <> '-1')) where rank <= {n}"""


def _distance_parts(spark, d):
    return labeled_parts(spark, d).select(
        F.col("p_partkey").alias("row_id"),
        "p_size",
        F.abs(F.col("p_partkey") % 101 - 50).cast("double").alias("distance_to_center"),
        "category",
    )


@query("w1_sample_by_distance", f"select 'centroid' as mode, * from ({_dist_sql(2, 'asc')}) union all select 'edge', * from ({_dist_sql(3, 'desc')})")
def w1(spark, d):
    p = _distance_parts(spark, d)
    a = W.sample_by_distance(p, "p_size", 2, "centroid").select(F.lit("centroid").alias("mode"), "*")
    b = W.sample_by_distance(p, "p_size", 3, "edge").select(F.lit("edge").alias("mode"), "*")
    return a.unionByName(b)


@query(
    "w2_sample_per_group",
    f"""select p_partkey, p_size, category from ({LABELED_PARTS}) where category <> '-1'
        qualify row_number() over (partition by category order by {sql_hash_order('p_partkey', 42)}, p_partkey) <= 30""",
)
def w2(spark, d):
    p = labeled_parts(spark, d).select("p_partkey", "p_size", "category")
    return W.sample_per_group(p, "category", 30, 42, "p_partkey", "category", strict=True)


@query(
    "w3_top_n_with_other",
    """with c as (select p_name, count(*) as n from part group by p_name), r as (select *, row_number() over (order by n desc, p_name) as k from c)
       select case when k <= 20 then p_name else 'Other' end as p_name, sum(n)::bigint as n from r group by 1""",
)
def w3(spark, d):
    return W.top_n_with_other(D.table(spark, d, "part"), "p_name", 20)


@query(
    "w4_top_n_per_group",
    """select c_mktsegment, c_nationkey, n, rank from (
         select *, row_number() over (partition by c_mktsegment order by n desc, c_nationkey) as rank from (
           select c_mktsegment, c_nationkey, count(*) as n from customer group by all)) where rank <= 10""",
)
def w4(spark, d):
    return W.top_n_per_group(D.table(spark, d, "customer"), "c_mktsegment", "c_nationkey", 10)


@query(
    "w5_top_features",
    "select p_name as feature, round(avg(p_size), 9) as importance from part group by p_name order by avg(p_size) desc, p_name limit 50",
)
def w5(spark, d):
    imp = D.table(spark, d, "part").select(F.col("p_name").alias("feature"), F.col("p_size").alias("importance"))
    return W.top_features(imp, 50).withColumn("importance", F.round("importance", 9))


@query(
    "w6_leaderboard",
    """select *, row_number() over (order by score desc, l_suppkey)::int as position from (
         select l_suppkey, sum(cast(round(l_extendedprice * 100) as bigint))::bigint as score from lineitem group by l_suppkey)
    """,
)
def w6(spark, d):
    runs = D.table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("score")
    )
    return W.leaderboard(runs, "score", ["l_suppkey"])


@query("w7_sample_rows", f"select o_orderkey, o_totalprice from orders order by {sql_hash_order('o_orderkey', 42)}, o_orderkey limit 500")
def w7(spark, d):
    return W.sample_rows(D.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 500, 42, "o_orderkey")


def _split_sql(table: str, key: str, label: str, frac: float, seed: int) -> str:
    return f"""select {key}, {label}, row_number() over (partition by {label} order by {sql_hash_order(key, seed)}, {key})
        <= floor(count(*) over (partition by {label}) * {frac}::double + 0.5) as in_first from {table}"""


@query(
    "w8_stratified_fraction",
    f"select p_partkey, category from ({_split_sql(f'({LABELED_PARTS})', 'p_partkey', 'category', 0.3, 42)}) where in_first",
)
def w8(spark, d):
    return W.stratified_fraction(labeled_parts(spark, d).select("p_partkey", "category"), "category", 0.3, 42, "p_partkey")


@query(
    "w9_bootstrap",
    f"""with p as (select doc_id, row_number() over (order by {sql_hash_order('doc_id', 42)}, doc_id) as position from labels),
        n as (select count(*) as n from labels),
        g as (select position as draw, b.range::int as b from p, range(50) b),
        x as (select b, draw, {sql_hash_int("concat(b, '-', draw)", 42)} % n + 1 as position from g, n)
        select b, draw, doc_id from x join p using (position)""",
)
def w9(spark, d):
    return W.bootstrap(D.table(spark, d, "labels").select("doc_id"), 50, 42, "doc_id").select("b", "draw", "doc_id")


_POISSON = f"[{', '.join(f'{x}::bigint' for x in W.POISSON)}]"


@query(
    "w9_bootstrap_poisson",
    f"""with g as (select doc_id, b.range as b from labels, range(50) b),
        x as (select doc_id, b, len(list_filter({_POISSON}, lambda x: x <= {sql_hash_int("concat(doc_id, '-', b)", 42)})) as n from g)
        select doc_id, string_agg(n::varchar, ',' order by b) as times from x group by doc_id""",
)
def w9_poisson(spark, d):
    rows = W.poisson_weights(D.table(spark, d, "labels").select("doc_id"), 50, 42, "doc_id")
    return rows.select("doc_id", F.array_join(F.col("times").cast("array<string>"), ",").alias("times"))


@query("w10_head", "select doc_id, lang, source from documents order by doc_id limit 5")
def w10(spark, d):
    return W.head(D.table(spark, d, "documents").select("doc_id", "lang", "source"), 5, "doc_id")


_TOKEN = "concat(status, '/', priority, '/', flag)"


@query(
    "w11_sample_params",
    f"""with s as (select *, {_TOKEN} as token from ({_GRID}) order by {sql_hash_order(_TOKEN, 7)} limit 20)
        select status, priority, flag, round(0.05 + 0.25 * {sql_uniform('token', 1)}, 9) as learning_rate,
          (10 + {sql_hash_int('token', 2)} % 990)::int as n_estimators, (['gini', 'entropy'])[{sql_hash_int('token', 3)} % 2 + 1] as criterion from s""",
)
def w11(spark, d):
    picked = W.sample_params(order_grid(spark, d).select("status", "priority", "flag"), 20, 7)
    token = F.concat_ws("/", "status", "priority", "flag")
    return picked.select(
        "*",
        F.round(W.draw_uniform(token, 0.05, 0.25, 1), 9).alias("learning_rate"),
        W.draw_int(token, 10, 1000, 2).alias("n_estimators"),
        W.draw_choice(token, ["gini", "entropy"], 3).alias("criterion"),
    )


# -- splits -------------------------------------------------------------------
@query("c1_stratified_split", _split_sql("embeddings", "vec_id", "label", 0.8, 42))
def c1(spark, d):
    return W.with_split(D.table(spark, d, "embeddings").select("vec_id", "label"), "label", 0.8, 42, "vec_id")


@query(
    "c2_labeled_fraction",
    f"""with train as (select vec_id, label from ({_split_sql('embeddings', 'vec_id', 'label', 0.8, 42)}) where in_first)
        select vec_id, label from ({_split_sql('train', 'vec_id', 'label', 0.4, 42)}) where in_first""",
)
def c2(spark, d):
    train, _ = W.stratified_split(D.table(spark, d, "embeddings").select("vec_id", "label"), "label", 0.8, 42, "vec_id")
    return W.labeled_fraction(train, "label", 0.4, 42, "vec_id")


@query(
    "c3_stratified_kfold",
    f"""select o_orderkey, o_orderstatus, ((row_number() over (partition by o_orderstatus order by {sql_hash_order('o_orderkey', 42)}, o_orderkey) - 1) % 5)::int as fold
        from orders""",
)
def c3(spark, d):
    return W.stratified_kfold(D.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", 5, 42, "o_orderkey")
