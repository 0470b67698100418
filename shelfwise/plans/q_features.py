"""Encoders, balancing and projections with their SQL twins."""

from pyspark.sql import functions as F

from shelfwise.functions.vectors import as_doubles
from shelfwise.operators.categories import CategoryIndex
from shelfwise.operators import balance as B
from shelfwise.operators import features as E
from shelfwise.plans import standins as D
from shelfwise.plans.q_scalars import TOKENS_SQL
from shelfwise.plans.registry import query, sql_hash_int, sql_hash_order, sql_uniform

_STATUS = ["F", "O", "P"]
_ONE_HOT = ", ".join(f"(o_orderstatus = '{s}')::double as o_orderstatus_{s}" for s in _STATUS)


@query("e1_one_hot", f"select o_orderkey, {_ONE_HOT} from orders")
def e1(spark, d):
    o = D.table(spark, d, "orders")
    enc = E.OneHot.fit(o, ["o_orderstatus"])
    return o.select("o_orderkey", *[c.alias(n) for n, c in enc.columns().items()])


@query(
    "e1_category_index",
    """with c as (select distinct 0 as c, null::double as x, o_orderstatus as v from orders union all
          select distinct 1, o_custkey::double, o_custkey::varchar from orders union all select distinct 2, null, o_orderpriority from orders),
        i as (select c, v, row_number() over (order by c, x, v) - 1 as position from c where v is not null),
        r as (select o_orderkey, unnest([0, 1, 2]) as c, unnest([o_orderstatus, o_custkey::varchar, o_orderpriority]) as v from orders)
        select o_orderkey, string_agg(position::varchar, ',' order by position) as indices from r join i using (c, v) group by o_orderkey""",
)
def e1_index(spark, d):
    o = D.table(spark, d, "orders")
    index = CategoryIndex.fit(o, ["o_orderstatus", "o_custkey", "o_orderpriority"])
    out = index.transform(o, "o_orderkey")
    return out.select("o_orderkey", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"))


def _scaled(c: str, table: str, value: str | None = None) -> str:
    v = value or c
    return f"""({v} - (select quantile_cont({v}, 0.5) from {table})) / (select case when quantile_cont({v}, 0.75) = quantile_cont({v}, 0.25)
        then 1 else quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25) end from {table})"""


@query(
    "e2_robust_scale",
    f"""select l_orderkey, l_linenumber, round({_scaled('l_extendedprice', 'lineitem')}, 6) + 0.0 as price,
        round({_scaled('l_quantity', 'lineitem')}, 6) + 0.0 as quantity from lineitem""",
)
def e2(spark, d):
    li = D.table(spark, d, "lineitem")
    sc = E.RobustScale.fit(li, ["l_extendedprice", "l_quantity"])
    z = F.lit(0.0)
    return li.select(
        "l_orderkey",
        "l_linenumber",
        (F.round(sc.column("l_extendedprice"), 6) + z).alias("price"),
        (F.round(sc.column("l_quantity"), 6) + z).alias("quantity"),
    )


@query(
    "e3_numcat_pipeline",
    f"""select o_orderkey, {_ONE_HOT}, round({_scaled('o_totalprice', 'orders', 'ln(1 + o_totalprice)')}, 6) + 0.0 as o_totalprice,
        round({_scaled('o_custkey', 'orders')}, 6) + 0.0 as o_custkey from orders""",
)
def e3(spark, d):
    o = D.table(spark, d, "orders")
    p = E.numcat_pipeline(o, ["o_orderstatus"], ["o_totalprice", "o_custkey"], ["o_totalprice"])
    t = p.transform_named(o, ["o_orderkey"])
    return t.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("o_totalprice", "o_custkey")})


_TRAIN = f"""t as (select o_orderkey, o_orderstatus, o_totalprice, row_number() over (partition by o_orderstatus
   order by {sql_hash_order('o_orderkey', 42)}, o_orderkey) <= floor(count(*) over (partition by o_orderstatus) * 0.8::double + 0.5) as train from orders),
   tr as (select ln(1 + o_totalprice) as v from t where train),
   q as (select quantile_cont(v, 0.5) as m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) as w from tr)"""


@query(
    "e4_ssl_pipeline",
    f"with {_TRAIN} select o_orderkey, {_ONE_HOT}, round((ln(1 + o_totalprice) - m) / w, 6) + 0.0 as o_totalprice from t, q where not train",
)
def e4(spark, d):
    from shelfwise.operators.sampling import stratified_split

    train, test = stratified_split(D.table(spark, d, "orders"), "o_orderstatus", 0.8, 42, "o_orderkey")
    p = E.ssl_pipeline(train, ["o_orderstatus"], ["o_totalprice"])
    t = p.transform_named(test, ["o_orderkey"])
    return t.withColumn("o_totalprice", F.round("o_totalprice", 6) + F.lit(0.0))


# the fitted features of documents: a column per language, the scaled length, a weight per kept term
_TEXT_COUNTS = f"c as (select doc_id, term, count(*) as tf from (select doc_id, unnest({TOKENS_SQL.format(c='text')}) as term from documents) group by all)"
_TEXT_VOCAB = f"""{_TEXT_COUNTS}, n as (select count(*) as n from documents),
  v as (select term, count(*) as df from c group by term), k as (select term from v, n where df >= n * 0.005::double and df <= n * 0.99::double),
  l as (select lang, row_number() over (order by lang) - 1 as i from (select distinct lang from documents where lang is not null)),
  w as (select (select count(*) from l) as langs, (select count(*) from k) as terms)"""


@query("e4_ssl_pipeline_text", f"with {_TEXT_VOCAB} select doc_id, (langs + 1 + terms)::int as width from documents, w")
def e4_text(spark, d):
    docs = D.table(spark, d, "documents")
    p = E.ssl_pipeline(docs, ["lang"], ["n_chars"], "text", "doc_id")
    from pyspark.ml.functions import vector_to_array

    t = p.transform(docs, keep=["doc_id"])
    return t.select("doc_id", F.size(vector_to_array("features")).alias("width"))


@query(
    "e5_feature_names",
    f"""with {_TEXT_VOCAB} select i::int as position, concat('lang_', lang) as feature from l
        union all select langs::int, 'n_chars' from w
        union all select (langs + 1 + t)::int, concat('text_', t) from w, (select unnest(range((select terms from w))) as t)""",
)
def e5(spark, d):
    docs = D.table(spark, d, "documents")
    p = E.ssl_pipeline(docs, ["lang"], ["n_chars"], "text", "doc_id")
    return spark.createDataFrame(list(enumerate(p.feature_names())), "position int, feature string")


@query(
    "e6_encode_label",
    """with c as (select o_orderpriority, row_number() over (order by o_orderpriority) - 1 as code from (select distinct o_orderpriority from orders))
       select o_orderkey, code::int as code, o_orderpriority as decoded from orders join c using (o_orderpriority)""",
)
def e6(spark, d):
    o = D.table(spark, d, "orders")
    codec = E.LabelCodec.fit(o, "o_orderpriority")
    coded = o.select("o_orderkey", codec.encode("o_orderpriority").alias("code"))
    return coded.withColumn("decoded", codec.decode("code"))


@query("e7_binarize_label", "select vec_id, label, " + ", ".join(f"(label = {c})::int as is_{c}" for c in range(10)) + " from embeddings")
def e7(spark, d):
    return E.binarize_label(D.table(spark, d, "embeddings").select("vec_id", "label"), "label", range(10))


@query(
    "e8_class_weights",
    """with c as (select quality, count(*) as n from labels group by quality)
       select doc_id, quality, round((select sum(n) from c) / ((select count(*) from c) * n::double), 9) as weight from labels join c using (quality)""",
)
def e8(spark, d):
    w = B.with_class_weight(D.table(spark, d, "labels").select("doc_id", "quality"), "quality")
    return w.withColumn("weight", F.round("weight", 9))


@query(
    "e9_select_by_importance",
    """with i as (select p_name as feature, avg(p_size) as importance from part group by p_name)
       select feature, round(importance, 9) as importance from i where importance >= (select avg(importance) from i)""",
)
def e9(spark, d):
    # importance per name stands for a fitted model's importances, one row per feature
    imp = D.table(spark, d, "part").groupBy(F.col("p_name").alias("feature")).agg(F.avg("p_size").alias("importance"))
    mean = imp.agg(F.avg("importance")).scalar()
    return imp.filter(F.col("importance") >= mean).withColumn("importance", F.round("importance", 9))


def vectors(spark, d):
    return D.table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), as_doubles("embedding").alias("features"), "label")


@query(
    "e10_pca_covariance",
    """with v as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings),
       m as (select i, avg(x) as mu from v group by i), c as (select vec_id, i, x - mu as x from v join m using (i))
       select a.i::int as i, b.i::int as j, round(sum(a.x * b.x) / ((select count(*) from embeddings) - 1), 7) + 0.0 as cov
       from c a join c b using (vec_id) group by a.i, b.i""",
)
def e10(spark, d):
    c = E.covariance(vectors(spark, d))
    return c.withColumn("cov", F.round("cov", 7) + F.lit(0.0))


@query("e10_pca_projection")
def e10_projection(spark, d):
    data = vectors(spark, d)
    p = E.Pca.fit(data, 0.95)
    return p.transform(data).select("row_id", F.size("pca").alias("components"), F.col("pca")[0].alias("first"))


# three classes of unequal size
_IMB = "case when label < 6 then 0 when label < 9 then 1 else 2 end"


def imbalanced(spark, d):
    y = F.when(F.col("label") < 6, 0).when(F.col("label") < 9, 1).otherwise(2)
    return vectors(spark, d).withColumn("y", y)


def _smote_sql(base_filter: str) -> str:
    return f"""with e as (select vec_id as id, embedding::double[] as v, {_IMB} as y from embeddings),
  sz as (select y, count(*) as n from e group by y), mx as (select max(n) as top from sz),
  pair as (select a.y, a.id as l, b.id as r, list_distance(a.v, b.v) as d, row_number() over (partition by a.id order by list_distance(a.v, b.v), b.id) as rank
           from e a join e b on a.y = b.y and a.id <> b.id),
  allp as (select a.id as l, b.y as oy, a.y as y, row_number() over (partition by a.id order by list_distance(a.v, b.v), b.id) as rank
           from e a join e b on a.id <> b.id),
  border as (select l as id from allp where rank <= 10 group by l having count(*) filter (oy <> y) * 2 >= 10 and count(*) filter (oy <> y) < 10),
  base as (select * from e {base_filter}),
  bn as (select y, count(*) as nb from base group by y),
  pos as (select y, id, row_number() over (partition by y order by {sql_hash_order('id', 42)}, id) as position from base),
  dr as (select y, nb, unnest(range(top - n)) as draw from sz join bn using (y), mx where n < top),
  tk as (select *, concat(y, '-', draw) as token from dr),
  pk as (select y, draw, {sql_hash_int('token', '42base')} % nb + 1 as position, {sql_hash_int('token', '42near')} % 5 + 1 as rank, {sql_uniform('token', '42step')} as step from tk)
  select pk.y::int as y, pk.draw, pos.id as base, pair.r as neighbor, round(step, 9) as step,
    round(a.v[1] + step * (b.v[1] - a.v[1]), 6) + 0.0 as first, round(a.v[64] + step * (b.v[64] - a.v[64]), 6) + 0.0 as last
  from pk join pos using (y, position) join pair on pair.l = pos.id and pair.rank = pk.rank join e a on a.id = pos.id join e b on b.id = pair.r"""


def _smote_frame(s):
    return s.select(
        "y", "draw", "base", "neighbor", F.round("step", 9).alias("step"),
        (F.round(F.col("features")[0], 6) + F.lit(0.0)).alias("first"),
        (F.round(F.col("features")[63], 6) + F.lit(0.0)).alias("last"),
    )


@query("e11_smote", _smote_sql(""))
def e11(spark, d):
    return _smote_frame(B.smote_synthetic(imbalanced(spark, d), "y"))


@query("e12_borderline_smote", _smote_sql("where id in (select id from border)"))
def e12(spark, d):
    return _smote_frame(B.borderline_smote_synthetic(imbalanced(spark, d), "y"))


@query("e13_nan_check", "select count(*) as n, count(*) filter (label = 3) as n_nan from embeddings")
def e13(spark, d):
    bad = F.when(F.col("label") == 3, F.transform("features", lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x)))
    v = vectors(spark, d).withColumn("features", F.coalesce(bad, F.col("features")))
    return E.nan_check(v)
