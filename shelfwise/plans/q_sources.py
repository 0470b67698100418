"""Sources and sinks: write below the shared folder, read back."""

from pyspark.sql import functions as F

from shelfwise.operators import products as P
from shelfwise.plans import standins as D
from shelfwise.plans.registry import query
from shelfwise.plans.q_relational import LABELED_PARTS, labeled_parts
from shelfwise.session import scratch_path
from shelfwise.sources import runs as SR
from shelfwise.sources import tables as ST


@query("s1_read_delimited", f"select * from ({D.RAW_LINES})")
def s1(spark, d):
    path = scratch_path(spark, "s1")
    ST.write_table(D.raw_lines(spark, d), path, "csv", ";")
    # surrounding blanks are part of the data and must survive
    return ST.read_delimited(spark, path, ";", ST.ORDER_LINE_SCHEMA)


@query("s2_read_comma", "select p_partkey, p_name, p_brand, p_size, p_retailprice from part")
def s2(spark, d):
    path = scratch_path(spark, "s2")
    part = D.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    ST.write_table(part, path, "csv")
    return ST.read_delimited(spark, path, ",", part.schema)


@query(
    "s3_read_union",
    "select c_custkey as id, c_name as name from customer union all select s_suppkey, s_name from supplier",
)
def s3(spark, d):
    a, b = scratch_path(spark, "s3a"), scratch_path(spark, "s3b")
    c = D.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    ST.write_table(c, a, "csv", ";")
    ST.write_table(s, b, "csv", ";")
    return ST.read_union(spark, [a, b], ";", c.schema)


@query(
    "s4_scan_runs",
    "select doc_id as document, quality as topic, concat('neighbors_', case when toxic = 1 then '50' else '15' end, '_cluster_10') as topic_set_id from labels",
)
def s4(spark, d):
    root = scratch_path(spark, "s4")
    labels = D.table(spark, d, "labels")
    for toxic, n in ((0, 15), (1, 50)):
        rows = labels.filter(F.col("toxic") == toxic).select(F.col("doc_id").alias("document"), F.col("quality").alias("topic"))
        ST.write_table(rows, f"{root}/topic_doc_neighbors_{n}_cluster_10.csv", "csv")
    return SR.scan_runs(spark, root, "topic_doc_neighbors*", "document long, topic int")


_RUN_DOC = """select c_mktsegment as model, c_nationkey % 5 * 20 + 20 as pct, count(*) as n, min(c_acctbal) as low, max(c_acctbal) as high
    from customer group by all"""


def run_documents(spark, d):
    per = D.table(spark, d, "customer").groupBy(
        F.col("c_mktsegment").alias("model"), (F.col("c_nationkey") % 5 * 20 + 20).alias("pct")
    )
    return per.agg(
        F.count("*").alias("n"), F.struct(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high")).alias("range")
    )


@query("s5_read_run_json", f"select model, n, low, high, pct as labeled_percentage from ({_RUN_DOC})")
def s5(spark, d):
    root = scratch_path(spark, "s5")
    docs = run_documents(spark, d)
    paths = [f"{root}/segment_results_{pct}" for pct in (20, 40, 60, 80, 100)]
    for pct, path in zip((20, 40, 60, 80, 100), paths):
        SR.write_run_json(docs.filter(F.col("pct") == pct).drop("pct"), path)
    back = SR.read_run_json(spark, paths, "model string, n long, range struct<low: double, high: double>")
    return back.select("model", "n", "range.low", "range.high", "labeled_percentage")


@query("s6_write_table", "select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem")
def s6(spark, d):
    path = scratch_path(spark, "s6")
    ST.write_table(D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), path)
    return spark.read.parquet(path)


@query("s7_write_labeled", f"select p_partkey, category from ({LABELED_PARTS}) where category <> '-1'")
def s7(spark, d):
    path = scratch_path(spark, "s7")
    ST.write_labeled(labeled_parts(spark, d).select("p_partkey", "category"), path)
    return spark.read.parquet(path)


@query("s8_write_run_json", f"select model, pct as labeled_percentage, n, high - low as spread from ({_RUN_DOC})")
def s8(spark, d):
    path = scratch_path(spark, "s8")
    docs = run_documents(spark, d)
    SR.write_run_json(docs, path)
    back = spark.read.option("multiLine", True).schema(docs.schema).json(path)
    return back.select(
        "model", F.col("pct").alias("labeled_percentage"), "n", (F.col("range.high") - F.col("range.low")).alias("spread")
    )


@query("s9_write_by_config", "select doc_id, lang, source from documents")
def s9(spark, d):
    path = scratch_path(spark, "s9")
    ST.write_by_config(D.table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], path)
    return spark.read.schema("doc_id long, lang string, source string").parquet(path)


@query("s10_write_pseudo_labels", "select event_id as row_id, event_type as model, cast(floor(value) as int) as label from events")
def s10(spark, d):
    path = scratch_path(spark, "s10")
    e = D.table(spark, d, "events").select(
        F.col("event_id").alias("row_id"), F.col("event_type").alias("model"), F.floor("value").cast("int").alias("label")
    )
    ST.write_pseudo_labels(e, path)
    return spark.read.parquet(path)


@query(
    "s11_promote_best",
    """with n as (select source as topic_set_id, count(*) as score from documents group by source),
       b as (select topic_set_id from n order by score desc, topic_set_id limit 1)
       select doc_id, source as topic_set_id from documents where source in (select topic_set_id from b)""",
)
def s11(spark, d):
    docs = D.table(spark, d, "documents").select("doc_id", F.col("source").alias("topic_set_id"))
    best = docs.groupBy("topic_set_id").agg(F.count("*").alias("score")).orderBy(F.desc("score"), "topic_set_id").limit(1)
    return SR.promote_best(docs, best)


@query(
    "s12_save_embeddings",
    "select vec_id, len(embedding)::int as width, round(list_sum(embedding::double[]), 6) as total from embeddings",
)
def s12(spark, d):
    path = scratch_path(spark, "s12")
    ST.save_embeddings(D.table(spark, d, "embeddings").select("vec_id", "embedding"), path)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return ST.load_embeddings(spark, path).select("vec_id", F.size("embedding").alias("width"), F.round(total, 6).alias("total"))


@query(
    "s13_save_params",
    f"select model, max(n) as best_n from ({_RUN_DOC}) group by model",
)
def s13(spark, d):
    path = scratch_path(spark, "s13")
    SR.save_params(run_documents(spark, d).groupBy("model").agg(F.max("n").alias("best_n")), path)
    return spark.read.parquet(path)
