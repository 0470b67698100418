"""Projections, filters, joins and reshaping over the driver's tables."""

from pyspark.sql import functions as F

from shelfwise.functions import scalars as S
from shelfwise.operators import products as P
from shelfwise.operators import relational as R
from shelfwise.plans import standins as D
from shelfwise.plans.registry import query

LETTER = "substr('ABCDE', cast({c} % 5 as int) + 1, 1)"
# manual label for every 8th part, automatic label for two parts in three
LABELED_PARTS = """
select p_partkey, p_name, p_size,
       case when p_partkey % 8 = 0 then substr('ABCDE', cast(p_partkey % 5 as int) + 1, 1) else '-1' end as category,
       case when p_partkey % 3 = 0 then '-1' else substr('ABCDE', cast(p_size % 5 as int) + 1, 1) end as category_bertopic
from part
"""


def labeled_parts(spark, d):
    return D._sql(spark, d, LABELED_PARTS, ("part",))


@query("p1_drop_columns", "select p_partkey, p_name, p_brand, p_retailprice from part")
def p1(spark, d):
    return R.drop_columns(D.table(spark, d, "part"), ["p_type", "p_size"])


@query("p2_rename_columns", "select s_suppkey as id, s_name as name, s_nationkey, s_acctbal from supplier")
def p2(spark, d):
    return R.rename_columns(D.table(spark, d, "supplier"), {"s_suppkey": "id", "s_name": "name"})


@query("p3_select_columns", "select o_orderkey, o_orderstatus from orders")
def p3(spark, d):
    return R.select_columns(D.table(spark, d, "orders"), ["o_orderkey", "o_orderstatus"])


@query("p4_with_provenance", "select c_custkey, 'no_SMOTE' as balancing from customer")
def p4(spark, d):
    return R.with_provenance(D.table(spark, d, "customer").select("c_custkey"), "balancing", "no_SMOTE")


@query(
    "p5_filter_not_in",
    """select l_orderkey, l_linenumber, nullif(l_suppkey, 3) as suppkey from lineitem
       where nullif(l_suppkey, 3) is null or nullif(l_suppkey, 3) not in (1, 5, 9)""",
)
def p5(spark, d):
    li = D.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif(F.col("l_suppkey"), F.lit(3)).alias("suppkey")
    )
    return R.filter_not_in(li, "suppkey", [1, 5, 9])


@query("p6_filter_not_matching", "select p_partkey, p_name from part where not regexp_matches(p_name, '(?i)GIZMO|blue')")
def p6(spark, d):
    return R.filter_not_matching(D.table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "GIZMO|blue")


@query("p7_drop_null", "select event_id, nullif(event_type, 'error') as kind from events where event_type <> 'error'")
def p7(spark, d):
    e = D.table(spark, d, "events").select("event_id", F.nullif(F.col("event_type"), F.lit("error")).alias("kind"))
    return R.drop_null(e, ["kind"])


@query(
    "p8_split_labeled",
    f"select p_partkey, category, category <> '-1' as labeled from ({LABELED_PARTS})",
)
def p8(spark, d):
    known, unknown = R.split_labeled(labeled_parts(spark, d).select("p_partkey", "category"))
    return known.withColumn("labeled", F.lit(True)).unionByName(unknown.withColumn("labeled", F.lit(False)))


@query(
    "p9_label_disagreements",
    f"""select p_partkey, category, category_bertopic, category_bertopic <> '-1' as both_known
        from ({LABELED_PARTS}) where category <> '-1' and category <> category_bertopic""",
)
def p9(spark, d):
    parts = labeled_parts(spark, d).select("p_partkey", "category", "category_bertopic")
    return R.label_disagreements(parts).withColumn("both_known", F.col("category_bertopic") != "-1")


@query(
    "p10_reconcile_labels",
    f"select p_partkey, case when category <> '-1' then category else category_bertopic end as category from ({LABELED_PARTS})",
)
def p10(spark, d):
    return R.reconcile_labels(labeled_parts(spark, d)).select("p_partkey", "category")


@query(
    "p11_override_by_text",
    f"""select p_partkey, case when contains(p_name, 'gear') then 'E' when contains(p_name, 'red') then 'A'
        else category end as category from ({LABELED_PARTS})""",
)
def p11(spark, d):
    rules = (("red", "A"), ("gear", "E"))
    parts = labeled_parts(spark, d).withColumn("p_name", F.upper("p_name"))
    return R.override_by_text(parts, "p_name", "category", rules).select("p_partkey", "category")


@query("p12_fill_missing", "select o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '-1') as status from orders")
def p12(spark, d):
    o = D.table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"))
    return R.fill_missing(o, "-1", ["status"])


@query(
    "p13_having",
    """select l_partkey, sum(l_quantity)::bigint as quantity_sum, sum(cast(round(l_extendedprice * 100) as bigint))::bigint as cents
       from lineitem group by l_partkey having sum(l_quantity) >= 700 and sum(cast(round(l_extendedprice * 100) as bigint)) >= 100000000""",
)
def p13(spark, d):
    g = D.table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("quantity_sum"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"),
    )
    return R.having(g, {"quantity_sum": 700, "cents": 100000000})


@query("p14_select_by_position", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate from orders")
def p14(spark, d):
    return R.select_by_position(D.table(spark, d, "orders"), None, -1)


@query(
    "p15_pretty_names",
    'select s_suppkey as "s suppkey", s_name as "s name", replace(concat(\'supp_\', s_name), \'_\', \' \') as feature from supplier',
)
def p15(spark, d):
    s = R.pretty_names(D.table(spark, d, "supplier").select("s_suppkey", "s_name"))
    return s.withColumn("feature", R.pretty_values(F.concat(F.lit("supp_"), F.col("s name"))))


@query(
    "p16_decode_class",
    "select vec_id, case when label < 5 then substr('ABCDE', label + 1, 1) else cast(label as varchar) end as class from embeddings",
)
def p16(spark, d):
    return D.table(spark, d, "embeddings").select("vec_id", R.decode_class("label").alias("class"))


@query("p17_feature_subset", "select p_partkey, p_brand, p_type, p_size, p_retailprice from part")
def p17(spark, d):
    return R.feature_subset(D.table(spark, d, "part"), ["p_brand", "p_type"], ["p_size", "p_retailprice"], ["p_partkey"])


# -- joins -----------------------------------------------------------------
@query(
    "j1_attach_labels",
    f"""select l_orderkey, l_linenumber, l_partkey, coalesce(m.category, '-1') as category
        from lineitem left join (select cast(split_part(OBITNO, ' ', 1) as bigint) as k, category from ({D.MAPPING})) m on l_partkey = m.k""",
)
def j1(spark, d):
    li = D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    lines = li.withColumn("OBITNO", F.concat(F.lit(" "), F.col("l_partkey"), F.lit("  ")))
    return P.label_lines(lines, D.mapping(spark, d)).drop("OBITNO")


@query(
    "j2_attach_topic_category",
    """with t as (select lang as topic, case when count(*) % 2 = 0 then 'A' else 'B' end as category
                 from documents where lang <> 'de' group by lang)
       select doc_id, lang as topic, category from documents left join t on lang = topic""",
)
def j2(spark, d):
    docs = D.table(spark, d, "documents").select("doc_id", F.col("lang").alias("topic"))
    topics = docs.filter("topic <> 'de'").groupBy("topic").agg(F.count("*").alias("n"))
    topics = topics.select("topic", F.when(F.col("n") % 2 == 0, "A").otherwise("B").alias("category"))
    return R.attach_topic_category(docs, topics)


@query(
    "j3_attach_by_position",
    "select d.doc_id as row_id, lang, quality from documents d left join labels l on d.doc_id = l.doc_id",
)
def j3(spark, d):
    docs = D.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    labels = D.table(spark, d, "labels").select(F.col("doc_id").alias("row_id"), "quality")
    return R.attach_by_position(docs, labels)


@query(
    "j4_pair_runs",
    """with t as (select concat('neighbors_', doc_id % 50) as topic_set_id, count(*) as topics from documents group by 1),
            p as (select concat('neighbors_', doc_id % 80) as topic_set_id, sum(quality) as docs from labels group by 1)
       select topic_set_id, topics, docs::bigint as docs from t join p using (topic_set_id)""",
)
def j4(spark, d):
    run = lambda m: F.concat(F.lit("neighbors_"), F.col("doc_id") % m).alias("topic_set_id")
    t = D.table(spark, d, "documents").groupBy(run(50)).agg(F.count("*").alias("topics"))
    p = D.table(spark, d, "labels").groupBy(run(80)).agg(F.sum("quality").alias("docs"))
    return R.pair_runs(t, p)


KEYWORD_SQL = """select keyword, min(category) as category from (
    select split_part(p_name, ' ', 2) as keyword, substr('ABCDE', cast(ascii(split_part(p_name, ' ', 2)) % 5 as int) + 1, 1) as category from part
    union all
    select p_name, substr('ABCDE', cast(length(p_name) % 5 as int) + 1, 1) from part where p_name like 'red%' or p_name like '%ring')
    group by keyword"""


def keywords(spark, d):
    """Keyword dictionary from part names: single words and some bigrams."""
    return D._sql(spark, d, KEYWORD_SQL, ("part",))


@query(
    "j5_keyword_match",
    f"""with k as ({KEYWORD_SQL}), w as (select distinct p_partkey, unnest(string_split(p_name, ' ')) as keyword from part
        union select p_partkey, p_name from part)
        select p_partkey, keyword, category from w join k using (keyword)""",
)
def j5(spark, d):
    from shelfwise.operators.topics import keyword_match

    parts = D.table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    words = parts.select("p_partkey", F.explode(F.array_union("words", S.bigrams("words"))).alias("keyword"))
    return keyword_match(words, keywords(spark, d))


@query(
    "j6_map_back_predictions",
    "select doc_id as row_id, lang, toxic as prediction from documents join labels using (doc_id)",
)
def j6(spark, d):
    data = D.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    preds = D.table(spark, d, "labels").select(F.col("doc_id").alias("row_id"), F.col("toxic").alias("prediction"))
    return R.map_back_predictions(data, preds)


@query(
    "j7_train_test_table",
    """with r as (select event_type as model, user_id % 5 as labeled_percentage, value, event_id % 4 = 0 as test from events)
       select model, labeled_percentage, round(avg(value) filter (not test), 6) as train_score,
         round(avg(value) filter (test), 6) as test_score,
         round(avg(value) filter (not test) - avg(value) filter (test), 6) as gap
       from r group by all""",
)
def j7(spark, d):
    r = D.table(spark, d, "events").select(
        F.col("event_type").alias("model"), (F.col("user_id") % 5).alias("labeled_percentage"), "value", "event_id"
    )
    t = R.train_test_table(r.filter("event_id % 4 <> 0"), r.filter("event_id % 4 = 0"), "value")
    return t.select("model", "labeled_percentage", *[F.round(c, 6).alias(c) for c in ("train_score", "test_score", "gap")])


_GRID = """select distinct s.v as status, p.v as priority, f.v as flag from
    (select distinct o_orderstatus as v from orders) s, (select distinct o_orderpriority as v from orders) p,
    (select distinct o_custkey % 4 as v from orders) f"""


def order_grid(spark, d):
    """A parameter grid whose ranges are the values found in ``orders``."""
    o = D.table(spark, d, "orders")
    ranges = o.agg(
        F.array_sort(F.collect_set("o_orderstatus")).alias("status"),
        F.array_sort(F.collect_set("o_orderpriority")).alias("priority"),
        F.array_sort(F.collect_set(F.col("o_custkey") % 4)).alias("flag"),
    )
    return R.param_grid(ranges, ["status", "priority", "flag"])


@query("j8_param_grid", _GRID)
def j8(spark, d):
    return order_grid(spark, d)


@query(
    "j9_importance_matrix",
    """select p_name as feature, coalesce(sum(p_size) filter (p_type = 'ECONOMY' and p_brand = 'Brand#1'), 0)::double as rf_20,
       coalesce(sum(p_size) filter (p_type = 'PROMO' and p_brand = 'Brand#2'), 0)::double as rf_40 from part
       where (p_type = 'ECONOMY' and p_brand = 'Brand#1') or (p_type = 'PROMO' and p_brand = 'Brand#2') group by p_name""",
)
def j9(spark, d):
    part = D.table(spark, d, "part")
    run = (
        F.when((F.col("p_type") == "ECONOMY") & (F.col("p_brand") == "Brand#1"), "rf_20")
        .when((F.col("p_type") == "PROMO") & (F.col("p_brand") == "Brand#2"), "rf_40")
    )
    imp = part.select(F.col("p_name").alias("feature"), run.alias("run"), "p_size").filter("run is not null")
    imp = imp.groupBy("feature", "run").agg(F.sum("p_size").cast("double").alias("importance"))
    return R.importance_matrix(imp, ["rf_20", "rf_40"])


@query(
    "j12_anti_semi",
    """select o_orderkey, o_custkey, true as open from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)
       union all select o_orderkey, o_custkey, false from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 5000)""",
)
def j12(spark, d):
    o = D.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = D.table(spark, d, "customer")
    semi = R.filter_in(o, "o_custkey", c.filter("c_acctbal < 0").select("c_custkey"))
    anti = R.filter_not_in(o, "o_custkey", c.filter("c_acctbal < 5000").select("c_custkey"))
    return semi.withColumn("open", F.lit(True)).unionByName(anti.withColumn("open", F.lit(False)))


# -- set operations and reshaping -------------------------------------------
@query(
    "u1_union_all",
    "select doc_id as id, text from documents union all select item_id, text from benchmark",
)
def u1(spark, d):
    a = D.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    b = D.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return R.union_all(a, b)


@query(
    "u2_union_relaxed",
    "select s_suppkey as id, s_acctbal as balance, null as segment from supplier union all select c_custkey, c_acctbal, c_mktsegment from customer",
)
def u2(spark, d):
    a = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    b = D.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    return R.union_relaxed(a, b)


@query(
    "u3_stack_labeled_unlabeled",
    "select doc_id, quality as label, quality is not null as is_labeled from documents left join labels using (doc_id)",
)
def u3(spark, d):
    docs = D.table(spark, d, "documents").select("doc_id")
    labels = D.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return R.stack_labeled_unlabeled(docs.join(labels, "doc_id"), docs.join(labels, "doc_id", "left_anti"))


@query(
    "u4_unpivot",
    """select l_orderkey, l_linenumber, 'l_discount' as variable, l_discount as value from lineitem
       union all select l_orderkey, l_linenumber, 'l_tax', l_tax from lineitem""",
)
def u4(spark, d):
    return R.unpivot(D.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


@query(
    "u5_pivot",
    """select o_custkey, max(n) filter (o_orderstatus = 'F') as "F", max(n) filter (o_orderstatus = 'O') as "O",
       max(n) filter (o_orderstatus = 'P') as "P"
       from (select o_custkey, o_orderstatus, count(*) as n from orders group by all) group by o_custkey""",
)
def u5(spark, d):
    n = D.table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return R.pivot(n, ["o_custkey"], "o_orderstatus", "n", ["F", "O", "P"])


@query(
    "u6_pivot_table",
    """select l_suppkey, round(avg(l_discount) filter (l_returnflag = 'A'), 6) as "A", round(avg(l_discount) filter (l_returnflag = 'N'), 6) as "N",
       round(avg(l_discount) filter (l_returnflag = 'R'), 6) as "R" from lineitem group by l_suppkey""",
)
def u6(spark, d):
    t = R.pivot_table(D.table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", ["l_discount"], ["A", "N", "R"])
    return t.select("l_suppkey", *[F.round(c, 6).alias(c) for c in "ANR"])


@query(
    "u7_flatten_run",
    """select c_nationkey, c_mktsegment as model, count(*) as n, round(sum(c_acctbal), 2) as total, sum(count(*)) over (partition by c_nationkey)::bigint as customers
       from customer group by c_nationkey, c_mktsegment""",
)
def u7(spark, d):
    per = D.table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")
    )
    runs = per.groupBy("c_nationkey").agg(
        F.struct(F.sum("n").alias("customers")).alias("info"),
        F.collect_list(F.struct(F.col("c_mktsegment").alias("model"), "n", "total")).alias("rows"),
    )
    lifted = R.flatten_sections(runs, ["info"], ["c_nationkey", "rows"])
    return R.flatten_list(lifted, "rows", ["c_nationkey", "customers"])


_REPORT = """select p_brand as model, p_type as class, avg(p_size) as precision, count(*)::double as support from part group by p_brand, p_type"""


@query("u8_flatten_report", f"select model, class, round(precision, 6) as precision, support from ({_REPORT})")
def u8(spark, d):
    per = D.table(spark, d, "part").groupBy("p_brand", "p_type").agg(
        F.avg("p_size").alias("precision"), F.count("*").cast("double").alias("support")
    )
    cells = per.select("p_brand", F.col("p_type").alias("class"), F.struct("precision", "support").alias("m"))
    total = per.groupBy("p_brand").agg(F.struct(F.avg("precision").alias("precision"), F.sum("support").alias("support")).alias("m"))
    rows = cells.unionByName(total.select("p_brand", F.lit("macro avg").alias("class"), "m"))
    reports = rows.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("class", "m"))).alias("report"))
    flat = R.flatten_report(reports.withColumnRenamed("p_brand", "model"), "report", ["model"])
    return flat.withColumn("precision", F.round("precision", 6))


@query(
    "u9_params_table",
    """select event_id, json_extract_string(props, '$.k') as k, event_type as kind from events""",
)
def u9(spark, d):
    e = D.table(spark, d, "events").withColumn(
        "params", F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("kind"), F.col("event_type")))
    )
    return R.params_table(e, "params", ["event_id"], ["k", "kind"])


@query(
    "u10_matrix_to_long",
    """with c as (select c_nationkey, c_custkey % 2 as t, c_custkey % 3 as p, count(*) as n from customer group by all),
       g as (select c_nationkey, t, p from (select distinct c_nationkey from customer), range(2) a(t), range(3) b(p))
       select c_nationkey, t::int as true_class, p::int as predicted_class, coalesce(n, 0) as n from g left join c using (c_nationkey, t, p)""",
)
def u10(spark, d):
    cell = lambda t, p: F.count_if((F.col("c_custkey") % 2 == t) & (F.col("c_custkey") % 3 == p))
    m = D.table(spark, d, "customer").groupBy("c_nationkey").agg(
        F.array(*[F.array(*[cell(t, p) for p in range(3)]) for t in range(2)]).alias("cm")
    )
    return R.matrix_to_long(m, "cm", ["c_nationkey"])
