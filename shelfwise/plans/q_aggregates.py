"""Grouped statistics with their SQL twins."""

from pyspark.sql import functions as F

from shelfwise.operators import aggregates as A
from shelfwise.operators import products as P
from shelfwise.plans import standins as D
from shelfwise.plans.q_scalars import clean_sql
from shelfwise.plans.registry import query

# -- product table -----------------------------------------------------------
_CLEAN_LINES = f"""
lines as (
  select trim(OBITNO) as product_id, strptime(OBRGDT, '%Y%m%d') as date, cast(try_cast(OBORQT as double) as bigint) as quantity,
    cast(replace(NET_LINE, ',', '.') as double) as price, cast(replace(MMNEWE, ',', '.') as double) as weight,
    DESCRIPT as description, trim(OBCUOR) as order_id, trim(OACUNO) as customer_id, trim(OKCSCD) as customer_country, MMITCL
  from ({D.RAW_LINES})),
map as (select split_part(OBITNO, ' ', 1) as product_id, category from ({D.MAPPING})),
clean as (
  select distinct product_id, date, quantity, price, weight, description, order_id, customer_id, customer_country,
    coalesce(category, '-1') as category
  from lines left join map using (product_id)
  where (MMITCL is null or MMITCL <> '54210') and quantity is not null and not regexp_matches(product_id, '(?i)test|work')),
parts as (
  select *, month(date) as month, quarter(date) as quarter, year(date) as year, isodow(date) - 1 as day_of_week from clean)
"""


def _mode_cte(out: str, col: str) -> str:
    return f"""m_{out} as (select product_id, {col} as {out} from (
      select product_id, {col}, row_number() over (partition by product_id order by count(*) desc, {col}) as rn
      from parts where {col} is not null group by product_id, {col}) where rn = 1)"""


_MODE_CTES = ", ".join(_mode_cte(o, c) for o, c in P.MODES.items())
_PROFILE = f"""{_CLEAN_LINES}, {_MODE_CTES},
sums as (select product_id, sum(quantity)::bigint as quantity_sum, sum(cast(round(price * 10000) as bigint))::bigint as units,
    count(distinct customer_country) as customer_country_count, count(distinct customer_id) as customer_id_count from parts group by product_id),
kept as (select *, units / 10000.0::double as price_sum from sums where quantity_sum >= 5 and units / 10000.0::double >= 50),
profile as (select product_id, description, month_mode::int as month_mode, quarter_mode::int as quarter_mode, year_mode::int as year_mode,
    day_week_mode::int as day_week_mode, unit_weight, customer_country_mode, category, quantity_sum, price_sum,
    customer_country_count, customer_id_count,
    case when 2 * (units % quantity_sum) > quantity_sum or (2 * (units % quantity_sum) = quantity_sum and (units // quantity_sum) % 2 = 1)
         then units // quantity_sum + 1 else units // quantity_sum end / 10000.0::double as unit_price_mean
  from kept {" ".join(f"join m_{o} using (product_id)" for o in P.MODES)})
"""


@query(
    "a1_product_profile",
    f"with {_PROFILE} select * replace ({clean_sql('description')} as description), description as description_original from profile",
)
def a1(spark, d):
    return P.product_table(D.raw_lines(spark, d), D.mapping(spark, d))


@query(
    "a2_mode",
    """select l_suppkey, l_quantity as l_quantity_mode from (
         select l_suppkey, l_quantity, row_number() over (partition by l_suppkey order by n desc, l_quantity) as rn
         from (select l_suppkey, l_quantity, count(*) as n from lineitem group by l_suppkey, l_quantity)) where rn = 1""",
)
def a2(spark, d):
    return A.mode_table(D.table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity")


@query(
    "a3_count_distinct",
    "select l_partkey, count(distinct l_suppkey) as l_suppkey_count from lineitem group by l_partkey",
)
def a3(spark, d):
    return A.count_distinct(D.table(spark, d, "lineitem"), ["l_partkey"], "l_suppkey")


@query(
    "a4_sum_null_as_zero",
    """select o_custkey, coalesce(sum(case when o_orderstatus = 'P' then o_orderkey end), 0)::bigint as pending from orders group by o_custkey""",
)
def a4(spark, d):
    pending = F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))
    return D.table(spark, d, "orders").groupBy("o_custkey").agg(A.sum_or_zero(pending).alias("pending"))


@query("a5_value_counts", "select source, count(*) as n from documents group by source")
def a5(spark, d):
    return A.value_counts(D.table(spark, d, "documents"), "source")


@query(
    "a6_row_count_share",
    """select count(*) as n, count(quality) as n_matching, round(count(quality) / count(*)::double, 9) as share
       from documents left join labels using (doc_id)""",
)
def a6(spark, d):
    docs = D.table(spark, d, "documents").join(D.table(spark, d, "labels"), "doc_id", "left")
    return A.row_count_and_share(docs, F.col("quality").isNotNull()).withColumn("share", F.round("share", 9))


@query("a7_group_sizes", "select lang, source, count(*) as n from documents group by lang, source")
def a7(spark, d):
    return A.group_sizes(D.table(spark, d, "documents"), ["lang", "source"])


@query(
    "a8_crosstab",
    """select l_shipmonth, round(100.0 * count(*) filter (l_returnflag = 'A') / count(*), 6) as "A",
       round(100.0 * count(*) filter (l_returnflag = 'N') / count(*), 6) as "N",
       round(100.0 * count(*) filter (l_returnflag = 'R') / count(*), 6) as "R"
       from (select month(l_shipdate)::int as l_shipmonth, l_returnflag from lineitem) group by l_shipmonth""",
)
def a8(spark, d):
    li = D.table(spark, d, "lineitem").select(F.month("l_shipdate").alias("l_shipmonth"), "l_returnflag")
    t = A.crosstab_percent(li, "l_shipmonth", "l_returnflag", ["A", "N", "R"])
    return t.select("l_shipmonth", *[F.round(c, 6).alias(c) for c in "ANR"])


_DESCRIBE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(c: str) -> str:
    return f"""select '{c}' as "column", count({c}) as count, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std,
      min({c})::double as min, round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as p50,
      round(quantile_cont({c}, 0.75), 6) as p75, max({c})::double as max from lineitem"""


@query("a9_describe", " union all ".join(_describe_sql(c) for c in _DESCRIBE_COLS))
def a9(spark, d):
    t = A.describe(D.table(spark, d, "lineitem"), _DESCRIBE_COLS)
    for c, n in (("mean", 4), ("std", 4), ("p25", 6), ("p50", 6), ("p75", 6)):
        t = t.withColumn(c, F.round(c, n))
    return t


def _corr_sql(x: str, y: str) -> str:
    return f"select '{x}' as x, '{y}' as y, round(corr({x}, {y}), 6) + 0.0 as r from lineitem"


@query("a10_corr_matrix", " union all ".join(_corr_sql(x, y) for x in _DESCRIBE_COLS for y in _DESCRIBE_COLS))
def a10(spark, d):
    t = A.corr_matrix(D.table(spark, d, "lineitem"), _DESCRIBE_COLS)
    return t.withColumn("r", F.round("r", 6) + F.lit(0.0))


@query("a11_pairwise_corr", "select round(corr(l_quantity, l_extendedprice), 6) as r from lineitem")
def a11(spark, d):
    return A.pairwise_corr(D.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").withColumn("r", F.round("r", 6))


@query(
    "a12_histogram",
    """with s as (select min(value) as lo, max(value) as hi from events), g as (select range::int as bin from range(20)),
       c as (select least(floor((value - lo) / ((hi - lo) / 20.0::double)), 19)::int as bin, count(*) as n from events, s group by 1)
       select bin, round(lo + bin * ((hi - lo) / 20.0::double), 6) as low, round(lo + (bin + 1) * ((hi - lo) / 20.0::double), 6) as high,
         coalesce(n, 0) as n from g left join c using (bin), s""",
)
def a12(spark, d):
    h = A.histogram(D.table(spark, d, "events"), "value", 20)
    return h.withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


@query(
    "a13_kde",
    """with s as (select count(*) as n, min(value) as lo, max(value) as hi, stddev_samp(value) * pow(count(*), -0.2) as h from events),
       g as (select range::int as i, lo + range * ((hi - lo) / 49.0::double) as x from range(50), s)
       select i, round(x, 6) as x, round(sum(exp(-0.5 * pow((value - x) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) as density
       from g, events, s group by i, x""",
)
def a13(spark, d):
    k = A.kde(D.table(spark, d, "events"), "value", 50)
    return k.select("i", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query(
    "a14_box_stats",
    """with q as (select event_type, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from events group by 1)
       select event_type, round(any_value(q1), 6) as q1, round(any_value(median), 6) as median, round(any_value(q3), 6) as q3,
         min(value) filter (value >= q1 - 1.5 * (q3 - q1)) as whisker_low, max(value) filter (value <= q3 + 1.5 * (q3 - q1)) as whisker_high,
         count(*) filter (value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)) as n_outliers
       from events join q using (event_type) group by event_type""",
)
def a14(spark, d):
    b = A.box_stats(D.table(spark, d, "events"), "value", ["event_type"])
    for c in ("q1", "median", "q3"):
        b = b.withColumn(c, F.round(c, 6))
    return b


_PROFILE_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PROFILE_TXT = ["l_returnflag", "l_linestatus"]


def _profile_sql(c: str, numeric: bool, kind: str) -> str:
    num = (
        f"count(*) filter ({c} = 0) as zeros, min({c})::double as min, max({c})::double as max, round(avg({c}), 4) as mean, round(stddev_samp({c}), 3) as std"
        if numeric
        else "null as zeros, null as min, null as max, null as mean, null as std"
    )
    return f"""select '{c}' as "column", '{kind}' as type, count({c}) as count, count(*) - count({c}) as missing, {num},
      count(distinct {c}) as distinct, (select count(*) from lineitem group by {c} order by 1 desc limit 1) as top_count from lineitem"""


_KINDS = ["bigint", "bigint", "bigint", "int"] + ["double"] * 4


@query(
    "a15_profile_table",
    " union all ".join(
        [_profile_sql(c, True, k) for c, k in zip(_PROFILE_NUM, _KINDS)] + [_profile_sql(c, False, "string") for c in _PROFILE_TXT]
    ),
)
def a15(spark, d):
    p = A.profile_columns(D.table(spark, d, "lineitem").select(*_PROFILE_NUM, *_PROFILE_TXT))
    return p.select(
        "column", "type", "count", "missing", "zeros", "min", "max", F.round("mean", 4).alias("mean"),
        F.round("std", 3).alias("std"), "distinct", "top_count",
    )


@query(
    "a15_profile_quantiles",
    " union all ".join(
        f"select '{c}' as \"column\", "
        + ", ".join(f"round(quantile_cont({c}::double, {q / 100}), 6) as p{q:02d}" for q in (5, 25, 50, 75, 95))
        + " from orders"
        for c in ("o_orderkey", "o_custkey", "o_totalprice")
    ),
)
def a15_quantiles(spark, d):
    t = A.profile_quantiles(D.table(spark, d, "orders"))
    return t.select("column", *[F.round(f"p{q:02d}", 6).alias(f"p{q:02d}") for q in (5, 25, 50, 75, 95)])


@query(
    "a15_profile_moments",
    " union all ".join(
        f"""select '{c}' as "column",
        round((sum(pow({c} - m, 3)) / count(*)) / pow(sum(pow({c} - m, 2)) / count(*), 1.5), 6) + 0.0 as skewness,
        round((sum(pow({c} - m, 4)) / count(*)) / pow(sum(pow({c} - m, 2)) / count(*), 2) - 3, 6) + 0.0 as kurtosis
        from orders, (select avg({c}) as m from orders)"""
        for c in ("o_custkey", "o_totalprice")
    ),
)
def a15_moments(spark, d):
    p = A.profile_columns(D.table(spark, d, "orders").select("o_custkey", "o_totalprice"))
    return p.select(
        "column",
        (F.round("skewness", 6) + F.lit(0.0)).alias("skewness"),
        (F.round("kurtosis", 6) + F.lit(0.0)).alias("kurtosis"),
    )


@query(
    "a15_profile_top_values",
    """select "column", value, n, rank from (select *, row_number() over (partition by "column" order by n desc, value) as rank from (
         select 'lang' as "column", lang as value, count(*) as n from documents group by lang
         union all select 'source', source, count(*) from documents group by source)) where rank <= 10""",
)
def a15_top(spark, d):
    return A.profile_top_values(D.table(spark, d, "documents"), ["lang", "source"], 10)


@query(
    "a15_profile_overview",
    """with r as (select text, count(*) as n from documents group by text)
       select sum(n)::bigint as rows, count(*) as distinct_rows, sum(n - 1)::bigint as duplicate_rows from r""",
)
def a15_overview(spark, d):
    return A.profile_overview(D.table(spark, d, "documents").select("text"))


_WORDS = r"regexp_split_to_array(text, '\s+')"


@query(
    "a16_word_frequencies",
    f"""with w as (select lang, word, count(*) as n from (select lang, unnest({_WORDS}) as word from documents) where word <> '' group by all)
        select lang, word, n, rank from (select *, row_number() over (partition by lang order by n desc, word) as rank from w) where rank <= 100""",
)
def a16(spark, d):
    return A.word_frequencies(D.table(spark, d, "documents"), "text", ["lang"], 100)


@query(
    "a17_counts_by_bucket",
    """with p as (select year(o_orderdate) as year, quarter(o_orderdate) as quarter, month(o_orderdate) as month, isodow(o_orderdate) - 1 as day_of_week from orders)
       select 'year' as bucket, year::varchar as value, count(*) as n from p group by all union all
       select 'quarter', quarter::varchar, count(*) from p group by all union all
       select 'month', month::varchar, count(*) from p group by all union all
       select 'day_of_week', day_of_week::varchar, count(*) from p group by all""",
)
def a17(spark, d):
    from shelfwise.functions.scalars import date_parts

    parts = date_parts("o_orderdate")
    o = D.table(spark, d, "orders").select(*[parts[c].alias(c) for c in ("year", "quarter", "month", "day_of_week")])
    return A.counts_by_bucket(o, ["year", "quarter", "month", "day_of_week"])


@query("a18_distinct_values", "select distinct p_name from part")
def a18(spark, d):
    return A.distinct_values(D.table(spark, d, "part"), "p_name")


@query("a19_distinct_rows", "select distinct l_suppkey, l_returnflag, l_linestatus from lineitem")
def a19(spark, d):
    return A.distinct_rows(D.table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus"))


@query(
    "a20_mean_std",
    "select event_type, round(avg(value), 6) as mean_value, round(stddev_pop(value), 6) as std_value from events group by event_type",
)
def a20(spark, d):
    t = A.mean_std(D.table(spark, d, "events"), ["value"], ["event_type"])
    return t.select("event_type", F.round("mean_value", 6).alias("mean_value"), F.round("std_value", 6).alias("std_value"))


@query(
    "a21_bincount",
    "select range::int as class, coalesce(n, 0) as n from range(12) left join (select label, count(*) as n from embeddings group by label) on label = range",
)
def a21(spark, d):
    return A.bincount(D.table(spark, d, "embeddings"), "label", 12)


@query(
    "a22_best_row",
    "select * from (select * from orders qualify row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) = 1)",
)
def a22(spark, d):
    return A.best_row(D.table(spark, d, "orders"), "o_totalprice", ["o_orderkey"], ["o_orderpriority"])
