"""Row-wise functions over whole tables, with their SQL twins."""

from pyspark.sql import functions as F

from shelfwise.functions import scalars as S
from shelfwise.functions import vectors as V
from shelfwise.plans import standins as D
from shelfwise.plans.registry import query

# DuckDB spellings of the text steps
_DIG = "'[\\p{Nd}²³¹⁰-⁹₀-₉]'"
_STOP = "[" + ",".join("'" + w.replace("'", "''") + "'" for w in S.STOPWORDS) + "]"
_WS = r"'[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'"


def words_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, {_WS}), lambda w: w <> '')"


def clean_sql(c: str) -> str:
    base = f"regexp_replace(regexp_replace(lower(coalesce({c}, '')), {_DIG}, '', 'g'), '[[:punct:]]', ' ', 'g')"
    return (
        f"array_to_string(list_filter({words_sql(base)}, lambda v: not list_contains({_STOP}, v) "
        f"and len(list_distinct(string_split(v, ''))) > 1 and v <> 'unique'), ' ')"
    )


TOKENS_SQL = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


@query(
    "f1_parse_decimal_comma",
    "select l_orderkey, l_linenumber, cast(replace(replace(cast(l_extendedprice as varchar), '.', ','), ',', '.') as double) as price from lineitem",
)
def f1(spark, d):
    li = D.table(spark, d, "lineitem")
    text = F.replace(F.col("l_extendedprice").cast("string"), F.lit("."), F.lit(","))
    return li.select("l_orderkey", "l_linenumber", S.parse_decimal_comma(text).alias("price"))


@query(
    "f2_parse_yyyymmdd",
    """select o_orderkey, cast(o_orderdate as date) as strict_date,
       case when o_orderkey % 10 = 3 then null else cast(o_orderdate as date) end as lenient_date from orders""",
)
def f2(spark, d):
    o = D.table(spark, d, "orders")
    text = F.date_format("o_orderdate", "yyyyMMdd")
    bad = F.when(F.col("o_orderkey") % 10 == 3, F.lit("20009999")).otherwise(text)
    return o.select(
        "o_orderkey",
        S.parse_yyyymmdd(text).alias("strict_date"),
        S.parse_yyyymmdd(bad, strict=False).alias("lenient_date"),
    )


@query(
    "f3_to_number_or_null",
    "select event_id, try_cast(case when event_type = 'error' then 'n/a' else cast(value as varchar) end as double) as number from events",
)
def f3(spark, d):
    text = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return D.table(spark, d, "events").select("event_id", S.to_number_or_null(text).alias("number"))


@query(
    "f4_to_string",
    "select p_partkey, coalesce(cast(nullif(p_size, 7) as varchar), '') as size_text from part",
)
def f4(spark, d):
    return D.table(spark, d, "part").select(
        "p_partkey", S.to_text(F.nullif(F.col("p_size"), F.lit(7))).alias("size_text")
    )


@query("f5_strip_ws", "select c_custkey, c_name as name from customer")
def f5(spark, d):
    padded = F.concat(F.lit(" \t "), F.col("c_name"), F.lit("\n 　"))
    return D.table(spark, d, "customer").select("c_custkey", S.strip_ws(padded).alias("name"))


@query("f6_trunc_int", "select s_suppkey, cast(trunc(s_acctbal - 5000) as bigint) as balance from supplier")
def f6(spark, d):
    return D.table(spark, d, "supplier").select("s_suppkey", S.trunc_int(F.col("s_acctbal") - 5000).alias("balance"))


@query("f7_first_token", "select p_partkey, split_part(p_name, ' ', 1) as token from part")
def f7(spark, d):
    return D.table(spark, d, "part").select("p_partkey", S.first_token("p_name").alias("token"))


@query(
    "f8_date_parts",
    """select o_orderkey, year(o_orderdate)::int as year, month(o_orderdate)::int as month,
       (isodow(o_orderdate) - 1)::int as day_of_week, quarter(o_orderdate)::int as quarter from orders""",
)
def f8(spark, d):
    parts = S.date_parts("o_orderdate")
    return D.table(spark, d, "orders").select("o_orderkey", *[c.alias(n) for n, c in parts.items()])


@query(
    "f9_safe_ratio",
    "select l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) as unit_price from lineitem",
)
def f9(spark, d):
    return D.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", S.safe_ratio("l_extendedprice", "l_quantity").alias("unit_price")
    )


@query(
    "f10_round_half_even",
    "select l_orderkey, l_linenumber, round_even(l_quantity / 8.0::double, 2) as eighths from lineitem",
)
def f10(spark, d):
    return D.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", S.round_half_even(F.col("l_quantity") / F.lit(8.0), 2).alias("eighths")
    )


@query("f11_lower", "select doc_id, lower(text) as text from documents")
def f11(spark, d):
    return D.table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))


@query("f12_strip_digits", f"select doc_id, regexp_replace(text, {_DIG}, '', 'g') as text from documents")
def f12(spark, d):
    return D.table(spark, d, "documents").select("doc_id", S.strip_digits("text").alias("text"))


@query("f13_punct_to_space", "select doc_id, regexp_replace(text, '[[:punct:]]', ' ', 'g') as text from documents")
def f13(spark, d):
    return D.table(spark, d, "documents").select("doc_id", S.punct_to_space("text").alias("text"))


@query(
    "f14_remove_stopwords",
    f"select doc_id, array_to_string(list_filter({words_sql('text')}, lambda v: not list_contains({_STOP}, v)), ' ') as text from documents",
)
def f14(spark, d):
    return D.table(spark, d, "documents").select("doc_id", S.remove_stopwords("text").alias("text"))


@query(
    "f15_drop_repeated_char_words",
    f"select doc_id, array_to_string(list_filter({words_sql('text')}, lambda v: len(list_distinct(string_split(v, ''))) > 1), ' ') as text from documents",
)
def f15(spark, d):
    return D.table(spark, d, "documents").select("doc_id", S.drop_repeated_char_words("text").alias("text"))


@query(
    "f16_drop_word",
    f"select doc_id, array_to_string(list_filter({words_sql('text')}, lambda v: v <> 'the'), ' ') as text from documents",
)
def f16(spark, d):
    return D.table(spark, d, "documents").select("doc_id", S.drop_word("text", "the").alias("text"))


@query("f17_squeeze_spaces", f"select doc_id, array_to_string({words_sql('text')}, ' ') as text from documents")
def f17(spark, d):
    return D.table(spark, d, "documents").select("doc_id", S.squeeze_spaces("text").alias("text"))


@query(
    "f18_clean_text",
    f"select doc_id, {clean_sql('text')} as description, text as description_original from documents",
)
def f18(spark, d):
    return D.table(spark, d, "documents").select(
        "doc_id", S.clean_text("text").alias("description"), F.col("text").alias("description_original")
    )


@query(
    "f19_word_count",
    f"""select lang, sum(n)::bigint as words, avg(n) as mean_words
        from (select lang, len({words_sql('text')}) as n from documents) group by lang""",
)
def f19(spark, d):
    docs = D.table(spark, d, "documents").select("lang", S.word_count("text").alias("n"))
    return docs.groupBy("lang").agg(F.sum("n").alias("words"), F.avg("n").alias("mean_words"))


@query(
    "f20_log1p",
    """select l_orderkey, l_linenumber, round(ln(1 + l_extendedprice), 6) as log_price,
       case when l_returnflag = 'R' then '-inf'::double else 0.0 end as edge from lineitem""",
)
def f20(spark, d):
    edge = S.log1p(F.when(F.col("l_returnflag") == "R", F.lit(-1.0)).otherwise(F.lit(0.0)))
    return D.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(S.log1p("l_extendedprice"), 6).alias("log_price"), edge.alias("edge")
    )


@query(
    "f21_fraction_percent",
    """select l_orderkey, l_linenumber, cast(round(l_discount * 100) as int) as percent,
       l_linenumber / 100.0::double as fraction from lineitem""",
)
def f21(spark, d):
    return D.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        S.fraction_to_percent("l_discount").alias("percent"),
        S.percent_to_fraction("l_linenumber").alias("fraction"),
    )


_RUN_FILE = "concat('topic_doc_neighbors_', cast(p_size as {s}), '_cluster_', cast(p_partkey % 7 as {s}), '_topic_size_', cast(p_partkey as {s}), '.csv')"


@query(
    "f22_parse_run_name",
    f"""with f as (select p_partkey, {_RUN_FILE.format(s='varchar')} as name from part)
    select p_partkey, regexp_extract(name, 'neighbors[^.]*') as run,
       cast(regexp_extract(name, 'neighbors_(\\d+)', 1) as int) as neighbors,
       cast(regexp_extract(name, 'topic_size_(\\d+)', 1) as int) as topic_size from f""",
)
def f22(spark, d):
    f = D.table(spark, d, "part").select("p_partkey", F.expr(_RUN_FILE.format(s="string")).alias("name"))
    return f.select(
        "p_partkey",
        S.parse_run_name("name").alias("run"),
        S.run_param("name", "neighbors").alias("neighbors"),
        S.run_param("name", "topic_size").alias("topic_size"),
    )


@query(
    "f23_parse_word_list",
    "select p_partkey, array_to_string(string_split(p_name, ' '), '|') as words, len(string_split(p_name, ' '))::int as n from part",
)
def f23(spark, d):
    printed = F.concat(F.lit("['"), F.array_join(F.split("p_name", " "), "', '"), F.lit("']"))
    words = D.table(spark, d, "part").select("p_partkey", S.parse_word_list(printed).alias("w"))
    return words.select("p_partkey", F.array_join("w", "|").alias("words"), F.size("w").alias("n"))


@query("f24_parse_params", "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events")
def f24(spark, d):
    single = F.replace(F.col("props"), F.lit('"'), F.lit("'"))
    m = D.table(spark, d, "events").select("event_id", S.parse_params(single).alias("m"))
    return m.select("event_id", F.col("m")["k"].cast("int").alias("k"))


@query(
    "f25_max_and_argmax",
    """select vec_id, list_max(embedding)::double as max_value,
       (list_position(embedding, list_max(embedding)) - 1)::int as arg from embeddings""",
)
def f25(spark, d):
    e = D.table(spark, d, "embeddings").select("vec_id", V.as_doubles("embedding").alias("v"))
    return e.select("vec_id", F.array_max("v").alias("max_value"), V.argmax("v").alias("arg"))


@query(
    "f26_bigrams",
    f"""with w as (select doc_id, {words_sql('text')} as w from documents)
    select doc_id, coalesce(array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '|'), '') as bigrams from w""",
)
def f26(spark, d):
    w = D.table(spark, d, "documents").select("doc_id", S.split_words("text").alias("w"))
    return w.select("doc_id", F.array_join(S.bigrams("w"), "|").alias("bigrams"))
