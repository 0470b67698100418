"""Text features and topics with their SQL twins."""

from pyspark.sql import functions as F

from shelfwise.functions import scalars as S
from shelfwise.functions import vectors as V
from shelfwise.operators import text as X
from shelfwise.operators import topics as T
from shelfwise.plans import standins as D
from shelfwise.plans.q_relational import KEYWORD_SQL, keywords
from shelfwise.plans.q_scalars import TOKENS_SQL
from shelfwise.plans.registry import query

_TOK = TOKENS_SQL.format(c="text")
_COUNTS = f"c as (select doc_id, term, count(*) as tf from (select doc_id, unnest({_TOK}) as term from documents) group by all)"
_VOCAB = f"""{_COUNTS}, n as (select count(*) as n from documents),
  v as (select term, count(*) as df, sum(tf)::bigint as total from c group by term),
  k as (select term, df, total from v, n where df >= n * 0.005::double and df <= n * 0.99::double)"""


@query("t1_tokenize", f"select doc_id, array_to_string({_TOK}, ' ') as tokens from documents")
def t1(spark, d):
    return D.table(spark, d, "documents").select("doc_id", F.array_join(S.tokenize("text"), " ").alias("tokens"))


@query("t2_document_frequency_filter_all", f"with {_VOCAB} select term, df, total from k")
def t2_all(spark, d):
    docs = D.table(spark, d, "documents")
    n = docs.agg(F.count("*")).scalar()
    return X.document_frequency_filter(X.term_counts(docs, "text", "doc_id"), n, 0.005, 0.99)


@query("t2_document_frequency_filter", f"with {_VOCAB} select term, df, total from k order by total desc, term limit 1000")
def t2(spark, d):
    docs = D.table(spark, d, "documents")
    n = docs.agg(F.count("*")).scalar()
    return X.document_frequency_filter(X.term_counts(docs, "text", "doc_id"), n, 0.005, 0.99, 1000)


@query(
    "t3_tfidf",
    f"""with {_VOCAB}, w as (select doc_id, term, tf * (ln((1 + n) / (1 + df)::double) + 1) as w from c join k using (term), n)
        select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from w""",
)
def t3(spark, d):
    t = X.tfidf_terms(D.table(spark, d, "documents"), "text", "doc_id")
    return t.withColumn("weight", F.round("weight", 6))


@query("t4_embed")
def t4(spark, d):
    docs = D.table(spark, d, "documents").select("doc_id", "text")
    e = X.embed(docs, "text")
    return e.select("doc_id", F.size("embedding").alias("width"), F.round(V.norm(V.as_doubles("embedding")), 3).alias("norm"))


@query(
    "t5_l2_normalize",
    """select vec_id, round(embedding[1] / sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as first,
       round(embedding[64] / sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as last from embeddings""",
)
def t5(spark, d):
    e = D.table(spark, d, "embeddings").select("vec_id", V.l2_normalize(V.as_doubles("embedding")).alias("v"))
    return e.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))


# topics: documents of one language and source group form a topic
_TOPIC = "(ascii(lang) + length(source)) % 7 - 1"
_CTFIDF = f"""d as (select doc_id, text, ({_TOPIC})::int as topic from documents),
  tc as (select topic, term, count(*) as tf from (select topic, unnest({_TOK}) as term from d) group by all),
  sz as (select topic, sum(tf)::bigint as size from tc group by topic), a as (select avg(size) as a from sz),
  ft as (select term, sum(tf)::bigint as f from tc group by term),
  tw as (select topic, term, tf / size::double * ln(1 + a / f) as weight from tc join ft using (term) join sz using (topic), a),
  tt as (select topic, term, weight, row_number() over (partition by topic order by round(weight, 12) desc, term) as rank from tw)"""


def topic_docs(spark, d):
    topic = ((F.ascii("lang") + F.length("source")) % 7 - 1).cast("int").alias("topic")
    return D.table(spark, d, "documents").select("doc_id", "text", topic)


@query("t6_topic_terms", f"with {_CTFIDF} select topic, term, round(weight, 9) as weight, rank from tt where rank <= 10")
def t6(spark, d):
    return T.topic_terms(topic_docs(spark, d), "text").withColumn("weight", F.round("weight", 9))


@query(
    "t7_topic_info",
    f"""with {_CTFIDF}, r as (select topic, list(term order by rank) as w from tt where rank <= 10 group by topic),
        n as (select topic, count(*) as count from d group by topic)
        select topic, count, concat_ws('_', topic::varchar, array_to_string(w[1:4], '_')) as name, array_to_string(w, ' ') as representation
        from n left join r using (topic)""",
)
def t7(spark, d):
    t = T.topic_info(topic_docs(spark, d), "text")
    return t.withColumn("representation", F.array_join("representation", " "))


@query("t8_document_info", f"select doc_id, text as document, ({_TOPIC})::int as topic from documents")
def t8(spark, d):
    return T.document_info(topic_docs(spark, d), "text", "topic", "doc_id")


@query(
    "t9_topic_similarity",
    f"""with {_CTFIDF}, n as (select topic, sqrt(sum(weight * weight)) as norm from tw group by topic),
        p as (select x.topic as topic_a, y.topic as topic_b, sum(x.weight * y.weight) as s from tw x join tw y using (term) group by all)
        select topic_a, topic_b, round(s / (a.norm * b.norm), 6) as similarity from p join n a on topic_a = a.topic join n b on topic_b = b.topic""",
)
def t9(spark, d):
    docs = topic_docs(spark, d)
    ids = [r["topic"] for r in docs.select("topic").distinct().orderBy("topic").collect()]
    return T.topic_similarity(T.topic_weights(docs, "text"), ids).withColumn("similarity", F.round("similarity", 6))


@query("t10_reduce_topics")
def t10(spark, d):
    reduced = T.reduce_topics(topic_docs(spark, d), "text", 2)
    return reduced.groupBy("topic").agg(F.count("*").alias("n"))


def _alike_sql(rounds: int, least: float) -> str:
    """Rounds of merging mutual nearest topics, unrolled."""
    ctes = [_COUNTS, "t0 as (select distinct (doc_id % 12)::int as topic, (doc_id % 12)::int as now from documents)"]
    for i in range(rounds):
        ctes.append(
            f"w{i} as (select now as topic, term, sum(tf)::double as w from c join t{i} on topic = doc_id % 12 group by all), "
            f"l{i} as (select topic, sqrt(sum(w * w)) as norm from w{i} group by topic), "
            f"s{i} as (select a.topic as a, b.topic as b, round(sum(a.w * b.w) / any_value(x.norm * y.norm), 12) as s from w{i} a join w{i} b on a.term = b.term and a.topic <> b.topic "
            f"join l{i} x on x.topic = a.topic join l{i} y on y.topic = b.topic group by all having s >= {least}), "
            f"n{i} as (select a, arg_min(b, (-s, b)) as b from s{i} group by a), "
            f"m{i} as (select p.a, p.b from n{i} p join n{i} q on q.a = p.b and q.b = p.a where p.b < p.a), "
            f"t{i + 1} as (select topic, coalesce(b, now) as now from t{i} left join m{i} on a = now)"
        )
    return f"with {', '.join(ctes)} select doc_id, now as topic from documents join t{rounds} on topic = doc_id % 12"


@query("t10_merge_alike", _alike_sql(2, 0.9))
def t10_alike(spark, d):
    docs = D.table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 12).cast("int").alias("topic"))
    return T.merge_alike(docs, "text", 0.9, max_rounds=2).select("doc_id", "topic")


# keyword topics: a topic is one (size, brand) group of parts (ids from -1 up),
# its words are the sorted words of the group's part names
_TOPIC_ID = "((p_size - 1) * 25 + cast(substr(p_brand, 7) as int) - 2)"
_KEY_TOPICS = f"""select topic, list(distinct w order by w) as words from (
    select {_TOPIC_ID} as topic, unnest(string_split(p_name, ' ')) as w from part) group by topic"""
_GREEDY = f"""k as ({KEYWORD_SQL}), t as ({_KEY_TOPICS}),
  scan as (
    with recursive s as (
      select topic, words, 1 as i, []::varchar[] as m from t
      union all
      select topic, words,
        case when i < len(words) and (words[i] || ' ' || words[i + 1]) in (select keyword from k) then i + 2 else i + 1 end,
        case when i < len(words) and (words[i] || ' ' || words[i + 1]) in (select keyword from k) then list_append(m, words[i] || ' ' || words[i + 1])
             when not list_contains(m, words[i]) and words[i] in (select keyword from k) then list_append(m, words[i]) else m end
      from s where i <= len(words))
    select topic, m from s where i > len(words)),
  hit as (select topic, count(distinct category) as n, min(category) as c from (select topic, unnest(m) as keyword from scan) join k using (keyword) group by topic),
  cat as (select topic, case when n = 1 and topic <> -1 then c else '-1' end as category from t left join hit using (topic))"""


def key_topics(spark, d):
    words = D.table(spark, d, "part").select(F.expr(_TOPIC_ID).alias("topic"), F.explode(F.split("p_name", " ")).alias("w"))
    return words.groupBy("topic").agg(F.array_sort(F.collect_set("w")).alias("words"))


@query("t11_assign_topic_category", f"with {_GREEDY} select topic, category from cat")
def t11(spark, d):
    return T.assign_topic_category(key_topics(spark, d), keywords(spark, d)).select("topic", "category")


_DOCS_CAT = f"""{_GREEDY}, dc as (
   select p_partkey, {_TOPIC_ID} as topic, case when contains(lower(p_name), 'gear') then 'E' when contains(lower(p_name), 'red widget') then 'A' else category end as category
   from part left join cat on {_TOPIC_ID} = topic)"""
_RULES = (("red widget", "A"), ("gear", "E"))


@query("t12_categorize_documents", f"with {_DOCS_CAT} select * from dc")
def t12(spark, d):
    docs = D.table(spark, d, "part").select("p_partkey", F.expr(_TOPIC_ID).alias("topic"), "p_name")
    topics = T.assign_topic_category(key_topics(spark, d), keywords(spark, d))
    return T.categorize_documents(docs, topics, "p_name", rules=_RULES).drop("p_name")


# topic runs: run r folds the topic ids modulo 100 r (ids from -1 up)
_RUN_TOPICS = f"""select run, topic, list(distinct w order by w) as words from (
   select r.range as run, ({_TOPIC_ID} + 1) % (r.range * 100) - 1 as topic, unnest(string_split(p_name, ' ')) as w from part, range(3, 12) r) group by run, topic"""
_RUN_GREEDY = (
    _GREEDY.replace(f"t as ({_KEY_TOPICS})", f"t as ({_RUN_TOPICS})")
    .replace("select topic, words, 1 as i", "select run, topic, words, 1 as i")
    .replace("select topic, words,\n        case", "select run, topic, words,\n        case")
    .replace("select topic, m from s", "select run, topic, m from s")
    .replace("select topic, count(distinct category) as n, min(category) as c from (select topic, unnest", "select run, topic, count(distinct category) as n, min(category) as c from (select run, topic, unnest")
    .replace("join k using (keyword) group by topic)", "join k using (keyword) group by run, topic)")
    .replace("cat as (select topic,", "cat as (select run, topic,")
    .replace("left join hit using (topic))", "left join hit using (run, topic))")
)
_RUN_METRICS = f"""{_RUN_GREEDY}, dr as (select r.range as run, ({_TOPIC_ID} + 1) % (r.range * 100) - 1 as topic, p_name from part, range(3, 12) r),
  dc as (select run, case when contains(p_name, 'gear') then 'E' when contains(p_name, 'red widget') then 'A' else category end as category from dr left join cat using (run, topic)),
  mt as (select run, count(*) filter (category <> '-1') / count(*)::double as ratio_topic_unique, count(*) as num_topics from cat group by run),
  md as (select run, count(*) filter (category is not null and category <> '-1') / count(*)::double as ratio_products_categorized from dc group by run),
  m as (select concat('neighbors_', run) as topic_set_id, round(ratio_topic_unique, 9) as ratio_topic_unique,
        round(ratio_products_categorized, 9) as ratio_products_categorized, num_topics from mt join md using (run))"""


def run_tables(spark, d):
    """(topic words, documents) under nine groupings of the parts."""
    runs = F.explode(F.sequence(F.lit(3), F.lit(11))).alias("run")
    part = D.table(spark, d, "part").select("p_name", F.expr(_TOPIC_ID).alias("t"), runs)
    part = part.withColumn("topic", (F.col("t") + 1) % (F.col("run") * 100) - 1).withColumn(
        "topic_set_id", F.concat(F.lit("neighbors_"), F.col("run"))
    )
    words = part.select("topic_set_id", "topic", F.explode(F.split("p_name", " ")).alias("w"))
    topics = words.groupBy("topic_set_id", "topic").agg(F.array_sort(F.collect_set("w")).alias("words"))
    return topics, part.select("topic_set_id", "topic", "p_name")


def run_metrics(spark, d):
    topics, docs = run_tables(spark, d)
    keys = ["topic_set_id", "topic"]
    cats = T.assign_topic_category(topics, keywords(spark, d), keys=keys)
    m = T.topic_set_metrics(cats, T.categorize_documents(docs, cats, "p_name", keys, _RULES))
    return m.withColumn("ratio_topic_unique", F.round("ratio_topic_unique", 9)).withColumn(
        "ratio_products_categorized", F.round("ratio_products_categorized", 9)
    )


@query("t13_topic_set_metrics", f"with {_RUN_METRICS} select * from m")
def t13(spark, d):
    return run_metrics(spark, d)


@query(
    "t14_select_topic_set",
    f"with {_RUN_METRICS} select *, row_number() over (order by ratio_products_categorized desc, topic_set_id)::int as position from m",
)
def t14(spark, d):
    return T.select_topic_set(run_metrics(spark, d))
