"""Topic words, keyword categories and the choice of a topic set.

A topic table has one row per (run and) topic: topic, words array<string>; a
document table has one row per document with its topic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.functions.scalars import tokenize
from shelfwise.operators import relational as R
from shelfwise.operators.sampling import leaderboard
from shelfwise.operators.topic_counts import leading_terms
from shelfwise.session import materialize, measured

UNKNOWN = "-1"


def keyword_match(words: DataFrame, keywords: DataFrame) -> DataFrame:
    """Words that are keywords, with every category listed for them."""
    return words.join(keywords, "keyword")


def topic_term_counts(docs: DataFrame, text: str, topic: str = "topic") -> DataFrame:
    """(topic, term, tf) over all texts of a topic."""
    tokens = docs.select(topic, F.explode(tokenize(text)).alias("term"))
    return tokens.groupBy(topic, "term").agg(F.count("*").alias("tf"))


def weigh_terms(
    counts: DataFrame,
    topic: str = "topic",
    runs: Sequence[str] = (),
    totals: DataFrame | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Class-based TF-IDF from (*runs, topic, term, tf), each run by itself: share of
    the term in its topic times ln(1 + A / f), f the term's total and A the mean
    number of words per topic. ``totals`` may give (term, f), where all runs share them,
    and ``sizes`` (*runs, topic, size), where ``counts`` has only some of the terms."""
    runs = list(runs)
    if sizes is None:
        sizes = counts.groupBy(*runs, topic).agg(F.sum("tf").alias("size"))
    sizes = measured(sizes, "topicsizes")
    if totals is None:
        totals = counts.groupBy(*runs, "term").agg(F.sum("tf").alias("f"))
    by = [c for c in totals.columns if c != "f"]
    joined = counts.join(totals, by).join(sizes, [*runs, topic])
    if runs:
        joined = joined.join(sizes.groupBy(*runs).agg(F.avg("size").alias("__mean")), runs)
        mean_size = F.col("__mean")
    else:
        mean_size = sizes.agg(F.avg("size")).scalar()
    share = F.col("tf") / F.col("size")
    return joined.select(*runs, topic, "term", (share * F.log(1 + mean_size / F.col("f"))).alias("weight"))


def topic_weights(docs: DataFrame, text: str, topic: str = "topic") -> DataFrame:
    """:func:`weigh_terms` of the texts of each topic."""
    return weigh_terms(materialize(topic_term_counts(docs, text, topic), "topicterms"), topic)


def heaviest(weights: DataFrame, topic: str = "topic", top_n: int = 10, runs: Sequence[str] = ()) -> DataFrame:
    order = W.partitionBy(*runs, topic).orderBy(F.desc(F.round("weight", 12)), "term")
    return weights.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)


def topic_terms(docs: DataFrame, text: str, topic: str = "topic", top_n: int = 10) -> DataFrame:
    """The ``top_n`` heaviest words of each topic with their rank."""
    return heaviest(topic_weights(docs, text, topic), topic, top_n)


def describe_topics(counts: DataFrame, terms: DataFrame, topic: str = "topic", runs: Sequence[str] = ()) -> DataFrame:
    """(*runs, topic, count, name, representation) from document counts and ranked terms."""
    keys = [*runs, topic]
    pairs = F.array_sort(F.collect_list(F.struct("rank", "term")))
    words = terms.groupBy(*keys).agg(F.transform(pairs, lambda x: x["term"]).alias("representation"))
    rep = F.coalesce("representation", F.array().cast("array<string>"))
    out = counts.join(words, keys, "left").withColumn("representation", rep)
    name = F.concat_ws("_", F.col(topic).cast("string"), F.array_join(F.slice("representation", 1, 4), "_"))
    return out.select(*keys, "count", name.alias("name"), "representation")


def topic_info(docs: DataFrame, text: str, topic: str = "topic", top_n: int = 10) -> DataFrame:
    """topic, count, name (id and four words), representation array."""
    counts = docs.groupBy(topic).agg(F.count("*").alias("count"))
    return describe_topics(counts, topic_terms(docs, text, topic, top_n), topic)


def document_info(docs: DataFrame, text: str, topic: str = "topic", key: str = "row_id") -> DataFrame:
    return docs.select(key, F.col(text).alias("document"), topic)


def topic_similarity(weights: DataFrame, topics: Sequence, topic: str = "topic") -> DataFrame:
    """Cosine between topic word vectors: (topic_a, topic_b, similarity).

    Each task folds its terms into one topics x topics product sum, so a term
    shared by all topics costs one row and no pair of rows is ever joined. The
    number of topics is small and known.
    """
    topics = list(topics)
    index = {t: i for i, t in enumerate(topics)}
    kind = weights.schema[topic].dataType.simpleString()
    vectors = weights.groupBy("term").agg(
        F.collect_list(F.struct(F.col(topic).alias("t"), F.col("weight").alias("w"))).alias("cells")
    )

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(topics)
        total = np.zeros((k, k))
        for pdf in frames:
            m = np.zeros((len(pdf), k))
            for r, cells in enumerate(pdf["cells"]):
                for c in cells:
                    m[r, index[c["t"]]] = c["w"]
            total += m.T @ m
        a, b = np.meshgrid(range(k), range(k), indexing="ij")
        yield pd.DataFrame({"a": a.ravel(), "b": b.ravel(), "s": total.ravel()})

    partial = vectors.select("cells").mapInPandas(fold, "a int, b int, s double")
    gram = partial.groupBy("a", "b").agg(F.sum("s").alias("s"))
    squares = gram.filter("a = b").select("a", F.sqrt("s").alias("norm"))
    names = F.array(*[F.lit(t).cast(kind) for t in topics])
    out = gram.join(squares, "a").join(squares.toDF("b", "norm_b"), "b")
    cosine = F.coalesce(F.try_divide(F.col("s"), F.col("norm") * F.col("norm_b")), F.lit(0.0))
    return out.select(
        F.element_at(names, F.col("a") + 1).alias("topic_a"),
        F.element_at(names, F.col("b") + 1).alias("topic_b"),
        cosine.alias("similarity"),
    )


def reduce_topics(docs: DataFrame, text: str, nr: int, topic: str = "topic") -> DataFrame:
    """Merge the smallest topic into its most similar one until ``nr`` remain
    (noise topic -1 is left alone). Only topic ids, sizes and similarities, one
    small table, reach the driver; documents are relabelled once at the end."""
    sizes = {r[topic]: r["n"] for r in docs.groupBy(topic).agg(F.count("*").alias("n")).collect()}
    counts = materialize(topic_term_counts(docs, text, topic), "topicterms")
    target = {t: t for t in sizes}
    live = sorted(t for t in sizes if t != -1)
    while len(live) > nr:
        merged = relabel(counts, target, topic).groupBy(topic, "term").agg(F.sum("tf").alias("weight"))
        sims = topic_similarity(merged.filter(F.col(topic) != -1), live, topic).collect()
        smallest = min(live, key=lambda t: (sizes[t], t))
        score = {r["topic_b"]: r["similarity"] for r in sims if r["topic_a"] == smallest and r["topic_b"] != smallest}
        host = max(sorted(score), key=lambda t: score[t])
        target = {k: (host if v == smallest else v) for k, v in target.items()}
        sizes[host] += sizes[smallest]
        live.remove(smallest)
    return relabel(docs, target, topic)


def merge_alike(
    docs: DataFrame, text: str, least: float = 0.9, topic: str = "topic", max_rounds: int = 100
) -> DataFrame:
    """Merge topics until no two are alike: the number of topics is found, not given.

    In each round every pair of topics that are each other's most similar one, with
    a cosine of word counts of at least ``least``, becomes one (the smaller id); at
    least the most similar pair does, so the rounds end. The noise topic -1 is left
    alone. Similarities stay in Spark; topic ids and the pairs that merge reach the
    driver. Documents are relabelled once at the end.
    """
    counts = materialize(topic_term_counts(docs, text, topic), "topicterms")
    target = {r[topic]: r[topic] for r in docs.select(topic).distinct().collect()}
    for _ in range(max_rounds):
        live = sorted(set(target.values()) - {-1})
        merged = relabel(counts, target, topic).groupBy(topic, "term").agg(F.sum("tf").alias("weight"))
        sims = topic_similarity(merged.filter(F.col(topic) != -1), live, topic)
        sims = sims.withColumn("s", F.round("similarity", 12)).filter((F.col("topic_a") != F.col("topic_b")) & (F.col("s") >= least))
        near = sims.groupBy("topic_a").agg(F.min_by("topic_b", F.struct(-F.col("s"), "topic_b")).alias("near"))
        near = measured(near, "near")
        back = near.toDF("near", "back")
        pairs = near.join(back, "near").filter("back = topic_a and near < topic_a").collect()
        if not pairs:
            break
        move = {r["topic_a"]: r["near"] for r in pairs}
        target = {k: move.get(v, v) for k, v in target.items()}
    return relabel(docs, target, topic)


def relabel(df: DataFrame, target: dict, topic: str = "topic") -> DataFrame:
    """Replace topic ids through a small map."""
    moved = [x for k, v in target.items() if k != v for x in (F.lit(k), F.lit(v))]
    if not moved:
        return df
    kind = df.schema[topic].dataType
    new = F.coalesce(F.try_element_at(F.create_map(*moved), F.col(topic)), F.col(topic))
    return df.withColumn(topic, new.cast(kind))


# -- keyword categories --------------------------------------------------------
def greedy_matches(words: Column, bigram_hits: Column, word_hits: Column) -> Column:
    """Left-to-right scan of a word array against the keyword hits.

    A bigram that is a keyword consumes both of its words; otherwise a word that
    is a keyword is taken once. ``*_hits`` hold the entries that are keywords.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("skip"), empty.alias("m"))

    def step(s: Column, i: Column) -> Column:
        w = F.get(words, i)
        pair = F.concat_ws(" ", w, F.get(words, i + 1))
        has_next = i < F.size(words) - 1
        take_pair = has_next & F.array_contains(bigram_hits, pair)
        take_word = ~F.array_contains(s["m"], w) & F.array_contains(word_hits, w)
        return (
            F.when(s["skip"], F.struct(F.lit(False).alias("skip"), s["m"].alias("m")))
            .when(take_pair, F.struct(F.lit(True).alias("skip"), F.array_append(s["m"], pair).alias("m")))
            .when(take_word, F.struct(F.lit(False).alias("skip"), F.array_append(s["m"], w).alias("m")))
            .otherwise(F.struct(F.lit(False).alias("skip"), s["m"].alias("m")))
        )

    positions = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(positions, start, step, lambda s: s["m"])


def assign_topic_category(
    topics: DataFrame, keywords: DataFrame, words: str = "words", keys: Sequence[str] = ("topic",), noise: str = "topic"
) -> DataFrame:
    """Add ``category``: the one category all matched keywords share, else '-1'.

    Keywords are found with joins; the array scan then only sees the hits of
    its own topic, so the dictionary may be of any size.
    """
    from shelfwise.functions.scalars import bigrams

    keys = list(keys)
    own = topics.select(*keys, F.col(words).alias("__w"))
    terms = own.select(*keys, F.explode(F.array_distinct(F.array_union("__w", bigrams("__w")))).alias("keyword"))
    known = terms.join(keywords.select("keyword").distinct(), "keyword", "left_semi")
    hits = known.groupBy(*keys).agg(F.collect_set("keyword").alias("__hits"))
    scanned = own.join(hits, keys).select(
        *keys, F.explode(greedy_matches(F.col("__w"), F.col("__hits"), F.col("__hits"))).alias("keyword")
    )
    per = keyword_match(scanned, keywords).groupBy(*keys).agg(
        F.countDistinct("category").alias("__n"), F.min("category").alias("__c")
    )
    single = F.when((F.col("__n") == 1) & ~F.col(noise).cast("string").eqNullSafe(F.lit(UNKNOWN)), F.col("__c"))
    out = topics.drop("category").join(per, keys, "left")
    return out.withColumn("category", F.coalesce(single, F.lit(UNKNOWN))).drop("__n", "__c")


def categorize_documents(
    docs: DataFrame,
    topics: DataFrame,
    text: str,
    keys: Sequence[str] = ("topic",),
    rules: Sequence[tuple[str, str]] = R.TEXT_RULES,
    exclude_noise: bool = False,
) -> DataFrame:
    """Topic category per document with the text rules on top. Noise documents
    stay (and count) unless ``exclude_noise``."""
    if exclude_noise:
        docs = docs.filter(F.col("topic") != -1)
    joined = docs.join(topics.select(*keys, "category"), list(keys), "left")
    return R.override_by_text(joined, text, "category", rules)


def topic_set_metrics(topics: DataFrame, categorized: DataFrame, run: str = "topic_set_id") -> DataFrame:
    """Per run: share of topics with a category, share of documents with one,
    and the number of topics (noise included)."""
    t = topics.groupBy(run).agg(
        F.avg((F.col("category") != UNKNOWN).cast("double")).alias("ratio_topic_unique"),
        F.count("*").alias("num_topics"),
    )
    has = F.col("category").isNotNull() & (F.col("category") != UNKNOWN)
    c = categorized.groupBy(run).agg(F.avg(has.cast("double")).alias("ratio_products_categorized"))
    return t.join(c, run).select(run, "ratio_topic_unique", "ratio_products_categorized", "num_topics")


def select_topic_set(metrics: DataFrame, run: str = "topic_set_id", top: int | None = None) -> DataFrame:
    """Runs ordered by categorised documents, best first, with their position:
    all of them, or the ``top`` first."""
    return leaderboard(metrics.dropDuplicates(), "ratio_products_categorized", [run], top)


def topic_sweep(
    docs: DataFrame,
    text: str,
    params: DataFrame,
    cluster: Callable[[DataFrame, list[dict]], DataFrame],
    key: str = "row_id",
    top_n: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """Cluster and describe the documents under every parameter set at once.

    ``cluster(docs, sets)`` returns (key, clusters): the topic of a document under
    each set, in their order. Returns (topic table, document table), each row
    tagged with its parameters. Texts are tokenised once; a document's distinct
    terms are counted in its topics of all sets at once, and only those that can be
    among the heaviest become rows. Parameter sets and their topics are a small list.
    """
    spark = docs.sparkSession
    sets = [r.asDict() for r in params.collect()]
    tags = params.columns
    named = spark.createDataFrame([(i, *[s[c] for c in tags]) for i, s in enumerate(sets)], "run int, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in params.schema
    ))
    assigned = materialize(cluster(docs, sets), "sweep")
    per_run = F.posexplode("clusters").alias("run", "topic")
    sizes = measured(assigned.select(per_run).groupBy("run", "topic").agg(F.count("*").alias("count")), "sizes")
    found = [(r["run"], r["topic"]) for r in sizes.collect()]
    topics = [np.array(sorted(t for r, t in found if r == i)) for i in range(len(sets))]
    if not found:
        counts, words = spark.createDataFrame([], "run int, topic int, term string, tf long, f long"), []
    else:
        counts, words = leading_terms(docs.select(key, text), text, assigned, topics, key, top_n)
    totals = measured(counts.select("term", "f").distinct(), "totals")
    weights = weigh_terms(
        counts.drop("f"), "topic", ["run"], totals, spark.createDataFrame(words, "run int, topic int, size long")
    )
    ranked = heaviest(weights, "topic", top_n, ["run"])
    infos = describe_topics(sizes, ranked, "topic", ["run"]).join(named, "run")
    where = assigned.join(docs, key).select(key, text, per_run).join(named, "run")
    return (
        infos.select(*tags, "topic", "count", "name", "representation"),
        where.select(*tags, key, F.col(text).alias("document"), "topic"),
    )
