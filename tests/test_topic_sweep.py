import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import topic_counts as C
from shelfwise.operators import topics as T

SETS = 4


def corpus(spark):
    rng = np.random.default_rng(5)
    words = [f"wort{i}" for i in range(60)] + ["straße", "naïve", "ähre"]
    share = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(rng.choice(words, rng.integers(1, 40), p=share / share.sum())) for _ in range(90)] + ["", None, "a b"]
    rows = [(i, t, [int(rng.integers(0, 2 + r)) - (r == 1) for r in range(SETS)]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "row_id long, text string, clusters array<int>").repartition(5)


@pytest.mark.parametrize("small", [False, True])
def test_topics_of_all_sets_are_those_of_each(spark, monkeypatch, small):
    docs = T.materialize(corpus(spark), "docs")
    params = spark.createDataFrame([(i,) for i in range(SETS)], "n int").coalesce(1)
    if small:  # many blocks, and few words weighed at a time
        for name, value in (("BLOCK_TOKENS", 100), ("BATCH_ROWS", 7), ("CELLS", 50), ("BUCKET_BYTES", 500)):
            monkeypatch.setattr(C, name, value)
    written = {}
    for module in (T, C):
        monkeypatch.setattr(module, "materialize", lambda df, tag, f=module.materialize: written.setdefault(tag, f(df, tag)))
    infos, placed = T.topic_sweep(docs.drop("clusters"), "text", params, lambda df, sets: docs.select("row_id", "clusters"))
    monkeypatch.undo()
    got = {(r.n, r.topic): (r["count"], r["name"], r.representation) for r in infos.collect()}
    order = [r.n for r in params.collect()]
    for i, n in enumerate(order):
        one = docs.withColumn("topic", F.col("clusters")[i])
        for r in T.topic_info(one, "text").collect():
            assert got.pop((n, r.topic)) == (r["count"], r["name"], r.representation)
    assert not got and placed.count() == SETS * docs.count()
    # a word is one row of a block whatever the number of sets, and few words leave
    if not small:
        assert written["topicterms"].filter("term is not null").groupBy("term").count().agg(F.max("count")).first()[0] <= 5
    assert written["leading"].count() < written["topicterms"].count() * SETS
