import numpy as np
import pytest

from shelfwise.llm import quality_classifier as qc
from shelfwise.llm import quality_rules as qr
from tests.llm.brute import counts, edge_docs, no_docs

D = "/root/testdata/sf0.01"


def test_counts_match_a_plain_version(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = docs.union(edge_docs(spark).select("doc_id", "text", "lang", "source"))
    texts = [r.text for r in docs.select("text").collect()]
    got = qr.text_counts(docs.select("text"), "text", "q_").collect()
    assert len(got) == len(texts)
    for r in got:
        want = counts(r.text)
        assert {k: r["q_" + k] for k in want} == want


def test_edge_cases_of_rules(spark):
    rows = qr.judge(edge_docs(spark)).collect()
    assert len(rows) == 11 and sum(r.doc_id is None for r in rows) == 1
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    assert [r.base_failed for r in rows if r.doc_id == 8] == [True]
    assert qr.judge(no_docs(spark)).count() == 0
    docs = edge_docs(spark)
    kept = qr.keep(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}
    assert qr.keep(no_docs(spark)).count() == 0


def test_sketch_bins(spark):
    values = [0, 1, 31, 32, 33, 63, 64, 65, 1000, 2**20, 2**40 + 12345]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    rows = df.select("v", qr.bin_floor(qr.sketch_bin(df["v"])).alias("f")).collect()
    assert all(r.f <= r.v <= r.f * 33 / 32 + 1 for r in rows)
    assert all(r.f == r.v for r in rows if r.v < 64)


def test_fences_follow_the_group_and_fall_back(spark):
    rows = [("en", "a", 500 + i % 5, 0, 0, 0, False) for i in range(300)]
    rows += [("de", "b", 900 + i % 5, 0, 0, 0, False) for i in range(300)]
    rows += [("de", "c", 10, 0, 0, 0, False)] * 3 + [(None, None, 10, 0, 0, 0, False)] + [("en", "a", 9999, 0, 0, 0, True)] * 900
    stats = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{m} long" for m in qr.OWN) + ", base_failed boolean")
    got = {(r.lang, r.source): r for r in qr.fences(stats, min_docs=100).collect()}
    assert set(got) == {("en", "a"), ("de", "b"), ("de", "c"), (None, None)}
    assert 500 <= got["en", "a"].hi_mean_length <= 640
    assert got["de", "c"].hi_mean_length == got["de", "b"].hi_mean_length > 900
    assert got[None, None].hi_mean_length > 900


@pytest.fixture(scope="module")
def rated(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    rows = qc.classify(docs, labels).select("doc_id", "held_out", "score", "predicted").collect()
    return {r.doc_id: r for r in rows}, {r.doc_id: r.quality for r in labels.collect()}


def test_held_out_accuracy(rated):
    rows, truth = rated
    assert len(rows) == 1000
    held = [(rows[i].predicted, y) for i, y in truth.items() if rows[i].held_out]
    assert len(held) > 50
    assert np.mean([p == y for p, y in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())


def test_labels_of_held_out_rows_are_not_used(spark, rated):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(qc.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in qc.classify(docs, flipped).collect()}
    assert again == {i: r.score for i, r in rated[0].items()}


def test_edge_cases_of_classifier(spark):
    labels = spark.createDataFrame([(1, None), (5, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    docs = edge_docs(spark)
    assert qc.classify(docs, labels).count() == 11
    none = qc.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert qc.classify(no_docs(spark), labels).count() == 0


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees = qc.fit(x[:2000], y[:2000], rounds=30)
    assert ((trees.score(x[2000:].astype(np.float32)) > 0.5) == y[2000:]).mean() > 0.97
    one = x[2000].astype(np.float32)
    margin = trees.prior
    for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
        node = 0
        while node < len(f):
            node = 2 * node + 1 + int(one[f[node]] > t[node])
        margin += leaf[node - len(f)]
    assert np.isclose(trees.margin(one[None])[0], margin)
