"""Metrics against printed figures and brute force; topics on small lists."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import learn as L
from shelfwise.operators import metrics as M
from shelfwise.operators import topics as T
from shelfwise.operators.text import TfidfModel, embed, tfidf_terms

CM = [[393, 25, 80, 0, 3], [55, 231, 119, 0, 1], [241, 203, 1980, 0, 21], [0, 2, 9, 1, 0], [14, 1, 19, 0, 10]]


def test_printed_confusion_matrix(spark):
    rows = [(i, j, n) for i, r in enumerate(CM) for j, n in enumerate(r)]
    m = M.label_metrics(spark.createDataFrame(rows, "y int, yhat int, n long")).first()
    want = {
        "accuracy": 0.76731220657277,
        "f1": 0.7738982743231382,
        "balanced_accuracy": 0.49476373329844725,
        "kappa": 0.5239504092110265,
        "mcc": 0.5300390462457089,
    }
    for k, v in want.items():
        assert abs(m[k] - v) < 1e-12


def test_classes_absent_on_one_side(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 2), (1, 1)], "y int, yhat int")
    r = {x["class"]: x for x in M.class_report(M.confusion_counts(df)).collect()}
    assert (r[2]["support"], r[2]["recall"], r[2]["f1"]) == (0, 0.0, 0.0)
    m = M.label_metrics(M.confusion_counts(df)).first()
    assert m["balanced_accuracy"] == 0.5
    same = spark.createDataFrame([(0, 0), (0, 0)], "y int, yhat int")
    assert M.label_metrics(M.confusion_counts(same)).first()["mcc"] == 0.0


def scores(spark, n=400, ties=False, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    p = rng.random((n, 3)) + 0.5 * np.eye(3)[y]
    if ties:
        p = np.round(p, 1)
    p = p / p.sum(1, keepdims=True)
    if ties:
        p = np.round(p, 1)
    df = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(y, p)], "y int, p array<double>")
    return y, p, df


def curve(pos, score):
    """Threshold curve by direct counting."""
    pts = [(0.0, 0.0)]
    for s in sorted(set(score), reverse=True):
        hit = score >= s
        pts.append(((hit & ~pos).sum() / (~pos).sum(), (hit & pos).sum() / pos.sum()))
    return np.array(pts)


@pytest.mark.parametrize("ties", [False, True])
def test_roc_against_direct_counts(spark, ties):
    y, p, df = scores(spark, 300, ties)
    got = {r["class"]: r["auc"] for r in M.roc_auc(df, 3).collect()}
    curves = {str(c): curve(y == c, p[:, c]) for c in range(3)}
    curves["micro"] = curve(np.eye(3, dtype=bool)[y].ravel(), p.ravel())
    area = lambda f, t: float(((f[1:] - f[:-1]) * (t[1:] + t[:-1]) / 2).sum())
    for c, pts in curves.items():
        assert abs(got[c] - area(pts[:, 0], pts[:, 1])) < 1e-9
    grid = np.unique(np.concatenate([curves[str(c)][:, 0] for c in range(3)]))
    mean = np.mean([np.interp(grid, curves[str(c)][:, 0], curves[str(c)][:, 1]) for c in range(3)], axis=0)
    macro = M.roc_macro(M.roc_curve(df, 3), 3).orderBy("fpr").collect()
    np.testing.assert_allclose([r["fpr"] for r in macro], grid, atol=1e-12)
    np.testing.assert_allclose([r["tpr"] for r in macro], mean, atol=1e-12)
    assert abs(got["macro"] - area(grid, mean)) < 1e-9


def test_equal_scores_give_half(spark):
    df = spark.createDataFrame([(i % 2, [0.5, 0.5]) for i in range(10)], "y int, p array<double>")
    assert {r["class"]: r["auc"] for r in M.class_auc(df, 2).collect()}["mean"] == 0.5


def test_log_loss_and_top_k(spark):
    df = spark.createDataFrame([(0, [0.0, 0.5, 0.5]), (1, [0.2, 0.4, 0.4])], "y int, p array<double>")
    got = M.log_loss(df).first()[0]
    assert abs(got - (-math.log(2.220446049250313e-16) - math.log(0.4)) / 2) < 1e-9
    # class 1 ties with class 2, which ranks first
    assert M.top_k_accuracy(df, 1).first()[0] == 0.0
    assert M.top_k_accuracy(df, 2).first()[0] == 0.5


def test_bootstrap_sizes_and_spread(spark):
    df = spark.createDataFrame([(i % 3, (i * 7) % 3) for i in range(90)], "y int, yhat int")
    for method in ("draws", "multinomial"):
        per = M.bootstrap_counts(df, 20, 1, method).groupBy("b").agg(F.sum("n").alias("n")).collect()
        assert [r["n"] for r in per] == [90] * 20
    a = M.bootstrap_metrics(df, 60, 1).first()
    b = M.bootstrap_metrics(df, 60, 1, "multinomial").first()
    assert abs(a["mean_accuracy"] - b["mean_accuracy"]) < 0.05
    with pytest.raises(ValueError):
        M.bootstrap_counts(df, 2, 1, "other")


# -- topics ---------------------------------------------------------------------
KEYWORDS = [("oil", "A"), ("oil filter", "B"), ("pump", "A"), ("seal", "C"), ("kit", "A"), ("kit", "C")]


@pytest.mark.parametrize(
    "topic, words, want",
    [
        (0, ["oil", "filter", "pump"], "-1"),  # bigram B and word A
        (1, ["oil", "pump", "oil"], "A"),
        (2, ["oil", "filter"], "B"),
        (3, ["nothing", "here"], "-1"),
        (4, ["kit"], "-1"),  # listed under two categories
        (-1, ["seal"], "-1"),
        (5, ["filter", "seal"], "C"),
        (6, [], "-1"),
    ],
)
def test_topic_category(spark, topic, words, want):
    t = spark.createDataFrame([(topic, words)], "topic int, words array<string>")
    k = spark.createDataFrame(KEYWORDS, "keyword string, category string")
    assert T.assign_topic_category(t, k).first()["category"] == want


def test_noise_documents_count_unless_excluded(spark):
    topics = spark.createDataFrame([("r", 0, "A"), ("r", -1, "-1")], "topic_set_id string, topic int, category string")
    docs = spark.createDataFrame([("r", 0, "valve"), ("r", -1, "cup"), ("r", -1, "stool"), ("r", 7, "x")], "topic_set_id string, topic int, d string")
    keys = ["topic_set_id", "topic"]
    m = T.topic_set_metrics(topics, T.categorize_documents(docs, topics, "d", keys)).first()
    assert (m["ratio_topic_unique"], m["ratio_products_categorized"], m["num_topics"]) == (0.5, 0.5, 2)
    assert T.categorize_documents(docs, topics, "d", keys, exclude_noise=True).count() == 2


def test_tfidf_two_forms_agree(spark):
    docs = spark.createDataFrame([(1, "red pump red"), (2, "blue pump"), (3, "red seal"), (4, "")], "row_id int, t string")
    terms = {(r["row_id"], r["term"]): r["weight"] for r in tfidf_terms(docs, "t", "row_id", 0.0, 1.0).collect()}
    model = TfidfModel.fit(docs, "t", "row_id", 0.0, 1.0)
    assert model.terms == ["blue", "pump", "red", "seal"]
    for r in model.transform(docs, "t").collect():
        for i, v in enumerate(r["text_features"].toArray()):
            assert abs(v - terms.get((r["row_id"], model.terms[i]), 0.0)) < 1e-12
    idf = math.log(5 / 3) + 1
    assert abs(terms[(3, "red")] / terms[(3, "seal")] - idf / (math.log(5 / 2) + 1)) < 1e-12


def test_embed_uses_the_given_encoder(spark):
    docs = spark.createDataFrame([(i, "w" * i) for i in range(70)], "row_id int, t string")

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    got = {r["row_id"]: r["embedding"] for r in embed(docs, "t", load, batch=7).collect()}
    assert all(got[i] == [float(i), 1.0] for i in range(70))


def test_reduce_topics_merges_smallest_into_nearest(spark):
    docs = spark.createDataFrame(
        [(0, "oil pump oil"), (0, "pump oil"), (0, "oil"), (1, "red cup"), (1, "cup red"), (2, "oil pump"), (-1, "noise")], "topic int, t string"
    )
    got = dict(map(tuple, T.reduce_topics(docs, "t", 2).groupBy("topic").count().collect()))
    assert got == {0: 4, 1: 2, -1: 1}


# -- learning -------------------------------------------------------------------
def separable(spark, n=240):
    rng = np.random.default_rng(5)
    y = np.arange(n) % 3
    x = rng.normal(size=(n, 4)) + 4 * np.eye(4)[y]
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return L.as_vectors(spark.createDataFrame(rows, "row_id long, features array<double>, label int"))


@pytest.mark.parametrize("kind, params", [("RandomForest", {"numTrees": 5}), ("BoostedTrees", {"maxIter": 2}), ("SVM", {"maxIter": 5}), ("NeuralNetwork", {})])
def test_classifiers_learn_and_give_probabilities(spark, kind, params):
    df = separable(spark)
    out = L.fit_classifier(kind, df, params, balanced=True).transform(df)
    assert L.accuracy(out) > 0.85
    for r in out.limit(20).collect():
        assert len(r["p"]) == 3 and abs(sum(r["p"]) - 1) < 1e-9


def test_self_training_labels_the_pool(spark):
    df = separable(spark)
    known, pool = df.filter("row_id < 60"), df.filter("row_id >= 60").drop("label")
    model, labels = L.self_train("RandomForest", known, pool, 0.6, 3, {"numTrees": 8})
    s = L.pseudo_label_summary(labels, 3, 0.6).first()
    assert s["labeled_samples_count"] == 60 and s["pseudo_label_count"] + s["not_pseudo_label_count"] == 180
    assert sum(s["pseudo_label_distribution"]) == s["pseudo_label_count"] > 100
    truth = df.select("row_id", F.col("label").alias("t"))
    right = labels.filter("labeled_iter > 0").join(truth, "row_id").filter("label = t").count()
    assert right > 0.85 * s["pseudo_label_count"]
    _, none = L.self_train("RandomForest", known, pool, 1.0, 3, {"numTrees": 8})
    assert none.filter("labeled_iter > 0").count() == 0


def counted_fits(monkeypatch):
    seen, fit = [], L.fit_classifier
    monkeypatch.setattr(L, "fit_classifier", lambda kind, df, *a, **kw: seen.append(df.rdd.getNumPartitions()) or fit(kind, df, *a, **kw))
    return seen


def test_rows_are_fitted_once_and_by_many_tasks(spark, monkeypatch):
    df = separable(spark)
    known, pool = df.filter("row_id < 60"), df.filter("row_id >= 60").drop("label")
    seen = counted_fits(monkeypatch)
    monkeypatch.setattr(L, "FILE_ROWS", 10)
    monkeypatch.setattr(L, "TASK_BYTES", 1 << 10)
    _, none = L.self_train("RandomForest", known, pool, 1.0, 3, {"numTrees": 3})
    assert none.filter("labeled_iter > 0").count() == 0
    assert len(seen) == 1 and seen[0] > 1


def test_sweep_fits_twice_where_nothing_is_accepted(spark, monkeypatch):
    df = separable(spark, 300)
    known, pool = df.filter("row_id < 200"), df.filter("row_id >= 200").drop("label")
    seen = counted_fits(monkeypatch)
    monkeypatch.setattr(L, "next_threshold", lambda state, f1: state)  # no probability exceeds 1
    out = L.fraction_sweep(known, pool, [1.0, 0.5], {"RandomForest": {"numTrees": 3}}, threshold=1.0, n_classes=3, bootstrap=5)
    rows = out.orderBy("labeled_fraction").collect()
    assert len(seen) == 4  # the features, and the labels as given
    assert [(r["labeled_fraction"], r["pseudo_label_count"], r["threshold"]) for r in rows] == [(0.5, 0, 1.0), (1.0, 0, 1.0)]
    # a share is rounded in each of three classes
    assert abs(rows[1]["labeled_samples_count"] - 2 * rows[0]["labeled_samples_count"]) <= 3 and rows[1]["train_roc_auc"] > 0.9


def test_areas_of_many_runs_are_those_of_each(spark):
    rows = [(r, i % 3, [((i * (r + 2) + c * 5) % 11 + 1) / 12.0 for c in range(3)]) for r in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, "run int, y int, p array<double>")
    got = {(r["run"], r["class"]): r["auc"] for r in M.class_auc(df, 3, slices=4, by=["run"]).collect()}
    for run in range(2):
        for r in M.class_auc(df.filter(F.col("run") == run), 3, slices=4).collect():
            assert abs(got.pop((run, r["class"])) - r["auc"]) < 1e-12
    assert not got


def test_threshold_steps():
    s = (0.8, 0.0)
    seen = []
    for f1 in (0.5, 0.7, 0.6, 0.7, 0.9):
        s = L.next_threshold(s, f1)
        seen.append(round(s[0], 2))
    assert seen == [0.75, 0.7, 0.75, 0.75, 0.7]


def test_cross_validation_oversamples_training_folds_only(spark):
    df = separable(spark, 120).filter("label < 2 or row_id < 60")
    out = L.cross_validate("DecisionTree", df, [{"maxDepth": 3}], 2, oversampling="smote")
    table = L.cv_results(out).first()
    assert out.count() == 2 and table["rank_test_score"] == 1 and table["mean_test_score"] > 0.7


def test_failed_fit_is_reported(spark):
    row = L.cross_val_score("DecisionTree", separable(spark, 30), 2, {"noSuchParameter": 1})
    assert row["cv_score"] is None and row["error"]


def test_boosted_importances_and_refit(spark):
    # only the first of three features tells the classes apart
    rows = [(i, [float(i % 3), float(i % 7), float(i % 5)], i % 3) for i in range(120)]
    data = L.as_vectors(spark.createDataFrame(rows, "row_id long, features array<double>, label int"))
    boosted = L.fit_classifier("BoostedTrees", data, {"maxIter": 2, "maxDepth": 2})
    got = L.feature_importances(boosted, ["a", "b", "c"])
    assert [n for n, _ in got] == ["a", "b", "c"] and abs(sum(v for _, v in got) - 1) < 1e-9
    assert L.select_features("BoostedTrees", data, {"maxIter": 2, "maxDepth": 2}) == [0]
    model, best, scores = L.refit_best("DecisionTree", data, [{"maxDepth": 1}, {"maxDepth": 3}], 2)
    assert best == {"maxDepth": 3} and scores.count() == 4
    assert L.accuracy(model.transform(data)) == 1.0


def test_shared_totals_weigh_terms_alike(spark):
    rows = [(r, (i * (r + 1)) % 3, f"w{i % 5}", i + 1) for r in range(2) for i in range(12)]
    counts = spark.createDataFrame(rows, "run int, topic int, term string, tf long").groupBy("run", "topic", "term").agg(F.sum("tf").alias("tf"))
    totals = counts.filter("run = 0").groupBy("term").agg(F.sum("tf").alias("f"))
    own, shared = (
        {(r.run, r.topic, r.term): r.weight for r in T.weigh_terms(counts, "topic", ["run"], t).collect()} for t in (None, totals)
    )
    assert own.keys() == shared.keys() and all(abs(own[k] - shared[k]) < 1e-12 for k in own)
