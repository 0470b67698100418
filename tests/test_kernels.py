import numpy as np
import pytest

from shelfwise.operators import kernels as K
from shelfwise.operators import learn as L


def table(spark, x, y):
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    return L.as_vectors(spark.createDataFrame(rows, "row_id long, features array<double>, label int"))


@pytest.fixture(scope="module")
def rings():
    """Two classes that no plane parts, and a third apart from both."""
    rng = np.random.default_rng(5)
    angle, radius = rng.uniform(0, 2 * np.pi, 300), np.repeat([0.5, 2.0, 0.4], 100)
    x = np.c_[radius * np.cos(angle), radius * np.sin(angle)] + rng.normal(0, 0.1, (300, 2))
    x[200:] += 6
    return x, np.repeat([0, 1, 2], 100)


def accuracy(spark, kind, rings, **params):
    df = table(spark, *rings)
    out = L.fit_classifier(kind, df, params).transform(df)
    total = out.selectExpr("abs(aggregate(p, 0D, (s, x) -> s + x) - 1) < 1e-9 as ok").distinct().collect()
    assert [r.ok for r in total] == [True]
    return L.accuracy(out)


def test_kernels_part_what_planes_cannot(spark, rings):
    assert accuracy(spark, "SVM", rings) < 0.9
    assert accuracy(spark, "KernelSVM", rings, gamma=1.0) > 0.97
    assert accuracy(spark, "KNN", rings) > 0.97
    assert accuracy(spark, "KNN", rings, weights="distance", k=3) == 1.0
    assert accuracy(spark, "QuadraticDiscriminant", rings) > 0.95
    assert accuracy(spark, "LinearDiscriminant", rings) < 0.9


def test_fourier_products_approach_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    want = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(2))
    for m in (256, 4096):
        z = K.FourierMap(8, 0.1, m, 7).map(x)
        bound = np.sqrt(8 * np.log(2 * 60 * 60 / 1e-3) / m)  # all pairs at once, with a chance of 1 in 1,000 to be off
        assert np.abs(z @ z.T - want).max() < bound


def test_moments_in_one_reading(spark, rings):
    x, y = rings
    df = table(spark, x, y).repartition(5)
    from pyspark.ml.functions import vector_to_array

    found = K.class_moments(df.withColumn("a", vector_to_array("features")), "a", "label")
    for c, (n, mean, scatter) in found.items():
        own = x[y == c]
        assert n == len(own) and np.allclose(mean, own.mean(0)) and np.allclose(scatter, np.cov(own.T, bias=True) * n)
    weighted = df.selectExpr("*", "2.5D as w")
    again = K.class_moments(weighted.withColumn("a", vector_to_array("features")), "a", "label", "w")
    assert np.allclose(again[1][1], found[1][1]) and again[1][0] == 250


def test_degenerate_classes(spark):
    """A constant feature, a class of one row and a class number without rows."""
    x = np.array([[0.0, 1.0], [1.0, 1.0], [5.0, 1.0], [6.0, 1.0], [9.0, 1.0]])
    df = table(spark, x, [0, 0, 1, 1, 3])
    out = L.fit_classifier("LinearDiscriminant", df).transform(df).orderBy("row_id").collect()
    assert [r.prediction for r in out] == [0, 0, 1, 1, 3] and all(len(r.p) == 4 and r.p[2] == 0 for r in out)
    with pytest.raises(ValueError, match="no labelled rows"):
        L.fit_classifier("LinearDiscriminant", df.limit(0))


def test_classes_share_their_readings(spark):
    from pyspark.ml.classification import LinearSVC

    rng, n, how = np.random.default_rng(3), 400, {"regParam": 0.01, "maxIter": 10}
    x = rng.normal(size=(n, 3)) * [1.0, 20.0, 0.0] + [5.0, 0.0, 2.0]  # the last one is constant
    y = (x[:, 0] > 5).astype(int) + 2 * np.digitize(x[:, 1] + rng.normal(size=n) * 5, [-15, 0, 15])
    jobs = {}
    for classes in (2, 8):
        df = table(spark, x, y % classes).coalesce(1).cache()
        spark.sparkContext.setJobGroup(f"margins{classes}", "fit")
        model = L.fit_classifier("SVM", df, how).model
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs[classes] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"margins{classes}"))
        c, sign = 1, np.where(y % classes == 1, 1, -1)
        ml = LinearSVC(labelCol="y", **how).fit(df.selectExpr("features", f"double(label = {c}) as y"))

        def loss(w, b):
            return np.maximum(0, 1 - sign * (x @ w + b)).mean() + 0.005 * ((w * x.std(0, ddof=1)) ** 2).sum()  # noqa: B023

        assert loss(model.coef[c], model.offset[c]) <= loss(ml.coefficients.toArray(), ml.intercept) + 5e-3
        df.unpersist()
    assert jobs[8] < 3 * jobs[2]  # a model per class made four times as many


def test_fits_of_a_search_run_side_by_side(spark, rings, monkeypatch):
    from threading import Barrier

    together = Barrier(6)

    class Zero:
        def transform(self, df):
            return df.selectExpr("*", "0 as prediction")

    def fit(*_):
        together.wait(60)  # broken, were there fewer at a time
        return Zero()

    monkeypatch.setattr(L, "fit_classifier", fit)
    scores = L.cross_validate("DecisionTree", table(spark, *rings), [{}] * 4, 3).collect()
    assert len(scores) == 12 and all(abs(r.score - 1 / 3) < 0.01 for r in scores)


def test_kernel_features_are_mapped_in_blocks_and_never_stored(spark, monkeypatch):
    from shelfwise.operators import learn as L

    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 4))
    rows = [(i, v.tolist(), int(v @ v > 3.5)) for i, v in enumerate(x)]
    data = L.as_vectors(spark.createDataFrame(rows, "row_id long, features array<double>, label int")).coalesce(2)
    written, blocks = [], []
    keep = K.materialize
    monkeypatch.setattr(K, "materialize", lambda df, *a: written.append(keep(df, *a)) or written[-1])
    monkeypatch.setattr(K, "release", lambda df: None)
    monkeypatch.setattr(K, "SVM_ROWS", 64)
    lift = K.FourierMap.map
    monkeypatch.setattr(K.FourierMap, "map", lambda self, v: lift(self, v) if len(v) <= 64 else blocks.append(len(v)))
    model = L.fit_classifier("KernelSVM", data, {"gamma": 0.2, "n_features": 256, "regParam": 1e-3})
    widths = {len(r.x) // len(r.y) for t in written for r in t.collect()}
    assert widths == {4} and not blocks
    got = {r.row_id: r.prediction for r in model.transform(data).select("row_id", "prediction").collect()}
    assert np.mean([got[i] == y for i, _, y in rows]) > 0.95
    # as the same machine over features that were mapped before
    z = spark.createDataFrame([(i, lift(model.model.lift, v[None])[0].tolist(), y) for (i, _, y), v in zip(rows, x)], "row_id long, __x array<double>, __y int")
    plain = K.LinearMargins(regParam=1e-3).fit(L.as_vectors(z, "__x").coalesce(2))
    assert np.allclose(plain.coef, model.model.coef, rtol=1e-4, atol=1e-5)


def test_models_of_a_bakeoff_share_their_folds(spark, monkeypatch):
    from shelfwise.operators import learn as L

    rows = [(i, [float(i % 2), float(i % 7)], i % 2) for i in range(120)]
    data = L.as_vectors(spark.createDataFrame(rows, "row_id long, features array<double>, label int"))
    made, fold = [], L.stratified_kfold
    monkeypatch.setattr(L, "stratified_kfold", lambda *a: made.append(1) or fold(*a))
    scores, _ = L.model_bakeoff(data, dict.fromkeys(("DecisionTree", "LinearDiscriminant", "NaiveBayes"), {}))
    got = scores.collect()
    assert len(made) == 1 and all(r.error is None for r in got) and {r.cv_score for r in got if r.model == "DecisionTree"} == {1.0}
    assert not spark.sparkContext._jsc.getPersistentRDDs()
