import pytest

from shelfwise.plans import q_learn, q_neighbors

D = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


def seen(monkeypatch, where, name, run, spark):
    """The arguments with which a query calls an operator."""

    def stop(*args, **kw):
        raise Seen(args, kw)

    monkeypatch.setattr(where, name, stop)
    with pytest.raises(Seen) as e:
        run(spark, D)
    monkeypatch.undo()
    return e.value.args


@pytest.mark.parametrize("run", ["c7", "c8", "c9", "c10", "c11", "c13", "c25_importances", "e9_model"])
def test_classifiers_have_no_smaller_settings(spark, monkeypatch, run):
    fn = getattr(q_learn, run, None) or q_learn.c25
    args, kw = seen(monkeypatch, q_learn.L, "fit_classifier", fn, spark)
    assert len(args) == 2 and set(kw) <= {"balanced"}


def test_searches_and_sweeps_are_whole(spark, monkeypatch):
    args, kw = seen(monkeypatch, q_learn.L, "random_search", q_learn.c4, spark)
    assert len({tuple(x.items()) for x in args[2]}) == 20 and len(args) == 3 and not kw
    args, kw = seen(monkeypatch, q_learn.L, "model_bakeoff", q_learn.c14, spark)
    assert set(args[1]) == set(q_learn.L.CLASSIFIERS) and not any(args[1].values()) and not kw
    for name, fn in (("self_train", q_learn.c15), ("self_train_two_pass", q_learn.c16)):
        args, kw = seen(monkeypatch, q_learn.L, name, fn, spark)
        assert len(args) == 4 and not kw
    args, kw = seen(monkeypatch, q_learn.L, "fraction_sweep", q_learn.c24, spark)
    assert len(args[2]) == 5 and len(args[3]) == 3 and not any(args[3].values())
    assert kw == {"n_classes": 5, "bootstrap": 200}
    args, kw = seen(monkeypatch, q_learn.TP, "topic_sweep", q_learn.t15, spark)
    assert args[2].distinct().count() == 50


def test_kmeans_has_its_starts(spark, monkeypatch):
    args, kw = seen(monkeypatch, q_neighbors.K, "kmeans", q_neighbors.k1, spark)
    assert len(args) == 2 and not kw
    args, kw = seen(monkeypatch, q_neighbors.K, "kmeans_sweep", q_neighbors.k2, spark)
    assert len(args) == 1 and not kw
    args, kw = seen(monkeypatch, q_neighbors.K, "kmeans_many", q_neighbors.k2, spark)
    assert list(args[1]) == list(range(2, 11)) and args[2] == 10


def test_the_topic_sweep_ends(spark):
    """50 sets of ten starts, all the way."""
    from shelfwise.plans.catalog import QUERIES

    rows = QUERIES["t15_topic_sweep"](spark, D).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.n_topics, []).append(r["count"])
    n = spark.read.parquet(f"{D}/documents.parquet").count()
    assert len(sizes) == 50 and all(sum(c) == n and len(c) <= k for k, c in sizes.items())


def test_selection_stays_in_spark(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from shelfwise.operators.features import important_features
    from shelfwise.plans import q_features

    rows = spark.sql(f"select p_name f, avg(p_size) i from parquet.`{D}/part.parquet` group by p_name order by f").collect()
    want = [rows[k] for k in important_features([r.i for r in rows])]
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "collect", lambda self: pytest.fail("collected"))
        out = q_features.e9(spark, D)
    assert sorted((r.feature, r.importance) for r in out.collect()) == sorted((r.f, round(r.i, 9)) for r in want)
