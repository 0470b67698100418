"""Products, relational operators, statistics and sampling on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import aggregates as A
from shelfwise.operators import products as P
from shelfwise.operators import relational as R
from shelfwise.operators import sampling as W
from shelfwise.operators.quantiles import exact_quantiles
from shelfwise.sources import runs as SR
from shelfwise.sources import tables as ST

LINE = "OBITNO OBRGDT OBORQT NET_LINE MMNEWE DESCRIPT OBCUOR OACUNO OKCSCD MMITCL OBPONR MBBCOS MMITGR OKCUNM MBLEAT".split()


def lines(spark, rows):
    full = [tuple(r) + ("1", "x", "x", "x", "x") for r in rows]
    return spark.createDataFrame(full, ", ".join(f"{c} string" for c in LINE))


def raw(spark):
    return lines(
        spark,
        [
            (" 10 ", "20240101", "6", "60,50", "1,5", "Red valve", " o1 ", "c1\t", " SE", None),
            (" 10 ", "20240101", "6", "60,50", "1,5", "Red valve", " o1 ", "c1\t", " SE", None),
            ("10", "20240208", "-1", "-10,00", "2,5", "Blue valve", "o2", "c2", "NO", "100"),
            ("10", "20240208", "abc", "5,00", None, "Blue valve", "o3", "c2", "NO", "100"),
            ("11", "20240208", "9", "900,00", None, "Tool", "o3", "c2", "NO", "100"),
            ("12", "20240208", "9", "900,00", None, "Tool", "o3", "c2", "NO", "54210"),
            ("a-test-1", "20240208", "9", "900,00", "1", "Tool", "o3", "c2", "NO", "100"),
            ("13", "20240208", "4", "900,00", "1", "Tool", "o3", "c2", "NO", "100"),
        ],
    )


def test_product_table(spark):
    mapping = spark.createDataFrame([("10 red valve", "A"), ("99 none", "B")], "OBITNO string, category string")
    got = {r["product_id"]: r for r in P.product_table(raw(spark), mapping).collect()}
    assert set(got) == {"10", "11"}
    p = got["10"]
    assert (p["quantity_sum"], p["price_sum"], p["unit_price_mean"]) == (5, 50.5, 10.1)
    assert p["description_original"] == "Blue valve" and p["description"] == "blue valve"
    assert (p["month_mode"], p["quarter_mode"], p["year_mode"], p["day_week_mode"]) == (1, 1, 2024, 0)
    assert (p["customer_country_count"], p["customer_id_count"], p["category"], p["unit_weight"]) == (2, 2, "A", 1.5)
    assert got["11"]["unit_weight"] is None and got["11"]["category"] == "-1"


def test_duplicate_mapping_keys_multiply_rows(spark):
    a = spark.createDataFrame([("1",), ("2",)], "product_id string")
    m = spark.createDataFrame([("1", "A"), ("1", "B")], "product_id string, category string")
    got = sorted(map(tuple, R.attach_labels(a, m).collect()))
    assert got == [("1", "A"), ("1", "B"), ("2", "-1")]


def test_null_rules(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert [r["x"] for r in R.filter_not_in(df, "x", [1]).collect()] == [None, 3]
    ban = spark.createDataFrame([(1,)], "v int")
    assert sorted([r["x"] for r in R.filter_not_in(df, "x", ban).collect()], key=str) == [3, None]
    assert A.value_counts(df, "x").count() == 2
    t = spark.createDataFrame([("A", None), ("A", "A"), ("-1", "B")], "category string, category_bertopic string")
    assert R.label_disagreements(t).count() == 1


def test_text_rules_later_wins(spark):
    df = spark.createDataFrame([("Service Kit", None), ("stool", "B"), ("tool service kit", "-1"), ("pump", "C")], "d string, c string")
    assert [r["c"] for r in R.override_by_text(df, "d", "c").collect()] == ["A", "E", "E", "C"]


def test_pivot_rejects_duplicates(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2)], "i string, c string, v int")
    with pytest.raises(Exception, match="duplicate"):
        R.pivot(df, ["i"], "c", "v", ["x"]).collect()


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g in ("a", "b") for v in np.round(rng.exponential(size=700), 2)]
    rows += [("c", 5.0)] * 300 + [("d", 1.0), ("d", 2.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for r in exact_quantiles(df, ["v"], probs, ["g"]).collect():
        vals = [v for g, v in rows if g == r["g"] and v is not None]
        np.testing.assert_allclose([r[f"q{i}"] for i in range(5)], np.quantile(vals, probs), rtol=1e-12)


def test_exact_quantiles_when_the_sketch_is_coarse(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("double").alias("v"))
    r = exact_quantiles(df, ["v"], [0.1, 0.5, 0.99], accuracy=200).first()
    np.testing.assert_allclose([r["q0"], r["q1"], r["q2"]], np.quantile(np.arange(20_000), [0.1, 0.5, 0.99]))


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    got = A.histogram(df, "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in got] == [2, 0, 0, 0]


def test_best_row_prefers_smallest_key_on_ties(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.5)], "k string, s double")
    assert A.best_row(df, "s", ["k"]).first()["k"] == "a"


def test_hash_position_is_a_permutation(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("g"))
    for by in ((), ("g",)):
        got = W.hash_position(df, "row_id", 1, by).collect()
        groups = {}
        for r in got:
            groups.setdefault(r["g"] if by else 0, []).append(r["position"])
        for ps in groups.values():
            assert sorted(ps) == list(range(1, len(ps) + 1))


def test_splits_keep_shares_and_folds_partition(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 900, 0).otherwise(1).alias("y"))
    a, b = W.stratified_split(df, "y", 0.8)
    assert dict(map(tuple, a.groupBy("y").count().collect())) == {0: 720, 1: 80}
    assert a.union(b).distinct().count() == 1000
    per = W.stratified_kfold(df, "y", 5).groupBy("y", "fold").count().collect()
    assert {(r["y"], r["count"]) for r in per} == {(0, 180), (1, 20)}
    shuffled = df.repartition(7, F.rand(5))
    assert sorted(r[0] for r in a.select("row_id").collect()) == sorted(
        r[0] for r in W.stratified_split(shuffled, "y", 0.8)[0].select("row_id").collect()
    )


def test_sampling_errors(spark):
    df = spark.createDataFrame([(1, "A", 0, 0.5)], "row_id int, category string, c int, distance_to_center double")
    with pytest.raises(ValueError):
        W.sample_by_distance(df, "c", 1, "middle")
    with pytest.raises(Exception, match="fewer than"):
        W.sample_per_group(df, "category", 2, strict=True).collect()
    assert W.sample_per_group(df, "category", 2).count() == 1


def test_bootstrap_size(spark):
    df = spark.range(50).select(F.col("id").alias("row_id"))
    got = W.bootstrap(df, 4).groupBy("b").count().collect()
    assert [r["count"] for r in got] == [50] * 4


def test_relaxed_union_and_zero_fill(spark):
    a = spark.createDataFrame([("f1", "r1", 0.5), ("f2", "r2", 0.1)], "feature string, run string, importance double")
    m = {r["feature"]: (r["r1"], r["r2"]) for r in R.importance_matrix(a, ["r1", "r2"]).collect()}
    assert m == {"f1": (0.5, 0.0), "f2": (0.0, 0.1)}


def test_files_round_trip(spark, tmp_path):
    src = raw(spark)
    ST.write_table(src, str(tmp_path / "l"), "csv", ";")
    back = ST.read_delimited(spark, str(tmp_path / "l"), ";", ST.ORDER_LINE_SCHEMA)
    assert sorted(map(str, back.collect())) == sorted(map(str, src.collect()))
    runs = spark.createDataFrame([("m", 1.5), ("n", 2.5)], "model string, score double")
    SR.write_run_json(runs, str(tmp_path / "x_results_40"))
    got = SR.read_run_json(spark, str(tmp_path / "x_results_40"), "model string, score double").collect()
    assert sorted((r["model"], r["labeled_percentage"]) for r in got) == [("m", 40), ("n", 40)]
    with pytest.raises(ValueError):
        ST.read_delimited(spark, "x", ";")


def test_profile_counts_missing_and_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (0, None)], "x int, s string")
    got = {r["column"]: r for r in A.profile_columns(df).collect()}
    assert (got["x"]["missing"], got["x"]["zeros"], got["x"]["distinct"], got["s"]["top"], got["s"]["top_count"]) == (1, 1, 2, "a", 2)
    assert A.profile_overview(df).first()["duplicate_rows"] == 1


def test_scratch_root_without_a_setting(spark, monkeypatch):
    from shelfwise import session

    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    root = session.shared_root(spark)
    assert root == session.shared_root(spark) and "shelfwise-" in root


def test_exact_quantiles_of_many_columns(spark, monkeypatch):
    """More columns than share a reading, with empty, constant, tied and partly null ones."""
    from shelfwise.operators import quantiles as Q

    monkeypatch.setattr(Q, "COLUMNS", 3)
    rng = np.random.default_rng(6)
    x = {
        "a": rng.normal(size=5000), "b": np.full(5000, 7.0), "c": rng.integers(0, 3, 5000).astype(float),
        "d": np.full(5000, np.nan), "e": np.where(rng.random(5000) < 0.5, np.nan, rng.random(5000)), "f": np.arange(5000.0),
        "g": np.r_[-1e300, rng.normal(size=4998), 1e300],
    }
    rows = [tuple(None if np.isnan(v) and i % 2 else float(v) for v in r) for i, r in enumerate(zip(*x.values(), strict=True))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in x))
    probs = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = {r["column"]: [r[f"q{i}"] for i in range(5)] for r in Q.exact_quantiles(df, list(x), probs, accuracy=500).collect()}
    assert set(got) == set(x) - {"d"}
    for c, q in got.items():
        assert np.allclose(q, np.nanquantile(x[c], probs), rtol=1e-12), c
    assert Q.exact_quantiles(df, ["d"], [0.5]).count() == 0
    assert Q.exact_quantiles(df.limit(0), ["a", "b"], [0.5]).count() == 0
