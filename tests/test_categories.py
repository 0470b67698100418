import pytest
from pyspark.sql import functions as F

from shelfwise.operators.categories import CategoryIndex


def test_positions_nulls_and_unseen(spark):
    df = spark.createDataFrame([(1, "b", 10), (2, "a", 9), (3, None, 10), (4, "b", None), (5, None, None)], "id int, s string, n int")
    index = CategoryIndex.fit(df, ["s", "n"])
    assert index.width == 4
    assert [r["name"] for r in index.names().orderBy("position").collect()] == ["s_a", "s_b", "n_9", "n_10"]  # 9 before 10
    got = {r["id"]: r["indices"] for r in index.transform(df, "id").collect()}
    assert got == {1: [1, 3], 2: [0, 2], 3: [3], 4: [1], 5: []}
    new = spark.createDataFrame([(7, "zzz", 9)], "id int, s string, n int")
    row = index.vectors(index.transform(new, "id")).first()
    assert row["features"].size == 4 and row["features"].indices.tolist() == [2]
    with pytest.raises(ValueError, match="more than 3"):
        CategoryIndex.fit(df, ["s", "n"], most=3)
    assert CategoryIndex.fit(df.limit(0), ["s"]).width == 0


def test_a_hundred_thousand_categories(spark):
    df = spark.range(150_000).select("id", F.concat(F.lit("c"), F.col("id") % 100_000).alias("c"))
    index = CategoryIndex.fit(df, ["c"])
    assert index.width == 100_000
    t = index.table.agg(F.min("position"), F.max("position"), F.countDistinct("position")).first()
    assert tuple(t) == (0, 99_999, 100_000)
    want = sorted(f"c{i}" for i in range(100_000))
    some = index.table.filter("position % 9973 = 0").collect()
    assert all(want[r["position"]] == r["value"] for r in some) and len(some) == 11
    out = index.transform(df, "id")
    assert out.count() == 150_000 and out.filter(F.size("indices") != 1).isEmpty()
