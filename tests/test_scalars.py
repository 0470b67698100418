"""Row-wise functions on hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import scalars as S
from shelfwise.functions import vectors as V


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("12,5", 12.5),
        ("-3,25", -3.25),
        (None, None),
    ],
)
def test_decimal_comma(spark, text, want):
    assert one(spark, S.parse_decimal_comma("c"), text) == want


def test_dates_strict_and_lenient(spark):
    assert one(spark, S.parse_yyyymmdd("c"), "20240229") == datetime.date(2024, 2, 29)
    assert one(spark, S.parse_yyyymmdd("c", strict=False), "20230229") is None
    with pytest.raises(Exception):
        one(spark, S.parse_yyyymmdd("c"), "20230229")


def test_number_or_null(spark):
    assert one(spark, S.to_number_or_null("c"), "abc") is None
    assert one(spark, S.to_number_or_null("c"), "7.5") == 7.5


def test_strip_ws_takes_every_white_space(spark):
    assert one(spark, S.strip_ws("c"), "\t   a b \n　") == "a b"


def test_weekday_starts_on_monday(spark):
    df = spark.createDataFrame([(datetime.date(2024, 1, 1),)], "c date")
    row = df.select(*[c.alias(n) for n, c in S.date_parts("c").items()]).first()
    assert (row["year"], row["month"], row["day_of_week"], row["quarter"]) == (2024, 1, 0, 1)


def test_round_half_even_and_ratio(spark):
    assert one(spark, S.round_half_even("c", 2), 0.125, "double") == 0.12
    assert one(spark, S.safe_ratio("c", F.lit(0)), 3.0, "double") is None


def test_log1p_edge(spark):
    assert one(spark, S.log1p("c"), -1.0, "double") == float("-inf")


def test_fraction_to_percent_does_not_truncate(spark):
    assert one(spark, S.fraction_to_percent("c"), 0.29, "double") == 29


@pytest.mark.parametrize(
    "text, want",
    [
        ("The SSS valve² No. 12-XX, a unique O-ring!", "valve ring"),
        ("x", ""),
        ("", ""),
        (None, ""),
        ("tool!tool  kit", "tool tool kit"),
    ],
)
def test_clean_text(spark, text, want):
    assert one(spark, S.clean_text("c"), text) == want


def test_clean_text_equals_its_steps(spark):
    df = spark.createDataFrame([("Big 3 RED, red & aa pumps don't unique",)], "c string")
    step = df.select(F.lower("c").alias("c"))
    for fn in (S.strip_digits, S.punct_to_space, S.remove_stopwords, S.drop_repeated_char_words, S.drop_word, S.squeeze_spaces):
        step = step.select(fn("c").alias("c"))
    assert step.first()["c"] == df.select(S.clean_text("c").alias("c")).first()["c"]


def test_all_punctuation_becomes_space(spark):
    import string

    assert one(spark, S.punct_to_space("c"), string.punctuation) == " " * 32


def test_tokenize_keeps_accents_whole(spark):
    assert one(spark, S.tokenize("c"), "Café a_b x 2ö") == ["café", "a_b", "2ö"]


def test_run_names_and_lists(spark):
    name = "topic_repr_neighbors_15_cluster_10_samples_5_topic_size_50.csv"
    assert one(spark, S.parse_run_name("c"), name) == "neighbors_15_cluster_10_samples_5_topic_size_50"
    assert one(spark, S.run_param("c", "samples"), name) == 5
    assert one(spark, S.parse_word_list("c"), "['a', 'b c', 'd']") == ["a", "b c", "d"]
    assert one(spark, S.parse_params("c"), "{'gamma': 20, 'kernel': 'rbf'}") == {"gamma": "20", "kernel": "rbf"}


def test_bigrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r["x"] for r in df.select(S.bigrams("w").alias("x")).collect()] == [["a b", "b c"], [], []]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.2, 0.4, 0.4]), ([0.0, 0.0], [0.5, 0.5, 0.0])], "v array<double>, p array<double>")
    rows = df.select(V.l2_normalize("v").alias("u"), V.argmax("p").alias("a")).collect()
    assert [list(r["u"]) for r in rows] == [[0.6, 0.8], [0.0, 0.0]]
    assert [r["a"] for r in rows] == [1, 0]
