"""Top-k, seeded samples, splits and bootstrap replicates.

Random choices order rows by a hash of their key, so they do not depend on
partitioning. Exact global or per-class positions are found without sorting a
class in one task: rows fall into hash-prefix slices, slice sizes give the
offsets, and only the rows of one slice are ordered together.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from itertools import accumulate
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.functions.hashing import hash_int, hash_order, hash_uniform
from shelfwise.session import materialize, measured

UNKNOWN = "-1"


def hash_position(
    df: DataFrame, key: str, seed, by: Sequence[str] = (), out: str = "position", prefix: int = 3
) -> DataFrame:
    """Add each row's 1-based position in hash order, overall or per group.

    ``prefix`` hex digits give 16^prefix slices per group, so a group that holds
    a third of the table is still spread over thousands of window partitions.
    ``key`` must be unique within a group.
    """
    by = list(by)
    keyed = df.withColumn("__h", hash_order(key, seed)).withColumn(
        "__slice", F.substring("__h", 1, prefix)
    )
    sizes = keyed.groupBy(*by, "__slice").agg(F.count("*").alias("__m"))
    before = W.partitionBy(*by).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*by, "__slice", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__off"))
    offsets = measured(offsets, "offsets")
    within = W.partitionBy(*by, "__slice").orderBy("__h", key)
    ranked = keyed.withColumn("__rn", F.row_number().over(within))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in by + ["__slice"]]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    joined = ranked.alias("r").join(offsets.alias("o"), cond)
    return joined.select(
        *[F.col(f"r.{c}") for c in df.columns], (F.col("__off") + F.col("__rn")).cast("bigint").alias(out)
    )


def _not_unknown(df: DataFrame, category: str | None, sentinel: str) -> DataFrame:
    return df if category is None else df.filter(~F.col(category).eqNullSafe(F.lit(sentinel)))


def sample_by_distance(
    df: DataFrame,
    cluster: str,
    n: int,
    mode: str = "centroid",
    distance: str = "distance_to_center",
    key: str = "row_id",
    category: str | None = "category",
    sentinel: str = UNKNOWN,
) -> DataFrame:
    """Per cluster the n rows nearest to ('centroid') or farthest from ('edge')
    the centre, without rows of the sentinel category."""
    if mode not in ("centroid", "edge"):
        raise ValueError(f"mode must be 'centroid' or 'edge', got {mode!r}")
    order = F.asc(distance) if mode == "centroid" else F.desc(distance)
    w = W.partitionBy(cluster).orderBy(order, key)
    kept = _not_unknown(df, category, sentinel)
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def sample_per_group(
    df: DataFrame,
    group: str,
    n: int,
    seed: int = 42,
    key: str = "row_id",
    category: str | None = None,
    sentinel: str = UNKNOWN,
    strict: bool = False,
) -> DataFrame:
    """min(n, size) random rows of each group; ``strict`` fails on a group with
    fewer than n rows."""
    kept = _not_unknown(df, category, sentinel)
    w = W.partitionBy(group).orderBy(hash_order(key, seed), key)
    picked = kept.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")
    if not strict:
        return picked
    sizes = kept.groupBy(group).agg(F.count("*").alias("__size"))
    short = F.col("__size") < n
    message = F.lit(f"a group has fewer than {n} rows")
    checked = measured(sizes, "sizes").filter(F.when(short, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    return picked.join(checked.select(group), group, "left_semi")


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """n random rows."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def head(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.orderBy(key).limit(n)


def top_n_with_other(df: DataFrame, col: str, n: int = 20, other: str = "Other") -> DataFrame:
    """The n most frequent values plus one row that sums the rest."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), col).limit(n)
    rest = counts.join(top.select(col), col, "left_anti").agg(F.sum("n").alias("n")).filter(F.col("n").isNotNull())
    return top.select(F.col(col).cast("string").alias(col), "n").unionByName(
        rest.select(F.lit(other).alias(col), "n")
    )


def top_n_per_group(df: DataFrame, group: str, col: str, n: int = 10) -> DataFrame:
    """The n most frequent values of ``col`` in each group."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(group, col).agg(F.count("*").alias("n"))
    w = W.partitionBy(group).orderBy(F.desc("n"), col)
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_features(importances: DataFrame, n: int = 50, model: str | None = None) -> DataFrame:
    """The n features with the largest importance (of one model, or the mean
    over all runs)."""
    df = importances if model is None else importances.filter(F.col("model") == model)
    mean = df.groupBy("feature").agg(F.avg("importance").alias("importance"))
    return mean.orderBy(F.desc("importance"), "feature").limit(n)


def leaderboard(df: DataFrame, score: str, tie: Sequence[str], top: int | None = None) -> DataFrame:
    """All runs by score, best first, with their position (the ``top`` first, if
    asked for).

    Rows are dealt by ranges of (score, tie), so neither many runs nor one score
    that many share meets in one task; positions are counts of the ranges before
    plus the place inside the range.
    """
    order = [F.desc(score), *tie]
    if top is not None:
        best = df.orderBy(*order).limit(top)
        return best.withColumn("position", F.row_number().over(W.orderBy(*order)))
    dealt = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    placed = dealt.withColumn("__at", inside).join(measured(offsets, "offsets"), "__range")
    return placed.withColumn("position", (F.col("__before") + F.col("__at")).cast("int")).drop(
        "__range", "__before", "__at"
    )


def stratified_fraction(df: DataFrame, label: str, frac: float, seed: int = 42, key: str = "row_id") -> DataFrame:
    """A sample with the class shares of the table: round(frac * n_c) rows of
    every class, the sentinel class included."""
    return stratified_split(df, label, frac, seed, key)[0]


def _share(size: Column, frac: float) -> Column:
    return F.floor(size * F.lit(float(frac)) + 0.5)


def _with_class_size(df: DataFrame, label: str, seed, key: str) -> DataFrame:
    placed = hash_position(df, key, seed, [label])
    sizes = measured(df.groupBy(label).agg(F.count("*").alias("__size")), "sizes")
    return placed.join(
        sizes.withColumnRenamed(label, "__label"), F.col(label).eqNullSafe(F.col("__label"))
    ).drop("__label")


def stratified_split(
    df: DataFrame, label: str, frac: float, seed: int = 42, key: str = "row_id"
) -> tuple[DataFrame, DataFrame]:
    """(first, second): ``frac`` of every class goes to the first part."""
    flagged = with_split(df, label, frac, seed, key)
    return flagged.filter("in_first").drop("in_first"), flagged.filter("not in_first").drop("in_first")


def with_split(df: DataFrame, label: str, frac: float, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Flag the rows of the first part of a stratified split as ``in_first``."""
    sized = _with_class_size(df, label, seed, key)
    return sized.withColumn("in_first", F.col("position") <= _share(F.col("__size"), frac)).drop("position", "__size")


def labeled_fraction(df: DataFrame, label: str, frac: float, seed: int = 42, key: str = "row_id") -> DataFrame:
    """A stratified share of the labelled rows; 1.0 keeps all."""
    return df if frac >= 1.0 else stratified_split(df, label, frac, seed, key)[0]


def stratified_kfold(df: DataFrame, label: str, k: int = 5, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Add ``fold`` 0..k-1, classes dealt evenly in hash order."""
    placed = hash_position(df, key, seed, [label])
    return placed.withColumn("fold", ((F.col("position") - 1) % k).cast("int")).drop("position")


def bootstrap(df: DataFrame, replicates: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Resamples with replacement, each as large as the table: (b, draw, row).

    Every draw hashes to a row position and is joined to the row that holds it.
    """
    placed = hash_position(df, key, seed)
    n = df.agg(F.count("*")).scalar()
    slots = placed.select(F.col("position").alias("draw"))
    draws = slots.select("draw", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    token = F.concat_ws("-", F.col("b"), F.col("draw"))
    draws = draws.withColumn("position", (hash_int(token, seed) % n) + 1)
    return draws.join(placed, "position").drop("position")


_E_INVERSE = sum(Fraction((-1) ** k, factorial(k)) for k in range(40))
#: distribution function of Poisson(1) in 2^60ths, up to where it rounds to 1
POISSON = tuple(int(2**60 * x) for x in accumulate(_E_INVERSE / factorial(k) for k in range(20)))


def poisson_weights(df: DataFrame, replicates: int, seed: int = 42, key: str = "row_id", out: str = "times") -> DataFrame:
    """Add how often each of ``replicates`` resamples takes the row, as an array.

    Each count is Poisson(1), read off a hash of row and replicate, so a resample
    is as large as the table on average and no row is copied, moved or joined.
    """
    table = F.array(*[F.lit(x) for x in POISSON])

    def times(b: Column) -> Column:
        h = hash_int(F.concat_ws("-", F.col(key).cast("string"), b), seed)
        return F.size(F.filter(table, lambda x: x <= h)).cast("int")

    return df.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), times))


def sample_params(grid: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n random rows of a parameter grid."""
    token = F.concat_ws("/", *[F.col(c).cast("string") for c in grid.columns])
    return grid.withColumn("__h", hash_order(token, seed)).orderBy("__h", *grid.columns).limit(n).drop("__h")


def draw_uniform(key, low: float, width: float, seed) -> Column:
    """A seeded draw from [low, low + width) per key."""
    return F.lit(low) + F.lit(width) * hash_uniform(key, seed)


def draw_int(key, low: int, high: int, seed) -> Column:
    """A seeded integer in [low, high) per key."""
    return (F.lit(low) + hash_int(key, seed) % F.lit(high - low)).cast("int")


def draw_choice(key, values: Sequence, seed) -> Column:
    """A seeded pick from a list per key."""
    table = F.array(*[F.lit(v) for v in values])
    return F.get(table, (hash_int(key, seed) % F.lit(len(values))).cast("int"))
