"""Grouped statistics, tables behind charts, and the whole-table profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.scalars import split_words
from shelfwise.operators.quantiles import exact_quantiles
from shelfwise.session import measured


def sum_or_zero(c) -> Column:
    """Sum with 0 for an all-null group."""
    return F.coalesce(F.sum(c), F.lit(0))


def mode_table(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Most frequent non-null value per key, the smallest on ties.

    Counts per (key, value) first, so neither a hot key nor a column with many
    values builds a large map in one task.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col(col).alias("v")))
    return counts.groupBy(*keys).agg(best.alias("__b")).select(*keys, F.col("__b.v").alias(f"{col}_mode"))


def count_distinct(df: DataFrame, keys: Sequence[str], col: str, approx: bool = False) -> DataFrame:
    fn = F.approx_count_distinct if approx else F.countDistinct
    return df.groupBy(*keys).agg(fn(col).alias(f"{col}_count"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency table without nulls, largest first."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(col))


def row_count_and_share(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(condition).alias("n_matching"),
        F.avg(condition.cast("double")).alias("share"),
    )


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def crosstab_percent(df: DataFrame, x: str, y: str, names: Sequence | None = None) -> DataFrame:
    """Contingency table as row percentages."""
    wide = df.groupBy(x).pivot(y, names).agg(F.count(F.lit(1))).fillna(0)
    cells = [c for c in wide.columns if c != x]
    total = sum((F.col(f"`{c}`") for c in cells), F.lit(0))
    return wide.select(x, *[(F.col(f"`{c}`") * 100.0 / total).alias(c) for c in cells])


def counts_by_bucket(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts per value of several columns in one pass of grouping sets:
    (bucket, value, n)."""
    sets = df.groupingSets([[c] for c in cols], *cols)
    counted = sets.agg(F.count("*").alias("n"), F.grouping_id().alias("__gid"))
    full = 2 ** len(cols) - 1
    bucket, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(cols):
        mine = F.col("__gid") == (full - 2 ** (len(cols) - 1 - i))
        bucket = F.when(mine, F.lit(c)).otherwise(bucket)
        value = F.when(mine, F.col(c).cast("string")).otherwise(value)
    return counted.select(bucket.alias("bucket"), value.alias("value"), "n")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles and max, one row per column."""
    stats = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in cols
        ]
    ).select(F.inline(F.array(*cols)))
    quart = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    quart = quart.withColumnsRenamed({"q0": "p25", "q1": "p50", "q2": "p75"})
    return stats.join(quart, "column", "left")


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson coefficients, long form (x, y, r): one scan,
    one aggregate per unordered pair."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    agg = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"c{i}").alias("r")))
    return agg.select(F.inline(F.array(*cells)))


def pairwise_corr(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("r"))


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width counts (bin, low, high, n); the last bin is closed and empty
    bins are listed."""
    v = F.col(col).cast("double")
    span = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias("s")).select("s").scalar()
    width = (F.col("s.hi") - F.col("s.lo")) / F.lit(float(bins))
    slot = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - F.col("s.lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    )
    counts = (
        df.select(v.alias("v"))
        .filter(F.col("v").isNotNull())
        .withColumn("s", span)
        .select(slot.cast("int").alias("bin"), "s")
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.first("s").alias("s"))
    )
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edges = grid.withColumn("s", span)
    return edges.join(counts.select("bin", "n"), "bin", "left").select(
        "bin",
        (F.col("s.lo") + F.col("bin") * width).alias("low"),
        (F.col("s.lo") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def kde(df: DataFrame, col: str, points: int = 50) -> DataFrame:
    """Gaussian density (x, density) on an even grid from min to max with
    Scott's bandwidth n^(-1/5) * std.

    All kernel sums are one aggregation with one sum per grid point; rows are
    never multiplied by the grid.
    """
    v = F.col(col).cast("double")
    stats = (
        df.agg(
            F.struct(
                F.count(v).alias("n"),
                F.min(v).alias("lo"),
                F.max(v).alias("hi"),
                (F.stddev_samp(v) * F.pow(F.count(v), F.lit(-0.2))).alias("h"),
            ).alias("s")
        )
        .select("s")
        .scalar()
    )
    rows = df.select(v.alias("v")).filter(F.col("v").isNotNull()).withColumn("s", stats)
    step = (F.col("s.hi") - F.col("s.lo")) / F.lit(float(points - 1))

    def kernel_sum(i: int) -> Column:
        z = (F.col("v") - (F.col("s.lo") + F.lit(float(i)) * step)) / F.col("s.h")
        return F.sum(F.exp(z * z * F.lit(-0.5)))

    sums = rows.agg(
        F.first("s").alias("s"),
        F.array(*[kernel_sum(i) for i in range(points)]).alias("k"),
    )
    x = F.col("s.lo") + F.col("i") * step
    scale = F.col("s.n") * F.col("s.h") * F.lit((2 * 3.141592653589793) ** 0.5)
    return sums.select("s", F.posexplode("k").alias("i", "k")).select(
        "i", x.alias("x"), (F.col("k") / scale).alias("density")
    )


def box_stats(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers at the last data points within 1.5 IQR, outlier count."""
    by = list(by)
    quart = exact_quantiles(df, [col], [0.25, 0.5, 0.75], by).drop("column")
    quart = quart.select(
        *by, F.col("q0").alias("__q1"), F.col("q1").alias("__q2"), F.col("q2").alias("__q3")
    )
    quart = measured(quart, "quartiles")
    data = df.select(*by, F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    if by:
        rows = data.join(quart, by)
    else:
        box = quart.select(F.struct("__q1", "__q2", "__q3")).scalar()
        rows = data.withColumn("b", box).select("v", "b.*")
    reach = (F.col("__q3") - F.col("__q1")) * 1.5
    low_ok, high_ok = F.col("v") >= F.col("__q1") - reach, F.col("v") <= F.col("__q3") + reach
    return rows.groupBy(*by).agg(
        F.first("__q1").alias("q1"),
        F.first("__q2").alias("median"),
        F.first("__q3").alias("q3"),
        F.min(F.when(low_ok, F.col("v"))).alias("whisker_low"),
        F.max(F.when(high_ok, F.col("v"))).alias("whisker_high"),
        F.count_if(~(low_ok & high_ok)).alias("n_outliers"),
    )


def mean_std(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation of metrics over replicates."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}")]
    return df.groupBy(*by).agg(*aggs)


def bincount(df: DataFrame, col: str, n_classes: int) -> DataFrame:
    """Rows per class 0..n-1 including empty classes."""
    counts = df.groupBy(F.col(col).cast("int").alias("class")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("class"))
    return grid.join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))


def best_row(df: DataFrame, score: str, tie: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The row with the highest score per group; ties go to the smallest key."""
    order = F.struct((-F.col(score)).alias("__s"), *[F.col(t).alias(f"__t{i}") for i, t in enumerate(tie)])
    best = df.groupBy(*by).agg(F.min_by(F.struct(*df.columns), order).alias("__r"))
    return best.select("__r.*")


def word_frequencies(df: DataFrame, text: str, by: Sequence[str] = (), top: int = 100) -> DataFrame:
    """Most frequent words overall or per group, with their rank."""
    by = list(by)
    words = df.select(*by, F.explode(split_words(text)).alias("word"))
    counts = words.groupBy(*by, "word").agg(F.count("*").alias("n"))
    if not by:
        best = counts.orderBy(F.desc("n"), "word").limit(top)
        order = W.orderBy(F.desc("n"), "word")  # at most ``top`` rows
        return best.withColumn("rank", F.row_number().over(order))
    order = W.partitionBy(*by).orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


# -- whole-table profile ------------------------------------------------------
def _is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: type, counts, distinct values, zeros, moments.

    One scan for all moments; distinct counts come from one count-by-value
    aggregation over (column, value hash), whatever the number of columns.
    """
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    null = F.lit(None).cast("double")

    def row(c: str) -> Column:
        numeric = _is_numeric(df.schema[c].dataType)
        v = F.col(c).cast("double") if numeric else None
        return F.struct(
            F.lit(c).alias("column"),
            F.lit(df.schema[c].dataType.simpleString()).alias("type"),
            F.count(c).alias("count"),
            (F.count("*") - F.count(c)).alias("missing"),
            (F.count_if(v == 0) if numeric else F.lit(None).cast("bigint")).alias("zeros"),
            (F.min(v) if numeric else null).alias("min"),
            (F.max(v) if numeric else null).alias("max"),
            (F.avg(v) if numeric else null).alias("mean"),
            (F.stddev_samp(v) if numeric else null).alias("std"),
            (F.skewness(v) if numeric else null).alias("skewness"),
            (F.kurtosis(v) if numeric else null).alias("kurtosis"),
        ).alias(c)

    moments = df.agg(*[row(c) for c in plain]).select(F.inline(F.array(*[F.col(c) for c in plain])))
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in plain]
    )
    per_value = (
        df.select(F.inline(cells)).filter(F.col("v").isNotNull()).groupBy("column", "v").agg(F.count("*").alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("v").alias("v")))
    distinct = per_value.groupBy("column").agg(F.count("*").alias("distinct"), best.alias("b"))
    distinct = distinct.select(
        "column", "distinct", F.col("b.v").alias("top"), (-F.col("b.n")).alias("top_count")
    )
    return moments.join(distinct, "column", "left").fillna(0, subset=["distinct"])


def profile_quantiles(df: DataFrame) -> DataFrame:
    """Exact 5/25/50/75/95 % quantiles of the numeric columns."""
    nums = [f.name for f in df.schema.fields if _is_numeric(f.dataType)]
    out = exact_quantiles(df, nums, [0.05, 0.25, 0.5, 0.75, 0.95])
    return out.withColumnsRenamed({"q0": "p05", "q1": "p25", "q2": "p50", "q3": "p75", "q4": "p95"})


def profile_top_values(df: DataFrame, cols: Sequence[str], top: int = 10) -> DataFrame:
    """The most frequent values of each column with their counts."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    counts = df.select(F.inline(cells)).filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    order = W.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def profile_overview(df: DataFrame) -> DataFrame:
    """Rows, distinct rows, duplicate rows of the table."""
    per_row = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return per_row.agg(
        F.sum("__n").alias("rows"),
        F.count("*").alias("distinct_rows"),
        F.sum(F.col("__n") - 1).alias("duplicate_rows"),
    )
