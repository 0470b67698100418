"""Exact quantiles without collecting a column anywhere.

A sketch brackets each wanted order statistic, one pass counts the rows below
the bracket, and only rows inside the bracket (a few in ten thousand) are
counted by value and ranked, in even value slices. State per task is bounded by
the sketch; a value repeated over any share of the rows is one counted row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.session import measured

ACCURACY = 10_000
SLICES = 256
#: columns whose brackets share a reading
COLUMNS = 40


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Linear-interpolated quantiles of every column.

    Returns (*by, column, q0, q1, ...), one ``qi`` per entry of ``probs``.
    Null and NaN values are left out.
    """
    by, cols, probs = list(by), list(cols), list(probs)
    if by:
        totals, band = _grouped(df, cols, probs, by, accuracy)
    else:
        totals, band = _wide(df, cols, probs, accuracy)
    return _ranked(totals, band, probs, by)


def _marks(probs: Sequence[float], accuracy: int) -> tuple[list[float], list[float]]:
    """Ranks that surely enclose each wanted one."""
    slack = 4.0 / accuracy
    return [max(p - slack, 0.0) for p in probs], [min(p + slack, 1.0) for p in probs]


def _number(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def _wide(df: DataFrame, cols: list[str], probs: list[float], accuracy: int) -> tuple[DataFrame, DataFrame]:
    """Totals and bracket members of whole columns, from rows that are never multiplied.

    The brackets (a few numbers per column) become literals. One reading sketches
    all columns, one counts what lies outside their brackets, one collects the few
    values inside.
    """
    spark, n = df.sparkSession, len(probs)
    lows, highs = _marks(probs, accuracy)
    facts, bands = [], []
    for first in range(0, len(cols), COLUMNS):
        some = cols[first : first + COLUMNS]
        marks = F.array(*[F.lit(x) for x in lows + highs])
        sketches = df.agg(*[F.percentile_approx(_number(c), marks, accuracy).alias(f"s{j}") for j, c in enumerate(some)]).first()
        brackets = {
            j: [(b[i] if lows[i] > 0 else None, b[n + i] if highs[i] < 1 else None, b[i], b[n + i]) for i in range(n)]
            for j, b in enumerate(sketches)
            if b is not None
        }
        if not brackets:
            continue
        aggs, hits = [], []
        for j, edges in brackets.items():
            v = _number(some[j])
            aggs.append(F.count(v).alias(f"n{j}"))
            for i, (lo, hi, low, high) in enumerate(edges):
                if lo is not None:
                    aggs += [F.count_if(v < lo).alias(f"below{j}_{i}"), F.max(F.when(v < lo, v)).alias(f"prev{j}_{i}")]
                if hi is not None:
                    aggs.append(F.min(F.when(v > hi, v)).alias(f"next{j}_{i}"))
                ok = v.isNotNull() & (F.lit(True) if lo is None else v >= lo) & (F.lit(True) if hi is None else v <= hi)
                spot = F.floor((v - low) / (high - low) * SLICES) if high > low else F.lit(0)
                part = F.greatest(F.lit(0), F.least(spot, F.lit(SLICES - 1))).cast("int")
                cell = F.struct(F.lit(some[j]).alias("column"), F.lit(i).alias("i"), part.alias("part"), v.alias("v"))
                hits.append(F.when(ok, cell))
        seen = df.agg(*aggs).first().asDict()
        facts += [
            (some[j], seen[f"n{j}"], i, seen.get(f"below{j}_{i}", 0), seen.get(f"prev{j}_{i}"), seen.get(f"next{j}_{i}"))
            for j in brackets
            for i in range(n)
        ]
        inside = df.select(F.array_compact(F.array(*hits)).alias("hits")).filter(F.size("hits") > 0)
        bands.append(inside.select(F.inline("hits")).groupBy("column", "i", "part", "v").agg(F.count("*").alias("m")))
    totals = spark.createDataFrame(facts, "column string, n long, i int, below long, prev double, next double")
    if not bands:
        return totals, spark.createDataFrame([], "column string, i int, part int, v double, m long")
    return totals, measured(reduce(DataFrame.unionByName, bands), "band")


def _grouped(df: DataFrame, cols: list[str], probs: list[float], by: list[str], accuracy: int) -> tuple[DataFrame, DataFrame]:
    """The same per group, whose brackets are joined to one row per column."""
    lows, highs = _marks(probs, accuracy)
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols]
    tall = df.select(*by, F.inline(F.array(*cells))).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    group = by + ["column"]
    n = len(probs)
    marks = F.array(*[F.lit(x) for x in lows + highs])

    def sketch(c: str) -> Column:
        v = F.col(c).cast("double")
        b = F.percentile_approx(F.when(~F.isnan(v), v), marks, accuracy)
        return F.struct(F.lit(c).alias("column"), b.alias("b"))

    sketches = df.groupBy(*by).agg(F.array(*[sketch(c) for c in cols]).alias("__s"))
    brackets = measured(sketches.select(*by, F.inline("__s")).filter("b is not null"), "brackets")
    marked = tall.join(brackets, group)
    v = F.col("v")
    none = F.lit(None).cast("double")

    def edges(i: int) -> tuple[Column | None, Column | None]:
        """Lower and upper bracket edge; None where the bracket is open."""
        b = F.col("b")
        return (b[i] if lows[i] > 0.0 else None), (b[n + i] if highs[i] < 1.0 else None)

    def outside(i: int) -> Column:
        """Rows below the bracket and the values next to it on either side; an
        interpolated position can fall one rank outside the bracket."""
        lo, hi = edges(i)
        return F.struct(
            (F.lit(0).cast("bigint") if lo is None else F.count_if(v < lo)).alias("below"),
            (none if lo is None else F.max(F.when(v < lo, v))).alias("prev"),
            (none if hi is None else F.min(F.when(v > hi, v))).alias("next"),
        )

    totals = marked.groupBy(*group).agg(F.count("*").alias("n"), F.array(*[outside(i) for i in range(n)]).alias("out"))
    totals = totals.select(*group, "n", F.posexplode("out").alias("i", "o")).select(*group, "n", "i", "o.*")

    def inside(i: int) -> Column:
        lo, hi = edges(i)
        ok = F.lit(True)
        if lo is not None:
            ok = ok & (v >= lo)
        if hi is not None:
            ok = ok & (v <= hi)
        low, width = F.col("b")[i], F.col("b")[n + i] - F.col("b")[i]
        spot = F.when(width > 0, F.floor((v - low) / width * SLICES)).otherwise(0)
        part = F.greatest(F.lit(0), F.least(spot, F.lit(SLICES - 1))).cast("int")
        return F.when(ok, F.struct(F.lit(i).alias("i"), part.alias("part")))

    hits = F.filter(F.array(*[inside(i) for i in range(n)]), lambda x: x.isNotNull())
    band = (
        marked.select(*group, "v", F.inline(hits)).groupBy(*group, "i", "part", "v").agg(F.count("*").alias("m"))
    )
    return totals, measured(band, "band")  # a few rows in ten thousand, read twice


def _ranked(totals: DataFrame, band: DataFrame, probs: list[float], by: list[str]) -> DataFrame:
    """The wanted ranks from the counted values inside the brackets."""
    n = len(probs)
    keys = by + ["column", "i"]
    # running counts inside even value slices of the bracket, plus slice offsets
    earlier = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = band.groupBy(*keys, "part").agg(F.sum("m").alias("s"))
    offsets = offsets.select(*keys, "part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("off"))
    order = W.partitionBy(*keys, "part").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    ranked = band.withColumn("local", F.sum("m").over(order)).join(offsets, keys + ["part"])
    ranked = ranked.withColumn("upto", F.col("local") + F.col("off"))
    # wanted zero-based position h = (n - 1) p; interpolate between floor and ceil
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1)
    placed = (
        ranked.join(totals, keys)
        .withColumn("h", (F.col("n") - 1) * prob)
        .withColumn("last", F.col("below") + F.col("upto") - 1)
        .withColumn("first", F.col("last") - F.col("m") + 1)
    )

    def at(pos: Column) -> Column:
        return F.max(F.when((F.col("first") <= pos) & (pos <= F.col("last")), F.col("v")))

    picked = placed.groupBy(*keys).agg(
        at(F.floor("h")).alias("a"),
        at(F.ceil("h")).alias("b"),
        *[F.max(x).alias(x) for x in ("h", "below", "prev", "next", "last")],
    )

    def or_beside(found: str, pos: Column) -> Column:
        beside = F.when(pos == F.col("below") - 1, F.col("prev")).when(pos == F.col("last") + 1, F.col("next"))
        return F.coalesce(F.col(found), beside)

    picked = picked.withColumns({"a": or_beside("a", F.floor("h")), "b": or_beside("b", F.ceil("h"))})
    missed = F.col("a").isNull() | F.col("b").isNull()
    value = F.when(
        missed, F.raise_error(F.lit("quantile outside its bracket; raise accuracy")).cast("double")
    ).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h")))
    return (
        picked.withColumn("value", value)
        .groupBy(*by, "column")
        .agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"q{i}") for i in range(n)])
    )
