"""One-hot encoding of any number of categories: an index table and sparse vectors.

The categories of all columns are one written table (column, value, position); a
row's vector is the list of its positions, found by join. Neither the driver nor a
plan holds the categories, so a column may have millions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.session import materialize, measured

NUMBERS = ("int", "bigint", "smallint", "tinyint", "double", "float")


def _cells(df: DataFrame, cols: Sequence[str]) -> Column:
    """(column, number, value) of every column of a row; numbers only to sort numeric columns."""
    kinds = dict(df.dtypes)
    none = F.lit(None).cast("double")
    return F.array(*[
        F.struct(
            F.lit(i).alias("column"), (F.col(c).cast("double") if kinds[c] in NUMBERS else none).alias("number"),
            F.col(c).cast("string").alias("value"),
        )
        for i, c in enumerate(cols)
    ])


class CategoryIndex:
    """Positions 0, 1, ... of the values seen in fit: by column, then value (numbers
    by size, others by bytes). Nulls and unseen values have none."""

    def __init__(self, cols: Sequence[str], table: DataFrame, width: int):
        self.cols, self.table, self.width = list(cols), table, width

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], most: int = 1 << 31) -> "CategoryIndex":
        """``most`` bounds the width; more categories raise an error."""
        seen = df.select(F.inline(_cells(df, cols))).filter("value is not null").distinct()
        order = ("column", "number", "value")
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = seen.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        rows = materialize(rows.withColumn("mid", F.monotonically_increasing_id()), "categories")
        part = F.shiftright("mid", 33)
        sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
        before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # one row per task
        sizes = measured(sizes.select("part", F.coalesce(before, F.lit(0)).alias("before")), "category-parts")
        place = F.col("before") + F.col("mid").bitwiseAND((1 << 33) - 1)
        table = rows.join(sizes, part == F.col("part")).select("column", "value", place.alias("position"))
        table = measured(table, "category-index")
        width = table.count()
        if width > most:
            raise ValueError(f"{width} categories, more than {most}")
        return cls(cols, table, width)

    def names(self) -> DataFrame:
        """(position, name): ``column_value`` per position."""
        column = F.element_at(F.array(*[F.lit(c) for c in self.cols]), F.col("column") + 1)
        return self.table.select("position", F.concat_ws("_", column, "value").alias("name"))

    def transform(self, df: DataFrame, key: str) -> DataFrame:
        """(key, indices): the positions of each row's values, ascending; ``key`` is unique."""
        cells = df.select(key, F.inline(_cells(df, self.cols))).drop("number")
        hits = cells.join(self.table, ["column", "value"], "left")  # null values stay, without a position
        return hits.groupBy(key).agg(F.sort_array(F.collect_list("position")).alias("indices"))

    def vectors(self, indices: DataFrame, out: str = "features") -> DataFrame:
        """``indices`` as sparse ML vectors of the index's width."""
        width = self.width
        made = F.udf(lambda at: SparseVector(width, at, [1.0] * len(at)), VectorUDT())
        return indices.withColumn(out, made("indices"))
