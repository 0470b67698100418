"""Order lines arriving as a stream, cleaned with the batch expressions.

Only stateless steps are used: typed casts, filters, the join to a static
label mapping and text cleaning. De-duplication and the product aggregation
need the whole table and stay batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.functions.scalars import clean_text
from shelfwise.operators.products import clean_lines, label_lines, with_date_features
from shelfwise.sources.tables import ORDER_LINE_SCHEMA


def read_line_stream(spark: SparkSession, folder: str, sep: str = ";") -> DataFrame:
    """New delimited files of a folder as a stream of order lines."""
    reader = spark.readStream.option("sep", sep).option("header", True)
    reader = reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    return reader.schema(ORDER_LINE_SCHEMA).csv(folder)


def clean_line_stream(lines: DataFrame, mapping: DataFrame) -> DataFrame:
    """Labelled, typed, cleaned lines with date parts and clean descriptions."""
    typed = with_date_features(clean_lines(label_lines(lines, mapping), drop_duplicates=False))
    return typed.withColumn("description_clean", clean_text("description"))
