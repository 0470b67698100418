"""Delimited and parquet tables: readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER_LINE_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "OBITNO OBRGDT OBORQT NET_LINE MMNEWE DESCRIPT OBCUOR OACUNO OKCSCD "
            "MMITCL OBPONR MBBCOS MMITGR OKCUNM MBLEAT"
        ).split()
    ]
)
MAPPING_SCHEMA = "OBITNO string, category string"
KEYWORD_SCHEMA = "keyword string, category string"


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    sep: str = ";",
    schema: str | T.StructType | None = None,
) -> DataFrame:
    """Read delimited text with a header and a declared schema.

    Columns are matched by header name, so a file may order them differently.
    """
    if schema is None:
        raise ValueError("a schema is required; inference would scan the data twice")
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = (
        spark.read.option("sep", sep)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    return reader.schema(schema).csv(paths)


def read_union(
    spark: SparkSession,
    paths: Sequence[str],
    sep: str = ";",
    schema: str | T.StructType | None = None,
) -> DataFrame:
    """All files as one table: one scan over a path list."""
    return read_delimited(spark, list(paths), sep, schema)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", sep: str = ",") -> None:
    """Overwrite ``path`` with ``df``; one file per task."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        (
            writer.option("header", True)
            .option("sep", sep)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
    else:
        writer.format(fmt).save(path)


def labeled_only(df: DataFrame, label: str = "category", sentinel: str = "-1") -> DataFrame:
    """Rows whose label is not the 'unknown' sentinel; null labels stay."""
    return df.filter(~F.col(label).eqNullSafe(F.lit(sentinel)))


def write_labeled(df: DataFrame, path: str, label: str = "category", **kw) -> None:
    write_table(labeled_only(df, label), path, **kw)


def write_by_config(df: DataFrame, cfg_cols: Sequence[str], path: str) -> None:
    """One directory per parameter set, the parameters encoded in its name.

    Rows of one parameter set are spread over many tasks (the write is not
    clustered by the partition columns), so one huge set cannot stall it.
    """
    df.write.mode("overwrite").partitionBy(*cfg_cols).parquet(path)


def write_pseudo_labels(df: DataFrame, path: str, model_col: str = "model") -> None:
    """Pseudo-labels, one directory per classifier."""
    write_by_config(df, [model_col], path)


def save_embeddings(df: DataFrame, path: str, vec: str = "embedding") -> None:
    """Persist vectors once as ``array<float>``."""
    df.withColumn(vec, F.col(vec).cast("array<float>")).write.mode("overwrite").parquet(path)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
