"""Run artefacts: files named by parameters, and nested result documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.scalars import parse_run_name


def scan_runs(spark: SparkSession, folder: str, pattern: str, schema, sep: str = ",") -> DataFrame:
    """Read the delimited files whose name matches ``pattern`` and add the
    ``topic_set_id`` taken from each file's (or run folder's) name."""
    schema_df = (
        spark.read.option("sep", sep)
        .option("header", True)
        .option("escape", '"')
        .option("recursiveFileLookup", True)
        .schema(schema)
        .csv(f"{folder.rstrip('/')}/{pattern}")
    )
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(neighbors[^/]*)", 1)
    return schema_df.withColumn("topic_set_id", parse_run_name(name))


def read_run_json(spark: SparkSession, paths: str | Sequence[str], schema=None) -> DataFrame:
    """Nested result documents, one row each, tagged with the labelled percent
    found in the file or folder name (``..._results_40...``)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(paths)
    pct = F.regexp_extract(F.col("_metadata.file_path"), r"_results_(\d+)", 1).cast("int")
    return df.withColumn("labeled_percentage", pct)


def write_run_json(df: DataFrame, path: str) -> None:
    """One indented JSON document per row, each in its own file (runs are few:
    one per model and label fraction)."""
    docs = df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value"))
    docs.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def promote_best(artefacts: DataFrame, best: DataFrame, key: str = "topic_set_id") -> DataFrame:
    """Artefact rows of the winning run."""
    return artefacts.join(best.select(key), key, "left_semi")


def save_params(df: DataFrame, path: str) -> None:
    """Best parameters and scores per model."""
    df.write.mode("overwrite").parquet(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
