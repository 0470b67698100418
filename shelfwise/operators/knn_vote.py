"""Classification by neighbour vote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.neighbors import knn_join


def knn_classify(
    train: DataFrame,
    test: DataFrame,
    k: int = 5,
    label: str = "label",
    weights: str = "uniform",
    metric: str = "euclidean",
    key: str = "row_id",
    vec: str = "features",
    **tiling,
) -> DataFrame:
    """(id, prediction, share): the label with most (distance-weighted) votes
    among the k nearest training rows, the smallest label on ties. With
    distance weights a neighbour at distance 0 outweighs all others."""
    near = knn_join(test, train, k, metric, key, key, vec, **tiling)
    labels = train.select(F.col(key).alias("right_id"), F.col(label).alias("__y"))
    rows = near.join(labels, "right_id")
    if weights == "uniform":
        rows = rows.withColumn("w", F.lit(1.0))
    elif weights == "distance":
        nearest = rows.groupBy("left_id").agg(F.min("distance").alias("__d0"))
        w = F.when(F.col("__d0") == 0, (F.col("distance") == 0).cast("double")).otherwise(
            F.try_divide(F.lit(1.0), F.col("distance"))
        )
        rows = rows.join(nearest, "left_id").withColumn("w", w)
    else:
        raise ValueError(f"weights must be 'uniform' or 'distance', got {weights!r}")
    votes = rows.groupBy("left_id", "__y").agg(F.sum("w").alias("v"))
    best = F.min_by("__y", F.struct((-F.round("v", 12)).alias("v"), F.col("__y").alias("y")))
    return votes.groupBy(F.col("left_id").alias("id")).agg(
        best.alias("prediction"), (F.max("v") / F.sum("v")).alias("share")
    )
