"""Class weights and synthetic oversampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.hashing import hash_int, hash_uniform
from shelfwise.operators.neighbors import knn_join
from shelfwise.operators.relational import union_all
from shelfwise.operators.sampling import hash_position
from shelfwise.session import materialize, measured


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight = rows / (classes * rows of the class)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    classes = counts.agg(F.count("*")).scalar()
    return counts.withColumn("weight", total / (classes * F.col("n")))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Row weights that give every class the same total."""
    w = class_weights(df, label).select(F.col(label).alias("__label"), F.col("weight").alias(out))
    w = measured(w, "weights")
    return df.join(w, F.col(label) == F.col("__label"), "left").drop("__label")


def _class_sizes(df: DataFrame, label: str) -> dict:
    rows = df.groupBy(label).agg(F.count("*").alias("n")).collect()
    return {r[label]: r["n"] for r in rows}


def _synthesize(
    bases: DataFrame, members: DataFrame, need: int, label_value, label: str, k: int, seed, key: str, vec: str, **tiling
) -> DataFrame:
    """``need`` points between base rows and their near rows of the class.

    Draw ids come from a distributed range; a hash of the draw picks the base,
    the neighbour and the position between them.
    """
    spark = bases.sparkSession
    near = knn_join(bases, members, k, "euclidean", key, key, vec, exclude_self=True, **tiling)
    per_base = near.groupBy("left_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "right_id"))).alias("near")
    )
    placed = hash_position(bases.select(key, F.col(vec).alias("__base")), key, seed)
    placed = placed.join(per_base, F.col(key) == F.col("left_id"), "left").drop("left_id")
    n = bases.agg(F.count("*")).scalar()
    token = F.concat(F.lit(f"{label_value}-"), F.col("id"))
    draws = spark.range(need).select(
        F.col("id").alias("draw"),
        ((hash_int(token, f"{seed}base") % n) + 1).alias("position"),
        hash_int(token, f"{seed}near").alias("__pick"),
        hash_uniform(token, f"{seed}step").alias("step"),
    )
    options = F.coalesce(F.size("near"), F.lit(0))
    slot = F.when(options > 0, F.get("near", (F.col("__pick") % options).cast("int"))["right_id"])
    picked = draws.join(placed, "position").withColumn("neighbor", F.coalesce(slot, F.col(key)))
    other = members.select(F.col(key).alias("neighbor"), F.col(vec).alias("__near"))
    point = F.zip_with("__base", "__near", lambda a, b: a + F.col("step") * (b - a))
    return picked.join(other, "neighbor").select(
        F.lit(label_value).alias(label), "draw", F.col(key).alias("base"), "neighbor", "step", point.alias(vec)
    )


def smote_synthetic(
    df: DataFrame, label: str, k: int = 5, seed: int = 42, key: str = "row_id", vec: str = "features", **tiling
) -> DataFrame:
    """Synthetic rows (label, draw, base, neighbor, step, vec) that lift every
    class to the size of the largest. A class of one row repeats that row."""
    rows = materialize(df.select(key, label, F.col(vec).cast("array<double>").alias(vec)), "smote")
    sizes = _class_sizes(rows, label)
    top = max(sizes.values())
    parts = []
    for c in sorted(sizes):
        if sizes[c] < top:
            own = rows.filter(F.col(label) == F.lit(c))
            parts.append(_synthesize(own, own, top - sizes[c], c, label, k, seed, key, vec, **tiling))
    return union_all(*parts) if parts else _no_rows(rows, label, key, vec)


def _no_rows(rows: DataFrame, label: str, key: str, vec: str) -> DataFrame:
    kinds = dict(rows.dtypes)
    ddl = f"`{label}` {kinds[label]}, draw long, base {kinds[key]}, neighbor {kinds[key]}, step double, `{vec}` {kinds[vec]}"
    return rows.sparkSession.createDataFrame([], ddl)


def danger_rows(df: DataFrame, label: str, m: int = 10, key: str = "row_id", vec: str = "features", **tiling) -> DataFrame:
    """(key, n_other): rows with at least half, but not all, of their m nearest
    rows in other classes."""
    near = knn_join(df, df, m, "euclidean", key, key, vec, exclude_self=True, **tiling)
    own = df.select(F.col(key).alias("left_id"), F.col(label).alias("__own"))
    other = df.select(F.col(key).alias("right_id"), F.col(label).alias("__other"))
    votes = (
        near.select("left_id", "right_id")
        .join(own, "left_id")
        .join(other, "right_id")
        .groupBy("left_id")
        .agg(F.count_if(F.col("__own") != F.col("__other")).alias("n_other"), F.count("*").alias("__m"))
    )
    edge = (F.col("n_other") * 2 >= F.col("__m")) & (F.col("n_other") < F.col("__m"))
    return votes.filter(edge).select(F.col("left_id").alias(key), "n_other")


def borderline_smote_synthetic(
    df: DataFrame,
    label: str,
    k: int = 5,
    m: int = 10,
    seed: int = 42,
    key: str = "row_id",
    vec: str = "features",
    **tiling,
) -> DataFrame:
    """As SMOTE, with base rows taken from the class border only; a class
    without border rows gets none."""
    rows = materialize(df.select(key, label, F.col(vec).cast("array<double>").alias(vec)), "bsmote")
    border = materialize(danger_rows(rows, label, m, key, vec, **tiling).select(key), "border")
    edge = rows.join(border, key, "left_semi")
    sizes, on_edge = _class_sizes(rows, label), _class_sizes(edge, label)
    top = max(sizes.values())
    parts = []
    for c in sorted(sizes):
        if sizes[c] < top and on_edge.get(c):
            own = rows.filter(F.col(label) == F.lit(c))
            base = edge.filter(F.col(label) == F.lit(c))
            parts.append(_synthesize(base, own, top - sizes[c], c, label, k, seed, key, vec, **tiling))
    return union_all(*parts) if parts else _no_rows(rows, label, key, vec)


def oversample(df: DataFrame, label: str, method: str = "smote", key: str = "row_id", vec: str = "features", **kw) -> DataFrame:
    """Original and synthetic rows: (key or null, label, vec)."""
    makers = {"smote": smote_synthetic, "borderline": borderline_smote_synthetic}
    if method not in makers:
        raise ValueError(f"method must be one of {sorted(makers)}, got {method!r}")
    new = makers[method](df, label, key=key, vec=vec, **kw)
    kind = df.schema[key].dataType
    base = df.select(key, label, F.col(vec).cast("array<double>").alias(vec))
    return base.unionByName(new.select(F.lit(None).cast(kind).alias(key), label, vec))
