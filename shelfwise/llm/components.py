"""Connected components by alternating large and small stars.

Each round links the larger neighbours of a node to the smallest node it knows,
then does the same for the smaller ones; every round is written to the shared
folder. Hubs do no harm: the smallest neighbour is an aggregate, and the join
with it is one that Spark splits where a key is hot.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import materialize, release


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node reached.

    Loops and repeated edges do no harm; rows with a null end are ignored; no
    edges give no rows. Raises if ``max_rounds`` is not enough.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, "component-edges")
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        held = large.join(low, "u")
        small = held.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.toDF("u", "v"))
        done, e = e, materialize(small.where("u <> v").distinct(), "component-edges")
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(done)
        if mark == seen:
            roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return e.toDF("node", "root").union(roots)
        seen = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Positions of the edges of a spanning forest, in one task."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    up = np.arange(len(names))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, np.int64)
