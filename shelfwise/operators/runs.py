"""Tables that compare fitted runs."""

from __future__ import annotations

import time
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.scalars import fraction_to_percent
from shelfwise.operators.relational import union_relaxed, with_provenance


class RunTimer:
    """Wall seconds per (model, labelled fraction), kept as rows."""

    def __init__(self):
        self.rows: list[tuple[str, float, float]] = []

    @contextmanager
    def timed(self, model: str, fraction: float):
        t0 = time.time()
        try:
            yield
        finally:
            self.rows.append((model, float(fraction), time.time() - t0))

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "model string, labeled_fraction double, training_time double")


def compare_runs(parts: dict[str, DataFrame], score: str = "accuracy", fraction: str = "labeled_fraction") -> DataFrame:
    """Runs of several balancing variants or methods in one table: percent
    instead of fraction, absent metrics null, the best row of each percent
    flagged."""
    tagged = [with_provenance(df, "balancing", name) for name, df in parts.items()]
    runs = union_relaxed(*tagged).withColumn("labeled_percentage", fraction_to_percent(fraction)).drop(fraction)
    order = F.struct((-F.col(score)).alias("s"), "balancing", "model")
    best = runs.groupBy("labeled_percentage").agg(F.min_by(F.struct("balancing", "model"), order).alias("b"))
    best = best.select("labeled_percentage", "b.balancing", "b.model", F.lit(True).alias("best"))
    out = runs.join(best, ["labeled_percentage", "balancing", "model"], "left")
    return out.withColumn("best", F.coalesce("best", F.lit(False)))


def mean_std_text(mean: str, std: str, digits: int = 4):
    fmt = f"%.{digits}f"
    return F.concat(F.format_string(fmt, F.col(mean)), F.lit(" ± "), F.format_string(fmt, F.col(std)))


def bootstrap_table(runs: DataFrame, metric: str, percents: Sequence[int] | None = None, digits: int = 4) -> DataFrame:
    """model x labelled percent, cells 'mean ± std' of one metric."""
    cell = mean_std_text(f"mean_{metric}", f"std_{metric}", digits)
    rows = runs.select("model", "labeled_percentage", cell.alias("cell"))
    return rows.groupBy("model").pivot("labeled_percentage", percents).agg(F.first("cell"))


def pseudo_label_table(runs: DataFrame, percents: Sequence[int] | None = None) -> DataFrame:
    """(balancing, model) x labelled percent, cells pseudo-label counts."""
    return runs.groupBy("balancing", "model").pivot("labeled_percentage", percents).agg(F.sum("pseudo_label_count"))
