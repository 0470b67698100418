"""Encoders, scalers, projections: fit on one table, apply to any."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions import scalars as S
from shelfwise.functions.vectors import has_nan
from shelfwise.operators.quantiles import exact_quantiles
from shelfwise.operators.text import TfidfModel


class OneHot:
    """One 0/1 column per category seen in fit, named ``col_value``; an unseen
    value gives zeros."""

    def __init__(self, categories: Mapping[str, Sequence]):
        self.categories = {c: list(v) for c, v in categories.items()}

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str]) -> "OneHot":
        """Distinct values of all columns in one aggregation by (column, value)."""
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])
        seen = df.select(F.inline(cells)).filter(F.col("v").isNotNull()).distinct().collect()
        kinds = dict(df.dtypes)
        found: dict[str, list] = {c: [] for c in cols}
        for r in seen:
            found[r["c"]].append(r["v"])
        numeric = lambda c: kinds[c] in ("int", "bigint", "smallint", "tinyint", "double", "float")
        return cls({c: sorted(v, key=float if numeric(c) else str) for c, v in found.items()})

    def columns(self) -> dict[str, Column]:
        out = {}
        for c, values in self.categories.items():
            for v in values:
                hit = F.coalesce(F.col(c).cast("string") == F.lit(v), F.lit(False))
                out[f"{c}_{v}"] = hit.cast("double")
        return out

    def names(self) -> list[str]:
        return [f"{c}_{v}" for c, vs in self.categories.items() for v in vs]


class RobustScale:
    """(x - median) / (q75 - q25) with exact linear quantiles; IQR 0 divides by
    1; nulls are ignored in fit and stay null."""

    def __init__(self, stats: Mapping[str, tuple[float, float]]):
        self.stats = dict(stats)

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str]) -> "RobustScale":
        rows = exact_quantiles(df, cols, [0.25, 0.5, 0.75]).collect()
        return cls({r["column"]: (r["q1"], (r["q2"] - r["q0"]) or 1.0) for r in rows})

    def column(self, name: str, value: Column | None = None) -> Column:
        value = F.col(name).cast("double") if value is None else value
        if name not in self.stats:  # no non-null value was seen
            return value
        mid, width = self.stats[name]
        return (value - F.lit(float(mid))) / F.lit(float(width))


class FeaturePipeline:
    """One-hot categories, scaled numbers (some or all after log1p) and an
    optional TF-IDF block, fitted on training rows only."""

    def __init__(self, one_hot, scale, nums, logs, tfidf=None, text=None):
        self.one_hot, self.scale, self.nums, self.logs = one_hot, scale, list(nums), set(logs)
        self.tfidf, self.text = tfidf, text

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        cats: Sequence[str],
        nums: Sequence[str],
        logs: Sequence[str] | None = None,
        text: str | None = None,
        key: str = "row_id",
        min_df: float = 0.005,
        max_df: float = 0.99,
    ) -> "FeaturePipeline":
        """``logs`` lists the numbers to pass through log1p first; None = all."""
        logs = list(nums) if logs is None else list(logs)
        one_hot = OneHot.fit(df, cats) if cats else OneHot({})
        shifted = df.select(*[cls._value(c, c in logs).alias(c) for c in nums]) if nums else None
        scale = RobustScale.fit(shifted, nums) if nums else RobustScale({})
        tfidf = TfidfModel.fit(df, text, key, min_df, max_df) if text else None
        return cls(one_hot, scale, nums, logs, tfidf, text)

    @staticmethod
    def _value(c: str, log: bool) -> Column:
        return S.log1p(c) if log else F.col(c).cast("double")

    def columns(self) -> dict[str, Column]:
        """Named encoded columns: categories first, then numbers in input order."""
        out = self.one_hot.columns()
        for c in self.nums:
            out[c] = self.scale.column(c, self._value(c, c in self.logs))
        return out

    def transform_named(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.select(*keep, *[c.alias(n) for n, c in self.columns().items()])

    def transform(self, df: DataFrame, out: str = "features", keep: Sequence[str] | None = None) -> DataFrame:
        """Add one ML vector; sparse where the text block is sparse."""
        keep = list(df.columns) if keep is None else list(keep)
        staged = df
        parts = []
        if self.tfidf is not None:
            staged = self.tfidf.transform(staged, self.text, "__text")
            parts = ["__text"]
        enc = {f"__f{i}": c for i, c in enumerate(self.columns().values())}
        staged = staged.withColumns(enc) if enc else staged
        asm = VectorAssembler(inputCols=list(enc) + parts, outputCol=out, handleInvalid="keep")
        return asm.transform(staged).select(*keep, out)

    def feature_names(self) -> list[str]:
        names = self.one_hot.names() + self.nums
        return names + (self.tfidf.feature_names(self.text) if self.tfidf else [])


def numcat_pipeline(df: DataFrame, cats, nums, log_cols=()) -> FeaturePipeline:
    """One-hot, log1p + scale for ``log_cols``, scale for the other numbers."""
    return FeaturePipeline.fit(df, cats, nums, log_cols)


def ssl_pipeline(df: DataFrame, cats, nums, text: str | None = None, key: str = "row_id", **kw) -> FeaturePipeline:
    """One-hot, log1p + scale for all numbers, optional TF-IDF."""
    return FeaturePipeline.fit(df, cats, nums, None, text, key, **kw)


class LabelCodec:
    """Sorted classes to 0..k-1 and back. Classes are few and held as literals."""

    def __init__(self, classes: Sequence):
        self.classes = list(classes)

    @classmethod
    def fit(cls, df: DataFrame, label: str) -> "LabelCodec":
        rows = df.select(label).filter(F.col(label).isNotNull()).distinct().collect()
        return cls(sorted(r[0] for r in rows))

    def encode(self, c: str) -> Column:
        pos = F.array_position(F.array(*[F.lit(v) for v in self.classes]), F.col(c))
        return F.when(pos > 0, (pos - 1).cast("int"))

    def decode(self, c: str) -> Column:
        return F.get(F.array(*[F.lit(v) for v in self.classes]), F.col(c).cast("int"))


def binarize_label(df: DataFrame, label: str, classes: Sequence, prefix: str = "is_") -> DataFrame:
    """One 0/1 column per class."""
    return df.withColumns(
        {f"{prefix}{c}": F.coalesce(F.col(label) == F.lit(c), F.lit(False)).cast("int") for c in classes}
    )


def nan_check(df: DataFrame, vec: str = "features") -> DataFrame:
    """How many vectors hold a NaN."""
    return df.agg(F.count("*").alias("n"), F.count_if(has_nan(vec)).alias("n_nan"))


def important_features(importances: Sequence[float]) -> list[int]:
    """Indices with at least the mean importance."""
    mean = float(np.mean(importances))
    return [i for i, v in enumerate(importances) if v >= mean]


def select_by_importance(df: DataFrame, importances: Sequence[float], vec: str = "features", out: str = "selected"):
    """Keep the features whose importance reaches the mean: (frame, indices)."""
    keep = important_features(importances)
    return VectorSlicer(inputCol=vec, outputCol=out, indices=keep).transform(df), keep


# -- principal components -----------------------------------------------------
def moments(df: DataFrame, vec: str = "features") -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, sample covariance) of array vectors.

    Each task sends one width x width sum; the driver adds nothing that grows
    with the rows.
    """
    parts = _moment_parts(df, vec).collect()
    n = sum(p["n"] for p in parts)
    total = np.sum([np.array(p["s"]) for p in parts], axis=0)
    width = len(total)
    gram = np.sum([np.array(p["g"]) for p in parts], axis=0).reshape(width, width)
    mean = total / n
    return n, mean, (gram - n * np.outer(mean, mean)) / max(n - 1, 1)


def _moment_parts(df: DataFrame, vec: str) -> DataFrame:
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, None, None
        for pdf in frames:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            s = x.sum(0) if s is None else s + x.sum(0)
            g = x.T @ x if g is None else g + x.T @ x
            n += len(x)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "g": [g.ravel()]})

    sums = df.select(F.col(vec).cast("array<double>").alias("v")).mapInPandas(fold, "n long, s array<double>, g array<double>")
    # tasks are folded on the executors in element-wise sums before the driver
    wide = sums.select("n", F.posexplode(F.concat("s", "g")).alias("i", "x"), F.size("s").alias("w"))
    folded = wide.groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.max("w").alias("w"))
    cells = F.array_sort(F.collect_list(F.struct("i", "x")))
    one = folded.groupBy().agg(F.max("n").alias("n"), F.max("w").alias("w"), cells.alias("c"))
    vals = F.transform("c", lambda x: x["x"])
    return one.filter("n is not null").select(
        "n", F.slice(vals, F.lit(1), F.col("w")).alias("s"), F.slice(vals, F.col("w") + 1, F.col("w") * F.col("w")).alias("g")
    )


def covariance(df: DataFrame, vec: str = "features") -> DataFrame:
    """(i, j, cov) in long form."""
    _, _, cov = moments(df, vec)
    w = len(cov)
    rows = [(i, j, float(cov[i, j])) for i in range(w) for j in range(w)]
    return df.sparkSession.createDataFrame(rows, "i int, j int, cov double")


class Pca:
    """Centred principal components up to a share of the variance."""

    def __init__(self, mean: np.ndarray, basis: np.ndarray, variances: np.ndarray, total: float):
        self.mean, self.basis, self.variances, self.total = mean, basis, variances, total

    @classmethod
    def fit(cls, df: DataFrame, share: float = 0.95, vec: str = "features") -> "Pca":
        _, mean, cov = moments(df, vec)
        values, vectors = np.linalg.eigh(cov)
        values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
        cum = np.cumsum(values) / values.sum()
        k = int(np.searchsorted(cum, share - 1e-12) + 1)
        # sign: the entry of largest size in each direction is positive
        top = np.abs(vectors).argmax(0)
        vectors = vectors * np.sign(vectors[top, np.arange(vectors.shape[1])])
        return cls(mean, vectors[:, :k], values[:k], float(values.sum()))

    def explained_ratio(self) -> list[float]:
        return [float(v / self.total) for v in self.variances]

    def transform(self, df: DataFrame, vec: str = "features", out: str = "pca") -> DataFrame:
        schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.DoubleType()))])
        mean, basis = self.mean, self.basis

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                if len(pdf):
                    x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
                    yield pdf.assign(**{out: list((x - mean) @ basis)})

        return df.mapInPandas(run, schema)
