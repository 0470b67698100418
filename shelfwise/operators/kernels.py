"""Classifiers that Spark ML lacks: discriminants, linear SVMs of all classes at
once, neighbour votes, random Fourier features.

Each has the shape of an ML estimator (set the columns, fit, transform), so that
``learn.fit_classifier`` treats them like any other.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators.neighbors import knn_join
from shelfwise.session import materialize, release

TASKS_PER_SUM = 64
_MOMENTS = "y double, n double, sums binary, outer binary"


class _Estimator:
    """Columns set one by one, as an ML estimator's are."""

    def __init__(self):
        self.features, self.label, self.weight = "__x", "__y", None

    def setFeaturesCol(self, c):  # noqa: N802
        self.features = c
        return self

    def setLabelCol(self, c):  # noqa: N802
        self.label = c
        return self

    def setWeightCol(self, c):  # noqa: N802
        self.weight = c
        return self

    def setPredictionCol(self, c):  # noqa: N802
        return self

    setRawPredictionCol = setProbabilityCol = setPredictionCol


# -- discriminants ------------------------------------------------------------------
def _moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per class: weight, weighted sum and sum of outer products of a task's rows."""
    total: dict[float, list] = {}
    for pdf in frames:
        for y, part in pdf.groupby("y"):
            x, w = np.stack(part["v"].to_numpy()).astype(np.float64), part["w"].to_numpy(np.float64)
            own = total.setdefault(float(y), [0.0, np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))])
            own[0] += w.sum()
            own[1] += w @ x
            own[2] += (x * w[:, None]).T @ x
    if total:
        yield pd.DataFrame(
            [(y, n, s.tobytes(), o.tobytes()) for y, (n, s, o) in total.items()], columns=["y", "n", "sums", "outer"]
        )


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = lambda c: np.sum([np.frombuffer(x) for x in pdf[c]], axis=0).tobytes()
    return pd.DataFrame({"y": [pdf["y"].iloc[0]], "n": [pdf["n"].sum()], "sums": [total("sums")], "outer": [total("outer")]})


def class_moments(df: DataFrame, vec: str, label: str, weight: str | None = None) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """class -> (weight, mean, scatter about the mean), in one reading.

    The driver holds one width x width matrix per class.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(label).cast("double").alias("y"), F.col(vec).alias("v"), w.alias("w")).filter("y is not null and v is not null")
    part = F.floor(F.spark_partition_id() / TASKS_PER_SUM).alias("part")
    some = rows.mapInPandas(_moments, _MOMENTS).select("*", part).groupBy("y", "part").applyInPandas(_add, _MOMENTS)
    out = {}
    for r in some.groupBy("y").applyInPandas(_add, _MOMENTS).collect():
        mean = np.frombuffer(r["sums"]) / r["n"]
        outer = np.frombuffer(r["outer"]).reshape(len(mean), len(mean))
        out[int(r["y"])] = (r["n"], mean, outer - r["n"] * np.outer(mean, mean))
    return dict(sorted(out.items()))


class Discriminant(_Estimator):
    """Linear (one covariance for all classes) or quadratic (one each) discriminant.

    Covariances are divided by the weight less the number of classes (linear) or
    less one (quadratic). ``ridge``, a share of the mean variance, is added to the
    diagonal; directions without variance are left out by the pseudo-inverse.
    """

    def __init__(self, quadratic: bool = False, ridge: float = 0.0):
        super().__init__()
        self.quadratic, self.ridge = quadratic, ridge

    def fit(self, df: DataFrame) -> "DiscriminantModel":
        data = df.withColumn("__a", vector_to_array(self.features))
        found = class_moments(data, "__a", self.label, self.weight)
        if not found:
            raise ValueError("no labelled rows")
        total = sum(n for n, _, _ in found.values())
        pooled = sum(s for _, _, s in found.values()) / max(total - len(found), 1.0)
        classes = max(found) + 1
        width = len(pooled)
        means, factors, offsets = np.zeros((classes, width)), np.zeros((classes, width, width)), np.full(classes, -np.inf)
        for y, (n, mean, scatter) in found.items():
            cov = scatter / max(n - 1, 1.0) if self.quadratic else pooled
            cov = cov + np.eye(width) * self.ridge * np.trace(cov) / width
            values, axes = np.linalg.eigh(cov)
            ok = values > max(values.max(), 0.0) * width * np.finfo(float).eps
            means[y] = mean
            factors[y] = np.where(ok, axes / np.sqrt(np.where(ok, values, 1.0)), 0.0)
            offsets[y] = np.log(n / total) - np.log(values[ok]).sum() / 2
        return DiscriminantModel(means, factors, offsets)


class DiscriminantModel:
    """Class scores: log prior, less half the log determinant and the squared distance."""

    def __init__(self, means: np.ndarray, factors: np.ndarray, offsets: np.ndarray):
        self.means, self.factors, self.offsets = means, factors, offsets

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.means)))
        for y, (m, f, o) in enumerate(zip(self.means, self.factors, self.offsets, strict=True)):
            z = (x - m) @ f
            out[:, y] = o - (z * z).sum(1) / 2
        return out

    def transform(self, df: DataFrame, vec: str = "__x", out: str = "__prob", raw: bool = False) -> DataFrame:
        """Add class probabilities as a vector (or, ``raw``, the scores as an array)."""

        def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in frames:
                s = self.scores(np.stack(v.to_numpy()).astype(np.float64)) if len(v) else np.zeros((0, len(self.means)))
                if not raw:
                    s = np.exp(s - s.max(axis=1, keepdims=True, initial=-np.inf))
                    s /= s.sum(axis=1, keepdims=True)
                yield pd.Series(list(s))

        score = F.pandas_udf(run, T.ArrayType(T.DoubleType()))
        found = score(vector_to_array(vec))
        return df.withColumn(out, found if raw else array_to_vector(found))


# -- linear SVMs ------------------------------------------------------------------------
#: rows of a packed block, and tasks of a reading at most
SVM_ROWS = 1 << 10
SVM_TASKS = 256
#: bytes of a file of blocks, which is read as one batch
SVM_BYTES = 16 << 20
#: of the search: corrections kept, values looked back on, steps tried
_CORRECTIONS, _LOOK_BACK, _STEPS = 10, 20, 20
#: steps after one that is low enough, to find a better slope
_MORE = 2


def _search(x: np.ndarray, max_iter: int, tol: float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS that yields the points at which it wants (value, gradient), and returns the last.

    Steps obey the strong Wolfe conditions; a hinge may leave none, then the best of
    the first points that are low enough is taken.
    """
    f, g = yield x
    first, values, pairs = abs(f), [f], []
    for it in range(max_iter):
        if np.linalg.norm(g) <= max(tol * abs(f), 1e-8):
            break
        back, d = [], g
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            back.append(a)
            d = d - a * y
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(back), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        d = -d
        if g @ d >= 0:
            pairs, d = [], -g
        slope, found, more = g @ d, None, 0
        step = 1.0 if pairs else 0.5 / np.linalg.norm(g)
        for _ in range(_STEPS):
            fn, gn = yield x + step * d
            low = fn <= f + 1e-4 * step * slope
            if low and (found is None or fn < found[0]):
                found = fn, gn, x + step * d
            if low and abs(gn @ d) <= -0.9 * slope:
                found = fn, gn, x + step * d
                break
            more += found is not None
            if more > _MORE:
                break
            step *= 2.1 if low and gn @ d < 0 else 0.5 if it else 0.1
        if found is None:
            if not pairs:
                break
            pairs = []
            continue
        fn, gn, xn = found
        if (xn - x) @ (gn - g) > 0:
            pairs = [*pairs, (xn - x, gn - g)][-_CORRECTIONS:]
        x, f, g = xn, fn, gn
        if abs(f - max(values[-_LOOK_BACK:])) <= tol * first:
            break
        values.append(f)
    return x


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for a in range(0, len(pdf), SVM_ROWS):
            part = pdf.iloc[a : a + SVM_ROWS]
            x = np.stack(part["v"].to_numpy()).astype(np.float64)
            rest = part[["y", "w"]].to_numpy(np.float64)
            yield pd.DataFrame({"x": [x.tobytes()], "y": [rest[:, 0].tobytes()], "w": [rest[:, 1].tobytes()]})


def _blocks(frames: Iterator[pd.DataFrame], lift: FourierMap | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for pdf in frames:
        for x, y, w in zip(pdf["x"], pdf["y"], pdf["w"], strict=True):
            y = np.frombuffer(y)
            x = np.frombuffer(x).reshape(len(y), -1)
            yield lift.map(x) if lift else x, y, np.frombuffer(w)


def _spreads(lift: FourierMap | None):
    """Per task: weight, its squares, greatest class, mean and squares about it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for x, y, w in _blocks(frames, lift):
            n = w.sum()
            mean = w @ x / n if n else np.zeros(x.shape[1])
            total = _both(total, np.concatenate([[n, w @ w, y.max()], mean, w @ (x - mean) ** 2]))
        if total is not None:
            yield pd.DataFrame({"s": [total.tobytes()]})

    return run


def _both(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    if a is None:
        return b
    width, n = (len(a) - 3) // 2, a[0] + b[0]
    gap, share = b[3 : 3 + width] - a[3 : 3 + width], b[0] / n if n else 0.0
    squares = a[3 + width :] + b[3 + width :] + gap * gap * a[0] * share
    return np.concatenate([[n, a[1] + b[1], max(a[2], b[2])], a[3 : 3 + width] + gap * share, squares])


def _hinges(coef: np.ndarray, offset: np.ndarray, classes: np.ndarray, lift: FourierMap | None):
    """Per task: summed hinge losses of all classes, and their gradients."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(classes), coef.shape[1] + 2))
        for x, y, w in _blocks(frames, lift):
            sign = np.where(y[:, None] == classes, 1.0, -1.0)
            slack = 1.0 - sign * (x @ coef.T + offset)
            pull = np.where(slack > 0, sign * w[:, None], 0.0)
            total[:, 0] += w @ np.maximum(slack, 0.0)
            total[:, 1] -= pull.sum(0)
            total[:, 2:] -= pull.T @ x
        yield pd.DataFrame({"s": [total.tobytes()]})

    return run


class LinearMargins(_Estimator):
    """One linear SVM per class against the rest, all classes in the same readings.

    Each class has the objective of ML's ``LinearSVC`` (mean hinge loss over
    standardised features, half ``regParam`` times the squared coefficients) and a
    search of its own; the points at which the searches want the loss go through
    one job. The driver holds classes x width numbers per task. With ``lift`` the
    features are mapped block by block in each reading; mapped rows are never stored.
    """

    def __init__(
        self, regParam: float = 0.0, maxIter: int = 100, tol: float = 1e-6, fitIntercept: bool = True,  # noqa: N803
        standardization: bool = True, lift: FourierMap | None = None,
    ):
        super().__init__()
        self.lift = lift
        self.reg, self.max_iter, self.tol, self.intercept, self.standard = regParam, maxIter, tol, fitIntercept, standardization

    def fit(self, df: DataFrame) -> "MarginsModel":
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = df.select(vector_to_array(self.features).alias("v"), F.col(self.label).cast("double").alias("y"), w.alias("w"))
        wide = rows.agg(F.max(F.size("v"))).first()[0] or 1
        table = materialize(
            rows.mapInPandas(_pack, "x binary, y binary, w binary"), "svm", max(1, SVM_BYTES // (8 * wide * SVM_ROWS))
        )
        blocks = table.coalesce(SVM_TASKS)
        whole = None
        for r in blocks.mapInPandas(_spreads(self.lift), "s binary").collect():
            whole = _both(whole, np.frombuffer(r["s"]))
        if whole is None:
            raise ValueError("no labelled rows")
        width, n = (len(whole) - 3) // 2, whole[0]
        mean = whole[3 : 3 + width] if self.intercept else np.zeros(width)
        std = np.sqrt(whole[3 + width :] / max(n - whole[1] / n, np.finfo(float).tiny))
        scale = np.divide(1.0, std, out=np.zeros(width), where=std > 0)
        # the penalty is on the coefficients of the standardised or of the given features
        penalty = self.reg * (np.ones(width) if self.standard else scale * scale)

        def plain(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            coef = points[:, 1:] * scale
            return coef, points[:, 0] * self.intercept - coef @ mean

        def losses(points: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            parts = blocks.mapInPandas(_hinges(*plain(points), classes, self.lift), "s binary").collect()
            total = np.sum([np.frombuffer(r["s"]) for r in parts], axis=0).reshape(len(classes), width + 2) / n
            grad = np.empty_like(points)
            grad[:, 0] = total[:, 1] * self.intercept
            grad[:, 1:] = (total[:, 2:] - total[:, 1:2] * mean) * scale + penalty * points[:, 1:]
            return total[:, 0] + (penalty * points[:, 1:] ** 2).sum(1) / 2, grad

        found = np.zeros((int(whole[2]) + 1, width + 1))
        runs = [_search(found[c].copy(), self.max_iter, self.tol) for c in range(len(found))]
        asked = {c: next(run) for c, run in enumerate(runs)}
        while asked:
            classes = np.array(sorted(asked))
            values, grads = losses(np.stack([asked[c] for c in classes]), classes)
            for c, value, grad in zip(classes.tolist(), values, grads, strict=True):
                try:
                    asked[c] = runs[c].send((float(value), grad))
                except StopIteration as end:
                    found[c] = end.value
                    del asked[c]
        release(table)
        return MarginsModel(*plain(found), self.lift)


class MarginsModel:
    def __init__(self, coef: np.ndarray, offset: np.ndarray, lift: FourierMap | None = None):
        self.coef, self.offset, self.lift = coef, offset, lift

    def margins(self, vec: str) -> Column:
        """The margin of each class."""

        def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in frames:
                found = []
                for a in range(0, len(v), SVM_ROWS):
                    x = np.stack(v.iloc[a : a + SVM_ROWS].to_numpy()).astype(np.float64)
                    found += list((self.lift.map(x) if self.lift else x) @ self.coef.T + self.offset)
                yield pd.Series(found, dtype=object)

        return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(vector_to_array(vec))


# -- neighbour votes -------------------------------------------------------------------
class Neighbours(_Estimator):
    """Votes of the k nearest training rows, equal or by inverse distance; keeps the rows.

    Tables are keyed by ``key``.
    """

    def __init__(self, k: int = 5, weights: str = "uniform", metric: str = "euclidean", key: str = "row_id"):
        super().__init__()
        self.k, self.weights, self.metric, self.key = k, weights, metric, key

    def fit(self, df: DataFrame) -> "NeighboursModel":
        rows = df.select(self.key, vector_to_array(self.features).alias("v"), F.col(self.label).cast("int").alias("y"))
        rows = materialize(rows.filter("y is not null"), "neighbours")
        return NeighboursModel(self, rows, rows.agg(F.max("y")).first()[0] + 1)


class NeighboursModel:
    def __init__(self, how: Neighbours, rows: DataFrame, classes: int):
        self.how, self.rows, self.classes = how, rows, classes

    def transform(self, df: DataFrame) -> DataFrame:
        h = self.how
        asked = df.select(h.key, vector_to_array(h.features).alias("v"))
        near = knn_join(asked, self.rows, h.k, h.metric, h.key, h.key, "v")
        near = near.join(self.rows.select(F.col(h.key).alias("right_id"), "y"), "right_id")
        if h.weights == "uniform":
            w = F.lit(1.0)
        else:  # a neighbour at distance 0 outweighs all others
            first = near.groupBy("left_id").agg(F.min("distance").alias("least"))
            near = near.join(first, "left_id")
            w = F.when(F.col("least") == 0, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
        votes = near.withColumn("w", w).groupBy(F.col("left_id").alias(h.key)).agg(
            F.array(*[F.coalesce(F.sum(F.when(F.col("y") == c, F.col("w"))), F.lit(0.0)) for c in range(self.classes)]).alias("votes"),
            F.sum("w").alias("all"),
        )
        share = F.transform("votes", lambda x: x / F.col("all"))
        return df.join(votes.select(h.key, array_to_vector(share).alias("__prob")), h.key)


# -- random Fourier features ---------------------------------------------------------------
class FourierMap:
    """Features whose inner products approach the RBF kernel exp(-gamma |x - y|^2).

    sqrt(2 / m) cos(x W + b) with W normal of variance 2 gamma and b uniform: each
    inner product is a mean of m terms in [-2, 2], so it is off by more than t with
    a chance of at most 2 exp(-m t^2 / 8).
    """

    def __init__(self, width: int, gamma: float, m: int = 512, seed: int = 42):
        rng = np.random.default_rng([seed, width, m])
        self.w = rng.normal(0.0, np.sqrt(2 * gamma), (width, m))
        self.b = rng.uniform(0, 2 * np.pi, m)

    @classmethod
    def fit(cls, df: DataFrame, vec: str, gamma: float | None = None, m: int = 512, seed: int = 42) -> "FourierMap":
        """``gamma`` defaults to 1 / (width x variance of all components)."""
        rows = df.select(vector_to_array(vec).alias("v"))
        x = F.explode("v").alias("x")
        width = rows.agg(F.max(F.size("v"))).first()[0]
        if gamma is None:
            spread = rows.select(x).agg(F.var_pop("x")).first()[0]
            gamma = 1.0 / (width * (spread or 1.0))
        return cls(width, gamma, m, seed)

    def map(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / len(self.b)) * np.cos(x @ self.w + self.b)

    def transform(self, df: DataFrame, vec: str = "__x", out: str = "__z") -> DataFrame:
        def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in frames:
                yield pd.Series(list(self.map(np.stack(v.to_numpy()).astype(np.float64))) if len(v) else [], dtype=object)

        return df.withColumn(out, array_to_vector(F.pandas_udf(run, T.ArrayType(T.DoubleType()))(vector_to_array(vec))))
