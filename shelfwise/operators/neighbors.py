"""Exact nearest neighbours and kernel sums as a partitioned distance join.

Rows are routed to cells around a bounded set of pivots. The triangle
inequality tells which right rows can matter to a left cell, so only those are
sent there; oversized cells are cut into blocks on both sides, and one task
sees one block pair. Where this leaves out less than half of the pairs, cells are
given up: rows are cut into blocks by hash, as few as fill the task slots and fit
a worker, so each row travels a few times only. Tasks compute a block of distances
with numpy and emit at most k rows (or one sum) per left row, never the pairs.
Equal vectors are collapsed first, so a group of copies costs one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.hashing import hash_order
from shelfwise.functions.vectors import as_doubles, l2_normalize, squared_distance, norm
from shelfwise.session import materialize

MAX_PIVOTS = 2_048
ROWS_PER_PIVOT = 4_000
#: vectors of a block in memory, at most, and its least number of rows
BLOCK_BYTES = 24 << 20
LEAST_ROWS = 1_000
#: block pairs for each task slot, so that slots stay even
PAIRS_PER_SLOT = 6
#: cells are kept where they leave out all but one in so many pairs
PRUNED = 2
_SLACK = 1e-7


# -- centroids ------------------------------------------------------------------
def nearest_centroid(df: DataFrame, centroids: Sequence[Sequence[float]], vec: str = "features") -> DataFrame:
    """Add ``cluster`` and ``distance`` to the nearest of a fixed, small list of
    centroids (lowest index on ties): one map-side expression, no join."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])
    dists = F.transform(table, lambda c: squared_distance(F.col(vec), c))
    out = df.withColumn("__d", dists)
    best = F.array_min("__d")
    return out.withColumns(
        {"cluster": (F.array_position("__d", best) - 1).cast("int"), "distance": F.sqrt(best)}
    ).drop("__d")


# -- distance join ----------------------------------------------------------------
def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64, copy=False)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances through one matrix product (small rounding error)."""
    sq = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    return np.maximum(sq, 0.0)


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    every = np.arange(len(x))
    return _exact_pairs(x, y, every, every)


def _exact_pairs(x: np.ndarray, y: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Distances of the named pairs; however many there are, few are gathered at a time."""
    out = np.empty(len(row))
    for i in range(0, len(row), EXACT_ROWS):
        diff = x[row[i : i + EXACT_ROWS]] - y[col[i : i + EXACT_ROWS]]
        out[i : i + EXACT_ROWS] = np.sqrt((diff * diff).sum(1))
    return out


#: distances held at a time by the router and by the kernels that want whole rows, and rows compared by differences
ROUTE_PAIRS = 1 << 18
KERNEL_PAIRS = 1 << 20
EXACT_ROWS = 1 << 14
#: a tile stays in a core's cache, and its sides are long enough for the matrix product
TILE_ROWS, TILE_COLS = 256, 1024
#: squares below this share of the rows' own are taken from differences
_CLOSE = 1e-6


class _Squares:
    """Squared distances by one matrix product: the squares of both sides' rows about
    the mean are two more columns. Of close and equal rows they are taken from
    differences, so that these keep their digits."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y
        mid = x.mean(0)
        u, v = x - mid, y - mid
        self.uu, self.vv = (u * u).sum(1), (v * v).sum(1)
        self.left = np.column_stack([u, self.uu, np.ones(len(u))])
        self.right = np.vstack([-2.0 * v.T, np.ones(len(v)), self.vv])

    def fill(self, sq: np.ndarray, a: int, b: int) -> None:
        """The tile that starts at row ``a`` and column ``b``, of the shape of ``sq``."""
        rows, cols = slice(a, a + sq.shape[0]), slice(b, b + sq.shape[1])
        np.matmul(self.left[rows], self.right[:, cols], out=sq)
        close = _CLOSE * (self.uu[rows].max() + self.vv[cols].max())
        if sq.min() < close:
            row, col = np.nonzero(sq < close)
            sq[row, col] = _exact_pairs(self.x, self.y, a + row, b + col) ** 2


def square_tiles(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, squared distances) of the tiles that make up all pairs.
    Each tile takes the place of the last one in memory."""
    squares, held = _Squares(x, y), np.empty(TILE_ROWS * TILE_COLS)
    for a in range(0, len(x), TILE_ROWS):
        for b in range(0, len(y), TILE_COLS):
            n, m = min(TILE_ROWS, len(x) - a), min(TILE_COLS, len(y) - b)
            sq = held[: n * m].reshape(n, m)
            squares.fill(sq, a, b)
            yield a, b, sq


def square_blocks(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, squared distances of some rows of ``x`` to all of ``y``), as above."""
    step = max(1, KERNEL_PAIRS // len(y))
    squares = _Squares(x, y)
    for a in range(0, len(x), step):
        sq = np.empty((min(step, len(x) - a), len(y)))
        for b in range(0, len(y), TILE_COLS):
            squares.fill(sq[:, b : b + TILE_COLS], a, b)
        yield a, sq


def block_rows_for(pairs: float, width: int, slots: int) -> int:
    """Rows of a block: ``pairs`` make enough block pairs for all slots, and two
    blocks fit a worker."""
    most = max(1, BLOCK_BYTES // (8 * max(1, width)))
    return int(min(most, max(LEAST_ROWS, np.sqrt(pairs / (PAIRS_PER_SLOT * slots)))))


class _Router:
    """Pivots plus, per left cell, how far its rows reach and its block counts."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.reach = np.full(len(pivots), np.inf)
        self.left_blocks = np.ones(len(pivots), dtype=np.int64)
        self.right_blocks = np.ones(len(pivots), dtype=np.int64)

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = max(1, ROUTE_PAIRS // len(self.pivots))
        cell = np.concatenate([_distances(x[i : i + step], self.pivots).argmin(1) for i in range(0, len(x), step)])
        return cell, _exact(x, self.pivots[cell])

    def targets(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) pairs: the left cells each right row may matter to."""
        d = np.sqrt(_distances(x, self.pivots))
        slack = _SLACK * (1.0 + np.sqrt((x * x).sum(1)).max(initial=0.0) + np.abs(self.pivots).max(initial=0.0))
        return np.nonzero(d <= self.reach[None, :] + slack)

    def steps(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Rows whose targets are few enough to be held."""
        step = max(1, ROUTE_PAIRS // len(self.pivots))
        return (x[i : i + step] for i in range(0, len(x), step))


def _pick_pivots(df: DataFrame, key: str, vec: str, n_rows: int, seed: int, limit: int | None) -> np.ndarray:
    want = limit or int(min(MAX_PIVOTS, max(1, n_rows // ROWS_PER_PIVOT)))
    rows = df.orderBy(hash_order(key, seed), key).select(vec).limit(want).collect()
    return np.array([r[0] for r in rows], dtype=np.float64)


def _with_home(df: DataFrame, router: _Router, vec: str) -> DataFrame:
    """(__cell, __r) of each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                cell, r = router.home(_matrix(pdf[vec]))
                yield pd.DataFrame({"__cell": cell.astype(np.int32), "__r": r})

    return df.select(vec).mapInPandas(run, "__cell int, __r double")


def _spread(df: DataFrame, router: _Router, key: str, vec: str, side: str) -> DataFrame:
    """One row per block pair (__tile) a row takes part in.

    Python names the block pairs of a row; Spark repeats the row.
    """
    before = np.cumsum(router.left_blocks * router.right_blocks) - router.left_blocks * router.right_blocks

    def tiles(row: np.ndarray, cell: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
        left = side == "left"
        own, other = (router.left_blocks, router.right_blocks) if left else (router.right_blocks, router.left_blocks)
        mine, other = (h[row] % own[cell].astype(np.uint64)).astype(np.int64), other[cell]
        rep = np.repeat(np.arange(len(row)), other)
        theirs = np.arange(len(rep)) - np.repeat(np.cumsum(other) - other, other)
        a, b = (mine[rep], theirs) if left else (theirs, mine[rep])
        codes = before[cell[rep]] + a * router.right_blocks[cell[rep]] + b
        return np.split(codes, np.searchsorted(row[rep], np.arange(1, len(h))))

    def run(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for keys, vectors in series:
            out, at = [], 0
            if len(keys):
                h = pd.util.hash_array(keys.to_numpy())
                for x in router.steps(_matrix(vectors)):
                    row, cell = (np.arange(len(x)), router.home(x)[0]) if side == "left" else router.targets(x)
                    out += tiles(row, cell, h[at : at + len(x)])
                    at += len(x)
            yield pd.Series(out, dtype=object)

    placed = F.pandas_udf(run, T.ArrayType(T.LongType()))
    return df.withColumn("__tile", F.explode(placed(key, vec)))


def _route_counts(df: DataFrame, router: _Router, vec: str) -> dict[int, int]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(router.pivots), dtype=np.int64)
        for pdf in frames:
            if len(pdf):
                for x in router.steps(_matrix(pdf[vec])):
                    total += np.bincount(router.targets(x)[1], minlength=len(total))
        yield pd.DataFrame({"cell": np.arange(len(total), dtype=np.int32), "n": total})

    counted = df.select(vec).mapInPandas(run, "cell int, n long")
    return {r["cell"]: r["n"] for r in counted.groupBy("cell").agg(F.sum("n").alias("n")).collect()}


def _route(left: DataFrame, right: DataFrame, router: _Router, vec: str, k: int | None, radius: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Set the reach of every cell; (left rows, right rows) each then has."""
    homed = _with_home(left, router, vec)
    own = homed.groupBy("__cell").agg(F.count("*").alias("n"), F.max("__r").alias("u")).collect()
    m = len(router.pivots)
    far, here, there = np.zeros(m), np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
    for r in own:
        far[r["__cell"]], here[r["__cell"]] = r["u"], r["n"]
    if k is not None:
        near = W.partitionBy("__cell").orderBy("__r")
        radii = (
            _with_home(right, router, vec)
            .withColumn("__rn", F.row_number().over(near))
            .filter(F.col("__rn") <= k)
            .collect()
        )
        cells = np.array([r["__cell"] for r in radii], dtype=np.int64)
        rs = np.array([r["__r"] for r in radii])
        gaps = np.sqrt(_distances(router.pivots, router.pivots))
        for i in np.nonzero(here)[0]:
            if len(rs) >= k:
                bound = np.partition(far[i] + gaps[i, cells] + rs, k - 1)[k - 1]
                router.reach[i] = bound + far[i]
    elif radius is not None:
        router.reach = radius + far
    router.reach[here == 0] = -np.inf
    for cell, n in _route_counts(right, router, vec).items():
        there[cell] = n
    return here, there


def tile_join(
    left: DataFrame,
    right: DataFrame,
    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    left_key: str,
    right_key: str,
    vec: str,
    k: int | None = None,
    radius: float | None = None,
    seed: int = 7,
    pivots: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Run ``kernel`` on every block pair that can hold a neighbour.

    With ``k`` the reach of a left cell is an upper bound of its k-th neighbour
    distance; with ``radius`` it is that radius; with neither every pair of
    blocks is visited. ``pivots`` asks for so many cells, kept whatever they spare;
    ``block_rows`` is at most the rows of a block.
    """
    n_left, n_right = left.count(), right.count()
    bounded = k is not None or radius is not None
    router = _Router(_pick_pivots(right, right_key, vec, n_right, seed, pivots if bounded or pivots else 1))
    if not len(router.pivots):
        return left.sparkSession.createDataFrame([], schema)
    here, there = np.array([n_left]), np.array([n_right])
    if len(router.pivots) > 1:
        here, there = _route(left, right, router, vec, k, radius)
        if pivots is None and PRUNED * float(here @ there) > float(n_left) * n_right:
            router, here, there = _Router(router.pivots[:1]), np.array([n_left]), np.array([n_right])
    rows = block_rows or block_rows_for(
        float(here @ there), router.pivots.shape[1], left.sparkSession.sparkContext.defaultParallelism
    )
    router.left_blocks, router.right_blocks = (np.maximum(1, -(-n // rows)) for n in (here, there))
    lg = _spread(left, router, left_key, vec, "left").groupBy("__tile")
    rg = _spread(right, router, right_key, vec, "right").groupBy("__tile")
    return lg.cogroup(rg).applyInPandas(kernel, schema)


IDENTITY = ["__h1", "__h2"]


def _hashed(df: DataFrame, vec: str) -> DataFrame:
    """Two independent 64-bit hashes stand for a vector as grouping key."""
    return df.withColumn("__h1", F.xxhash64(vec)).withColumn("__h2", F.xxhash64(F.lit("second"), vec))


def collapse_copies(
    df: DataFrame, key: str, vec: str, by: Sequence[str] = (), extra: Sequence[Column] = ()
) -> tuple[DataFrame, DataFrame]:
    """(representatives, members): equal vectors become one row.

    Representatives hold (rep = smallest key, *by, vec, copies, hashes, extra
    aggregates); members hold (key, hashes) and cost no shuffle.
    """
    hashed = _hashed(df, vec)
    reps = hashed.groupBy(*by, *IDENTITY).agg(
        F.min(key).alias("rep"), F.first(vec).alias(vec), F.count("*").alias("copies"), *extra
    )
    return reps, hashed.select(key, *IDENTITY)


def _ready(df: DataFrame, key: str, vec: str, metric: str, out_key: str, side: int = 0) -> DataFrame:
    """(id, vector). For the cosine, two coordinates are added that are zero but
    for zero vectors: these point along their side's own axis, so that they are
    at distance 1 from every vector, zero vectors included."""
    v = as_doubles(vec)
    if metric == "cosine":
        own = F.array(F.lit(1.0 - side), F.lit(0.0 + side))
        none = F.array(F.lit(0.0), F.lit(0.0))
        v = F.concat(l2_normalize(v), F.when(norm(v) == 0, own).otherwise(none))
    elif metric != "euclidean":
        raise ValueError(f"unknown metric {metric!r}")
    return df.select(F.col(key).alias(out_key), v.alias("__v"))


#: distances of which only the least is ranked, to bound the k-th
GROUP = 32


def _bound(sq: np.ndarray, k: int) -> np.ndarray:
    """Per row at least its k-th smallest entry: the k-th smallest of the least of
    groups of entries, of which k different ones hold an entry each."""
    groups = sq.shape[1] // GROUP
    if groups > k:
        sq = sq[:, : groups * GROUP].reshape(len(sq), GROUP, groups).min(1)
    return np.partition(sq, k - 1, axis=1)[:, k - 1]


def _top_k_kernel(k: int, lk: str, rk: str, vec: str):
    def kernel(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if not len(lp) or not len(rp):
            return pd.DataFrame({lk: [], rk: [], "d": []})
        x, y = _matrix(lp[vec]), _matrix(rp[vec])
        kk = min(k, len(y))
        lids, rids = lp[lk].to_numpy(), rp[rk].to_numpy()
        least = 1.0 + ((y - x.mean(0)) ** 2).sum(1).max()
        own = ((x - x.mean(0)) ** 2).sum(1)
        place = np.empty(len(rids), dtype=np.int64)
        place[np.argsort(rids, kind="stable")] = np.arange(len(rids))
        parts = []
        for a, sq in square_blocks(x, y):  # many rows may be equally far: ties are cut row group by row group
            cut = _bound(sq, kk) + 1e-9 * (least + own[a : a + len(sq)])
            row, col = np.nonzero(sq <= cut[:, None])
            d = _exact_pairs(x, y, a + row, col)
            order = np.lexsort((place[col], d, row))
            row = row[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < kk
            row, order = row[first], order[first]
            parts.append(pd.DataFrame({lk: lids[a + row], rk: rids[col[order]], "d": d[order]}))
        return pd.concat(parts)

    return kernel


def knn_join(
    left: DataFrame,
    right: DataFrame,
    k: int,
    metric: str = "euclidean",
    left_key: str = "row_id",
    right_key: str = "row_id",
    vec: str = "features",
    exclude_self: bool = False,
    **tiling,
) -> DataFrame:
    """The k nearest right rows of every left row:
    (left_id, right_id, distance, rank), ties by right id.

    ``metric`` is 'euclidean' or 'cosine' (1 - cosine similarity; a zero vector
    is at distance 1 from every vector). ``exclude_self`` drops equal ids.
    """
    want = k + 1 if exclude_self else k
    l_rows = _ready(left, left_key, vec, metric, "id")
    same = left is right and left_key == right_key and metric != "cosine"
    l_reps, l_members = collapse_copies(l_rows, "id", "__v")
    l_reps = materialize(l_reps.select(F.col("rep").alias("lrep"), "__v", *IDENTITY), "knnleft")
    if same:
        r_reps, r_members = l_reps.withColumnRenamed("lrep", "rrep"), l_members
    else:
        r_reps, r_members = collapse_copies(_ready(right, right_key, vec, metric, "id", 1), "id", "__v")
        r_reps = materialize(r_reps.select(F.col("rep").alias("rrep"), "__v", *IDENTITY), "knnright")
    id_l, id_r = l_reps.schema["lrep"].dataType.simpleString(), r_reps.schema["rrep"].dataType.simpleString()
    tiles = tile_join(
        l_reps.drop(*IDENTITY), r_reps.drop(*IDENTITY), _top_k_kernel(want, "lrep", "rrep", "__v"),
        f"lrep {id_l}, rrep {id_r}, d double", "lrep", "rrep", "__v", k=want, **tiling,
    )
    best = W.partitionBy("lrep").orderBy("d", "rrep")
    near = tiles.withColumn("__rn", F.row_number().over(best)).filter(F.col("__rn") <= want).drop("__rn")
    # the first ``want`` ids of a group of copies are all that can be needed
    first_ids = W.partitionBy(*IDENTITY).orderBy("id")
    ids = (
        r_members.withColumn("__rn", F.row_number().over(first_ids))
        .filter(F.col("__rn") <= want)
        .groupBy(*IDENTITY)
        .agg(F.collect_list("id").alias("ids"))
        .join(r_reps.select("rrep", *IDENTITY), IDENTITY)
        .select("rrep", "ids")
    )
    dist = F.col("d") * F.col("d") / 2 if metric == "cosine" else F.col("d")
    options = (
        near.join(ids, "rrep")
        .select("lrep", dist.alias("distance"), F.explode("ids").alias("right_id"))
        .groupBy("lrep")
        .agg(F.array_sort(F.collect_list(F.struct("distance", "right_id"))).alias("opts"))
    )
    per_vector = options.join(l_reps.select("lrep", *IDENTITY), "lrep").select(*IDENTITY, "opts")
    rows = l_members.withColumnRenamed("id", "left_id").join(per_vector, IDENTITY)
    opts = F.col("opts")
    if exclude_self:
        opts = F.filter(opts, lambda o: ~o["right_id"].eqNullSafe(F.col("left_id")))
    return rows.select("left_id", F.posexplode(F.slice(opts, 1, k)).alias("rank", "o")).select(
        "left_id", "o.right_id", "o.distance", (F.col("rank") + 1).alias("rank")
    )


def knn_graph(df: DataFrame, k: int, metric: str = "euclidean", key: str = "row_id", vec: str = "features", **tiling) -> DataFrame:
    """Symmetric neighbour graph (src, dst, distance): an edge where either end
    has the other among its k nearest."""
    near = knn_join(df, df, k, metric, key, key, vec, exclude_self=True, **tiling)
    e = near.select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"), "distance")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance"))
    return both.groupBy("src", "dst").agg(F.min("distance").alias("distance"))


def rbf_affinity(df: DataFrame, gamma: float, k: int, key: str = "row_id", vec: str = "features", **tiling) -> DataFrame:
    """exp(-gamma d^2) on the edges of the symmetric k-neighbour graph."""
    g = knn_graph(df, k, "euclidean", key, vec, **tiling)
    return g.select("src", "dst", F.exp(-F.lit(float(gamma)) * F.col("distance") * F.col("distance")).alias("w"))


def rbf_class_sums(
    new: DataFrame,
    train: DataFrame,
    gamma: float | Sequence[float],
    label: str,
    n_classes: int,
    key: str = "row_id",
    vec: str = "features",
    **tiling,
) -> DataFrame:
    """(id, sums): per class the sum of exp(-gamma d^2) over all train rows.

    ``label`` is a class index or an array of class shares. Of several ``gamma`` the
    sums follow one another; they share the distances. Rows farther than
    sqrt(745 / gamma) weigh exactly zero in double precision, so skipping them
    changes nothing.
    """
    gammas = [float(g) for g in (gamma if isinstance(gamma, Sequence) else [gamma])]
    width = len(gammas) * n_classes
    l_reps, l_members = collapse_copies(_ready(new, key, vec, "euclidean", "id"), "id", "__v")
    soft = isinstance(train.schema[label].dataType, T.ArrayType)
    t = train.select(F.col(key).alias("id"), as_doubles(vec).alias("__v"), F.col(label).alias("__y"))
    share = [F.col("__y")[c] if soft else (F.col("__y") == c).cast("double") for c in range(n_classes)]
    votes = F.array(*[F.coalesce(F.sum(s), F.lit(0.0)) for s in share]).alias("y")
    r_reps, _ = collapse_copies(t, "id", "__v", extra=[votes])
    l_reps = materialize(l_reps.select(F.col("rep").alias("lrep"), "__v", *IDENTITY), "rbfleft")
    r_reps = materialize(r_reps.select(F.col("rep").alias("rrep"), "__v", "y"), "rbfright")
    kind = l_reps.schema["lrep"].dataType.simpleString()

    def kernel(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if not len(lp) or not len(rp):
            return pd.DataFrame({"lrep": [], "s": []})
        x, y, labels = _matrix(lp["__v"]), _matrix(rp["__v"]), _matrix(rp["y"])
        out = np.zeros((len(x), width))
        for a, b, sq in square_tiles(x, y):
            here, held = labels[b : b + sq.shape[1]], np.empty_like(sq)
            for i, g in enumerate(gammas):
                np.exp(np.multiply(sq, -g, out=held), out=held)
                out[a : a + len(sq), i * n_classes : (i + 1) * n_classes] += held @ here
        return pd.DataFrame({"lrep": lp["lrep"], "s": list(out)})

    tiles = tile_join(
        l_reps.drop(*IDENTITY), r_reps, kernel, f"lrep {kind}, s array<double>", "lrep", "rrep", "__v",
        radius=float(np.sqrt(745.0 / min(gammas))), **tiling,
    )
    sums = tiles.groupBy("lrep").agg(F.array(*[F.sum(F.col("s")[c]) for c in range(width)]).alias("sums"))
    per_vector = sums.join(l_reps.select("lrep", *IDENTITY), "lrep").select(*IDENTITY, "sums")
    none = F.array(*[F.lit(0.0)] * width)
    return l_members.join(per_vector, IDENTITY, "left").select("id", F.coalesce("sums", none).alias("sums"))


def cluster_distance_sums(df: DataFrame, cluster: str, key: str = "row_id", vec: str = "features", **tiling) -> DataFrame:
    """(id, cluster, total, n): per row the sum of Euclidean distances to the
    rows of every cluster. All block pairs are visited; copies are collapsed per
    cluster and nothing but the sums leaves a task."""
    rows = df.select(F.col(key).alias("id"), as_doubles(vec).alias("__v"), F.col(cluster).alias("__c"))
    l_reps, l_members = collapse_copies(rows, "id", "__v")
    r_reps, _ = collapse_copies(rows, "id", "__v", ["__c"])
    l_reps = materialize(l_reps.select(F.col("rep").alias("lrep"), "__v", *IDENTITY), "silleft")
    r_reps = materialize(r_reps.select(F.col("rep").alias("rrep"), "__c", "__v", "copies"), "silright")
    kind, ckind = (l_reps.schema["lrep"].dataType.simpleString(), r_reps.schema["__c"].dataType.simpleString())

    def kernel(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if not len(lp) or not len(rp):
            return pd.DataFrame({"lrep": [], "__c": [], "s": [], "m": []})
        x, y, w = _matrix(lp["__v"]), _matrix(rp["__v"]), rp["copies"].to_numpy(dtype=np.float64)
        code, names = pd.factorize(rp["__c"])
        onehot = np.zeros((len(y), len(names)))
        onehot[np.arange(len(y)), code] = w
        sums = np.zeros((len(x), len(names)))
        for a, b, sq in square_tiles(x, y):
            sums[a : a + len(sq)] += np.sqrt(sq, out=sq) @ onehot[b : b + sq.shape[1]]
        n = len(names)
        return pd.DataFrame(
            {
                "lrep": np.repeat(lp["lrep"].to_numpy(), n),
                "__c": np.tile(np.asarray(names), len(x)),
                "s": sums.ravel(),
                "m": np.tile(onehot.sum(0), len(x)),
            }
        )

    tiles = tile_join(
        l_reps.drop(*IDENTITY), r_reps, kernel, f"lrep {kind}, __c {ckind}, s double, m double", "lrep", "rrep", "__v", **tiling
    )
    sums = tiles.groupBy("lrep", "__c").agg(F.sum("s").alias("total"), F.sum("m").alias("n"))
    per_vector = sums.join(l_reps.select("lrep", *IDENTITY), "lrep").drop("lrep")
    return l_members.join(per_vector, IDENTITY).select("id", F.col("__c").alias("cluster"), "total", F.col("n").cast("bigint").alias("n"))
