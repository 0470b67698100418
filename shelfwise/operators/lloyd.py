"""Many k-means at once: every number of clusters and every start in one scan.

The centroid tables of all fits advance together. A task folds its rows into one
(sums, counts, cost) per fit; these are added by shuffle, so a round costs one
reading of the rows however many fits there are. Of a large table a task only sums
the rows that have changed their centroid since a written round. Seeding is shared as well: the
starts oversample candidates in the same scans, weighted by the rows nearest to
them, and every number of clusters picks its first centroids from the candidates
of its start. Fits that no longer move leave the rounds.

The driver holds the centroids, (sum of k) x starts x width numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import materialize, release

CELLS = 1 << 22
SEED_ROUNDS = 2
OVERSAMPLING = 2
TASKS_PER_SUM = 64
#: rows that meet the fits at a time, bytes of them, and centroids of one product, few
#: enough for the cache; rows of sums a task returns
FOLD_ROWS = 1 << 12
FOLD_BYTES = 1 << 21
FOLD_WIDTH = 1 << 7
SLABS = 32
#: blocks of a file
FILE_BLOCKS = 16
#: distances of a round from which on nearest centroids are written, and of a task at
#: least; the share of rows, added up over the rounds since, that may have changed before
#: nearest centroids are written anew
REFER_CELLS = 1 << 26
TASK_CELLS = 1 << 23
REFER_SHARE = 0.8
_SUMS = "slab int, sums binary, counts binary, cost binary"
_BLOCK, _REFERRED = "x binary", "x binary, near binary"


@dataclass
class Fit:
    """The best start for one k: centers (k x width), its cost and the costs of all starts."""

    k: int
    centers: np.ndarray
    cost: float
    costs: list[float]

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802  as the ML model has it
        return list(self.centers)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * (x @ c.T), 0.0)


def _chunks(frames: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, matrix) of as many rows as make at most ``CELLS`` distances to ``width`` centroids."""
    step = max(1, CELLS // max(1, width))
    for pdf in frames:
        for a in range(0, len(pdf), step):
            part = pdf.iloc[a : a + step]
            yield part["h"].to_numpy(), np.stack(part["v"].to_numpy()).astype(np.float64)


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of rows, each one binary."""
    for pdf in frames:
        step = len(pdf) and max(1, min(FOLD_ROWS, FOLD_BYTES // (8 * max(1, len(pdf["v"].iloc[0])))))
        for a in range(0, len(pdf), max(1, step)):
            yield pd.DataFrame({"x": [np.stack(pdf["v"].iloc[a : a + step].to_numpy()).astype(np.float64).tobytes()]})


def _matrices(frames: Iterator[pd.DataFrame], tables: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Rows, packed or not, as matrices of few enough rows for all tables."""
    widest = max(CELLS // FOLD_ROWS, *(len(c) for c in tables))
    for pdf in frames:
        if "x" not in pdf:
            yield from (x for _, x in _chunks(iter([pdf]), widest))
            continue
        for x in pdf["x"]:
            whole, step = np.frombuffer(x).reshape(-1, tables[0].shape[1]), max(1, CELLS // widest)
            yield from (whole[a : a + step] for a in range(0, len(whole), step))


def _slabs(n: int) -> list[np.ndarray]:
    """Slots dealt into a few runs, whose sums travel as one row."""
    return np.array_split(np.arange(n), min(n, SLABS))


def _nearest(tables: list[np.ndarray]) -> Callable[[np.ndarray], Iterator[tuple[int, np.ndarray]]]:
    """Rows -> (slot, nearest centroid of each row), slot by slot.

    Distances are single precision products of a few slots at a time, about the mean
    centroid. A row is settled if its least is below all others by more than their
    error; the other rows are met again in double precision, so the result is that of
    double precision.
    """
    width, shift = tables[0].shape[1], np.concatenate(tables).mean(0)
    # squared distance less the row's own square, in one product with (row, 1)
    with_square = lambda c: np.hstack([-2.0 * c, (c * c).sum(1)[:, None]])
    groups: list[list[int]] = []
    for s, c in enumerate(tables):
        if not groups or sum(len(tables[i]) for i in groups[-1]) + len(c) > FOLD_WIDTH:
            groups.append([])
        groups[-1].append(s)
    stacked = [np.concatenate([tables[s] for s in slots]) - shift for slots in groups]
    factors = [with_square(c).astype(np.float32) for c in stacked]
    radii = [np.sqrt((c * c).sum(1).max()) for c in stacked]
    places = [np.arange(len(c), dtype=np.float32) for c in tables]

    def run(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        moved, at = x - shift, np.arange(len(x))
        rows = np.vstack([moved.T, np.ones(len(x))]).astype(np.float32)
        reach = np.sqrt((moved * moved).sum(1))
        for slots, factor, radius in zip(groups, factors, radii, strict=True):
            d = factor @ rows
            slack = (2 * (width + 4) * 2.0**-24 * (reach + radius) ** 2).astype(np.float32)
            a = 0
            for s in slots:
                own = d[a : a + len(tables[s])]
                a += len(own)
                least = own.min(0)
                # of equal ones the sum of places is none of theirs, but they are met again
                near = np.minimum(places[s] @ (own == least).astype(np.float32), len(own) - 1).astype(np.intp)
                own[near, at] = np.inf
                if len(own) > 1 and len(odd := np.flatnonzero(~(own.min(0) > least + slack))):
                    near[odd] = (np.hstack([x[odd], np.ones((len(odd), 1))]) @ with_square(tables[s]).T).argmin(1)
                yield s, near

    return run


def _edges(tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(c) for c in tables])
    return ends - [len(c) for c in tables], ends


def _returned(tables: list[np.ndarray], sums: np.ndarray, counts: np.ndarray, cost: np.ndarray) -> pd.DataFrame:
    found, (heads, ends) = [], _edges(tables)
    for i, slots in enumerate(_slabs(len(tables))):
        a, b = heads[slots[0]], ends[slots[-1]]
        found.append((i, sums[a:b].tobytes(), counts[a:b].tobytes(), cost[slots].tobytes()))
    return pd.DataFrame(found, columns=["slab", "sums", "counts", "cost"])


def _fold(tables: list[np.ndarray], priced: bool = True) -> Callable:
    """Per slab of slots: sums and counts of the rows nearest to each centroid, and,
    if ``priced``, the costs (else 0)."""
    heads, ends = _edges(tables)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts, cost = np.zeros((ends[-1], tables[0].shape[1])), np.zeros(ends[-1]), np.zeros(len(tables))
        nearest = _nearest(tables)
        for x in _matrices(frames, tables):
            ones, by_place = np.ones(len(x)), np.empty_like(x)
            for s, near in nearest(x):
                n = np.bincount(near, minlength=len(tables[s]))
                order = np.argsort(near.astype(np.min_scalar_type(len(n))), kind="stable")
                np.take(x, order, axis=0, out=by_place, mode="clip")
                stops = np.cumsum(n)
                for j in np.flatnonzero(n):
                    sums[heads[s] + j] += ones[: n[j]] @ by_place[stops[j] - n[j] : stops[j]]
                counts[heads[s] : ends[s]] += n
                if priced:
                    gap = x - tables[s][near]
                    cost[s] += np.einsum("ij,ij->", gap, gap)
        if counts.any():
            yield _returned(tables, sums, counts, cost)

    return run


def _refer(tables: list[np.ndarray]) -> Callable:
    """Blocks with the nearest centroid of each row in every slot."""
    small, width = np.min_scalar_type(max(len(c) for c in tables) - 1), tables[0].shape[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nearest = _nearest(tables)
        for pdf in frames:
            for block in pdf["x"]:
                x = np.frombuffer(block).reshape(-1, width)
                near = np.empty((len(tables), len(x)), small)
                for s, own in nearest(x):
                    near[s] = own
                yield pd.DataFrame({"x": [block], "near": [near.tobytes()]})

    return run


def _drift(tables: list[np.ndarray], places: list[int], small: np.dtype) -> Callable:
    """What :func:`_fold` returns, less that of the written round: sums and counts of the
    rows that have another centroid than written, and, as cost, their number. ``places``:
    where each slot was in that round; ``small``: the type of its numbers."""
    heads, ends = _edges(tables)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts, moved = np.zeros((ends[-1], tables[0].shape[1])), np.zeros(ends[-1]), np.zeros(len(tables))
        nearest, seen = _nearest(tables), False
        for pdf in frames:
            for block, written in zip(pdf["x"], pdf["near"], strict=True):
                x, seen = np.frombuffer(block).reshape(-1, tables[0].shape[1]), True
                before = np.frombuffer(written, small).reshape(-1, len(x))
                for s, near in nearest(x):
                    old = before[places[s]]
                    if not len(rows := np.flatnonzero(near != old)):
                        continue
                    move, at = np.zeros((len(tables[s]), len(rows))), np.arange(len(rows))
                    move[near[rows], at] = 1.0
                    move[old[rows], at] = -1.0
                    sums[heads[s] : ends[s]] += move @ x[rows]
                    counts[heads[s] : ends[s]] += move.sum(1)
                    moved[s] += len(rows)
        if seen:
            yield _returned(tables, sums, counts, moved)

    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = lambda c: np.sum([np.frombuffer(x) for x in pdf[c]], axis=0).tobytes()
    return pd.DataFrame({"slab": [pdf["slab"].iloc[0]]} | {c: [total(c)] for c in ("sums", "counts", "cost")})


def _tasks(df: DataFrame) -> int:
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def _pass(
    points: DataFrame, tables: list[np.ndarray], fold: Callable | None = None, tasks: int = 0
) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """slot -> (sums, counts, cost) over all rows; ``tasks``: of ``points``, if known."""
    some = points.mapInPandas(fold or _fold(tables), _SUMS)
    if not 0 < tasks <= TASKS_PER_SUM:
        part = F.floor(F.spark_partition_id() / TASKS_PER_SUM).alias("part")
        some = some.select("*", part).groupBy("slab", "part").applyInPandas(_add, _SUMS)
    rows = {r["slab"]: r for r in some.groupBy("slab").applyInPandas(_add, _SUMS).collect()}
    out, width = {}, tables[0].shape[1]
    for i, slots in enumerate(_slabs(len(tables))):
        sums = np.frombuffer(rows[i]["sums"]).reshape(-1, width)
        counts, cost = np.frombuffer(rows[i]["counts"]), np.frombuffer(rows[i]["cost"])
        cuts = np.cumsum([len(tables[s]) for s in slots])[:-1]
        parts = zip(slots, np.split(sums, cuts), np.split(counts, cuts), cost, strict=True)
        out |= {int(s): (a, n, float(c)) for s, a, n, c in parts}
    return out


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit hashes."""
    x = h.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


def _draw(tables: list[np.ndarray], costs: list[float], wanted: int, salt: int) -> Callable:
    """(start, row) of rows drawn with a chance in proportion to their cost."""
    ends = np.cumsum([len(c) for c in tables])
    stacked = np.concatenate(tables)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for h, x in _chunks(frames, len(stacked)):
            d = _squares(x, stacked)
            out = []
            for s, b in enumerate(ends):
                near = d[:, b - len(tables[s]) : b].min(1)
                hit = np.flatnonzero(_mix(h, salt + s) * costs[s] < wanted * near)
                out += [(s, x[i].tolist()) for i in hit]
            if out:
                yield pd.DataFrame(out, columns=["slot", "v"])

    return run


def _seeds(points: DataFrame, most: int, n_init: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per start: candidates (about 2 x ``SEED_ROUNDS`` x the largest k) and their weights."""
    first = points.agg(*[F.min_by("v", F.xxhash64(F.lit(seed + s), "h")).alias(f"s{s}") for s in range(n_init)]).first()
    tables = [np.array([first[s]]) for s in range(n_init)]
    for r in range(SEED_ROUNDS):
        found = _pass(points, tables)
        costs = [found[s][2] for s in range(n_init)]
        salt = (seed * SEED_ROUNDS + r) * n_init
        drawn = points.mapInPandas(_draw(tables, costs, OVERSAMPLING * most, salt), "slot int, v array<double>").collect()
        for s in range(n_init):
            new = sorted(r["v"] for r in drawn if r["slot"] == s)
            tables[s] = np.unique(np.concatenate([tables[s], np.array(new).reshape(-1, tables[s].shape[1])]), axis=0)
    found = _pass(points, tables)
    return [(tables[s], found[s][1]) for s in range(n_init)]


def _spread(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """At most k of the candidates, each drawn by weight times squared distance to those before."""
    chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    d = _squares(candidates, candidates[chosen])[:, 0]
    while len(chosen) < k and (mass := weights * d).sum() > 0:
        chosen.append(int(rng.choice(len(candidates), p=mass / mass.sum())))
        d = np.minimum(d, _squares(candidates, candidates[chosen[-1:]])[:, 0])
    return candidates[chosen]


def lloyd(points: DataFrame, tables: list[np.ndarray], max_iter: int, tol: float) -> tuple[list[np.ndarray], list[float]]:
    """All tables moved until none of their centroids moves more than ``tol``,
    with their costs. A centroid without rows stays where it is.

    From ``REFER_CELLS`` distances on, the centroids nearest in some round are written
    beside the rows; the sums of later rounds are that round's and what has changed since.
    """
    tables, live = list(tables), list(range(len(tables)))
    cells = points.count() * sum(len(c) for c in tables)
    slots = min(points.sparkSession.sparkContext.defaultParallelism, max(1, cells // TASK_CELLS))
    rows = points.select("v")
    if slots == 1:
        rows = rows.coalesce(1)
    elif _tasks(points) < slots or cells < REFER_CELLS:
        rows = rows.repartition(slots)
    # few tasks, as each returns sums of all fits
    blocks = materialize(rows.mapInPandas(_pack, _BLOCK), "blocks", FILE_BLOCKS).coalesce(slots)
    tasks, written, before, debt = _tasks(blocks), None, {}, np.inf
    for _ in range(max_iter):
        if not live:
            break
        now = [tables[i] for i in live]
        if written is None:
            found = _pass(blocks, now, _fold(now, priced=False), tasks)
        else:
            found = _pass(written, now, _drift(now, [before[i][0] for i in live], small), written_tasks)
            debt += sum(n for _, _, n in found.values()) / sum(before[i][2].sum() for i in live)
            found = {s: (before[i][1] + found[s][0], before[i][2] + found[s][1], 0.0) for s, i in enumerate(live)}
        still = []
        for slot, i in enumerate(live):
            sums, counts, _ = found[slot]
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], tables[i])
            if np.sqrt(((new - tables[i]) ** 2).sum(1)).max() > tol:
                still.append(i)
            tables[i] = new
        if still and debt > REFER_SHARE and cells >= REFER_CELLS:
            fresh = materialize(blocks.mapInPandas(_refer(now), _REFERRED), "nearest", FILE_BLOCKS).coalesce(slots)
            if written is not None:
                release(written)
            written, written_tasks, debt = fresh, _tasks(fresh), 0.0
            small = np.min_scalar_type(max(len(c) for c in now) - 1)
            before = {i: (s, found[s][0], found[s][1]) for s, i in enumerate(live)}
        live = still
    found = _pass(blocks, tables, tasks=tasks)
    for table in (blocks, written):
        if table is not None:
            release(table)
    return tables, [found[i][2] for i in range(len(tables))]


def kmeans_many(
    df: DataFrame, ks: Sequence[int], n_init: int = 10, seed: int = 42, vec: str = "features", max_iter: int = 100, tol: float = 1e-4
) -> list[Fit]:
    """One fit per entry of ``ks``, each the best of ``n_init`` starts.

    Rows without a vector are left out. With fewer distinct rows than clusters a
    fit has fewer centroids; an empty table has none.
    """
    v = F.col(vec).cast("array<double>")
    points = materialize(df.filter(F.col(vec).isNotNull()).select(F.xxhash64(v).alias("h"), v.alias("v")), "points")
    wanted = sorted(set(ks))
    if points.isEmpty():
        return [Fit(k, np.zeros((0, 0)), 0.0, []) for k in ks]
    seeds = _seeds(points, max(wanted), n_init, seed)
    start = [
        _spread(*seeds[s], k, np.random.default_rng([seed, s, k])) for k in wanted for s in range(n_init)
    ]
    tables, costs = lloyd(points, start, max_iter, tol)
    best = {}
    for at, k in enumerate(wanted):
        own = costs[at * n_init : (at + 1) * n_init]
        i = int(np.argmin(own))
        best[k] = Fit(k, tables[at * n_init + i], own[i], own)
    return [best[k] for k in ks]


def assign_many(df: DataFrame, fits: Sequence[Fit], key: str = "row_id", vec: str = "features") -> DataFrame:
    """(key, clusters): the nearest centroid of every fit, in their order; one map-side pass."""
    tables = [f.centers for f in fits]
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nearest = _nearest(tables)
        for pdf in frames:
            near = np.empty((len(pdf), len(tables)), np.int32)
            for a in range(0, len(pdf), FOLD_ROWS):
                for s, own in nearest(np.stack(pdf["v"].iloc[a : a + FOLD_ROWS].to_numpy()).astype(np.float64)):
                    near[a : a + len(own), s] = own
            yield pd.DataFrame({key: pdf[key], "clusters": list(near)})

    rows = df.filter(F.col(vec).isNotNull()).select(key, F.col(vec).cast("array<double>").alias("v"))
    return rows.mapInPandas(run, f"{key} {kind}, clusters array<int>")
