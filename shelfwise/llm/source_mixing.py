"""Mixing sources to target weights by exact block quotas.

Each source is laid out in a hashed order and cut into blocks of about equal
words. A target becomes an exact number of blocks of the source; the quotas of
all sources are split over the output shards by a tree of multivariate
hypergeometric draws, every shard then takes its next blocks of a random
permutation, so shards are disjoint, and shuffles its documents locally.

Only one row per source and at most ``max_blocks`` block rows (about equal
parts of each source, whatever its size) come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.quality_rules import GAP, WHITE
from shelfwise.llm.rows import fresh, with_row
from shelfwise.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2.0
DOCS_PER_BLOCK = 16
MAX_BLOCKS = 1 << 16
DOCS_PER_SLICE = 256
MAX_SLICE_BITS = 16
PLAN_SCHEMA = "source string, block long, part double, draws array<struct<pass:int,shard:int>>"


@dataclass(frozen=True)
class Source:
    name: str | None
    docs: int
    words: int


def targets(
    sources: list[Source], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: float = MAX_REPEAT
) -> dict[str | None, float]:
    """Words to take of each source: weights in code point order (null last),
    at most ``repeat`` times a source; what is cut off is shared again by weight."""
    order = sorted(sources, key=lambda s: (s.name is None, s.name or ""))
    w = {s.name: weights[i % len(weights)] for i, s in enumerate(order)}
    left = share * sum(s.words for s in order)
    done: dict[str | None, float] = {}
    open_ = list(order)
    while open_:
        unit = left / sum(w[s.name] for s in open_)
        full = [s for s in open_ if w[s.name] * unit >= repeat * s.words]
        if not full:
            return done | {s.name: w[s.name] * unit for s in open_}
        for s in full:
            done[s.name] = repeat * s.words
            left -= done[s.name]
        open_ = [s for s in open_ if s.name not in done]
        left = max(left, 0.0)
    return done


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shard, source) block counts: each node of a binary tree draws its left
    half from what it holds, so columns add up to ``quotas`` exactly."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def down(lo: int, hi: int, held: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = held
            return
        mid = (lo + hi) // 2
        n = int(held.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(held, n, method="marginals")
        down(lo, mid, left)
        down(mid, hi, held - left)

    down(0, shards, quotas.astype(np.int64))
    return out


def plan_blocks(sizes: dict[str | None, np.ndarray], goal: dict[str | None, float], shards: int, seed: int) -> list[tuple]:
    """(source, block, part, draws) of every drawn block.

    ``sizes`` holds the words of each source's blocks. Whole passes take every
    block once; the last pass takes the permuted blocks that fit and ``part`` of
    the words of the next, so that the sum meets the target.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    drawn, parts = {}, {}
    for i, s in enumerate(names):
        words, rng = sizes[s], np.random.default_rng([seed, i])
        total = int(words.sum())
        passes = int(goal[s] // total) if total else 0
        seq = [(p, int(b)) for p in range(passes) for b in rng.permutation(len(words))]
        rest = goal[s] - passes * total
        if total and rest >= 1:
            perm = rng.permutation(len(words))
            upto = np.cumsum(words[perm])
            whole = int(np.searchsorted(upto, rest, side="right"))
            seq += [(passes, int(b)) for b in perm[:whole]]
            if whole < len(perm):
                seq.append((passes, int(perm[whole])))
                parts[s, int(perm[whole])] = float(rest - (upto[whole - 1] if whole else 0))
        drawn[s] = seq
    quotas = split_quotas(np.array([len(drawn[s]) for s in names]), shards, seed)
    rows: dict[tuple, list] = {}
    for i, s in enumerate(names):
        shard = np.repeat(np.arange(shards), quotas[:, i])
        for (p, b), where in zip(drawn[s], shard, strict=True):
            rows.setdefault((s, b), []).append((p, int(where)))
    return [(s, b, parts.get((s, b)), draws) for (s, b), draws in rows.items()]


def place(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, order_col: str | None = None
) -> DataFrame:
    """Written table: _id, source, size, and the hash of order_col (default: the id) and text that orders a source."""
    t = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(WHITE))
    size = F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, GAP))).cast("long")
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("source"),
        size.alias("size"),
        F.xxhash64(F.lit(seed), F.col(order_col or id_col), F.col(text_col)).alias("h"),
    )
    return materialize(rows, "mix-sizes")


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 64,
    seed: int = 7, max_blocks: int = MAX_BLOCKS, order_col: str | None = None,
) -> DataFrame:
    """One row per input row: _id, source, size, source_size, target, draws.

    ``draws`` lists (pass, shard) for each time the document is taken. The order
    within a source hangs on ``order_col`` (default: the id) and the text alone,
    not on how the rows are spread, so reruns agree.

    Defined cases: a null or empty text has size 0 and is drawn like any other,
    to no effect on the words taken; a null source is a source of its own, last
    in the order; ids may be null or repeat (each row is placed by itself, equal
    rows are interchangeable); no words at all: targets are 0 and nothing is
    drawn; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = place(docs, id_col, text_col, source_col, seed, order_col)
    by_source = rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("words"))
    totals = [Source(r.source, r.docs, r.words) for r in by_source.collect()]
    goal = targets(totals)
    per_block = max(DOCS_PER_BLOCK, math.ceil(sum(s.docs for s in totals) / max_blocks))
    n_blocks = {s.name: max(1, s.docs // per_block) for s in totals}
    most = max((s.docs for s in totals), default=1)
    bits = min(MAX_SLICE_BITS, max(1, math.ceil(math.log2(max(2, most / DOCS_PER_SLICE)))))
    facts = spark.createDataFrame(
        [(s.name, s.words, float(goal[s.name]), n_blocks[s.name]) for s in totals],
        "source string, source_size long, target double, blocks long",
    )
    # position of a document among the words of its source: slice offsets, then a window inside the slice
    rows = rows.withColumn("slice", F.shiftrightunsigned("h", 64 - bits))
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_words"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        F.col("source").alias("s"), F.col("slice").alias("k"),
        F.coalesce(F.sum("slice_words").over(before), F.lit(0)).alias("offset"),
    )
    inside = Window.partitionBy("source", "slice").orderBy("h", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("begin", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(slices, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k"))).drop("s", "k")
    f = facts.withColumnRenamed("source", "s")
    placed = placed.join(f, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    at = F.col("begin") + F.col("offset")
    share = F.floor(at.cast("double") * F.col("blocks") / F.greatest("source_size", F.lit(1))).cast("long")
    placed = placed.withColumn("block", F.least(share, F.col("blocks") - 1)).withColumn("at", at)
    placed = materialize(
        placed.select("_id", "source", "size", "h", "source_size", "target", "block", "at"), "mix-placed"
    )
    blocks = placed.groupBy("source", "block").agg(F.sum("size").alias("words"), F.min("at").alias("first"))
    held: dict[str | None, np.ndarray] = {s: np.zeros(n, np.int64) for s, n in n_blocks.items()}
    first: dict[tuple, int] = {}
    for r in blocks.collect():
        held[r.source][r.block] = r.words
        first[r.source, r.block] = r.first
    plan = [
        (s, b, None if part is None else part + first.get((s, b), 0), draws)
        for s, b, part, draws in plan_blocks(held, goal, shards, seed)
    ]
    drawn = spark.createDataFrame(plan, PLAN_SCHEMA)
    drawn = drawn.withColumnsRenamed({"source": "s", "block": "k"})
    joined = placed.join(drawn, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k")), "left")
    # of a block taken in part, the last pass takes the documents whose middle lies before the cut
    last = F.array_max(F.transform("draws", lambda d: d["pass"]))
    out = F.col("part").isNotNull() & (F.col("at") + F.col("size") / 2 > F.col("part"))
    used = F.filter("draws", lambda d: ~(out & (d["pass"] == last)))
    none = F.array().cast("array<struct<pass:int,shard:int>>")
    return joined.select(
        "_id", "source", "size", "h", "source_size", "target", F.coalesce(used, none).alias("draws")
    )


def mix(docs: DataFrame, shards: int = 64, seed: int = 7, id_col: str = "doc_id", **cols) -> DataFrame:
    """The mixed corpus: rows of ``docs``, repeated as drawn, with shard and place.

    ``_shard`` is the output shard, ``_place`` a hash that orders it at random
    (with more underscores where ``docs`` has such columns). Rows are told apart
    for the join only; which are taken hangs on id and text.
    """
    numbered, row = with_row(docs)
    shard, place_ = fresh("_shard", docs.columns), fresh("_place", docs.columns)
    plan = mix_plan(numbered, id_col=row, order_col=id_col, shards=shards, seed=seed, **cols)
    taken = plan.select(F.col("_id").alias(row), "h", F.explode("draws").alias("d")).select(
        row, F.col("d.shard").alias(shard), spot(F.col("h"), F.col("d")).alias(place_)
    )
    return numbered.join(taken, row).drop(row)


def spot(h: Column, draw: Column) -> Column:
    """A hash that places one draw of a document in its shard."""
    return F.xxhash64(h, draw["pass"], draw["shard"])


def shuffled_shards(mixed: DataFrame) -> DataFrame:
    """``mixed`` with one task's rows per shard, in the order of the place."""
    shard, place_ = mixed.columns[-2:]
    return mixed.repartition(shard).sortWithinPartitions(shard, place_)
