"""Embedding near-duplicates by randomised-rotation binary codes.

Unit vectors are rotated at random; the signs of the rotated coordinates are
their code, and the inner product of the code with the vector itself is stored
as a correction factor. Code times rotated vector over that factor is an unbiased
estimate of the inner product, with an error that the factor bounds; only pairs
whose upper confidence bound reaches the threshold are computed exactly.

Pairs are met where short keys, cut from the signs of further rotations, agree in
one of several tables: their number follows from the number of vectors and the
recall wanted at the threshold, so work grows little faster than the input. A
pair that agrees in several tables is handled in the first. Equal vectors are one
class with a count; a crowded key is cut into parts that meet pair by pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.blocks import spread
from shelfwise.llm.components import components, forest
from shelfwise.session import materialize

THRESHOLD = 0.93
RECALL = 0.995
CONFIDENCE = 4.5
PART_ROWS = 4096
CHUNK_PAIRS = 1 << 15
PER_KEY = 4


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def code_bits(dim: int) -> int:
    """Code length: at least 128 bits, which halves the error at width 64."""
    return max(128, -(-dim // 64) * 64)


def plan_tables(vectors: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits per key, tables) so that a key holds few unrelated vectors and a
    pair at the threshold agrees in some table with the recall asked for; (0, 1)
    if it asks for every pair."""
    if recall >= 1:  # one key for all: every pair of a label is compared, part by part
        return 0, 1
    bits = min(62, max(6, math.ceil(math.log2(max(2, vectors / PER_KEY)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs (-1, 1), correction factors and rotated rows of unit vectors."""
    bits = code_bits(x.shape[1])
    turned = x @ rotation(bits, seed)[: x.shape[1]]
    signs = np.where(turned >= 0, 1.0, -1.0).astype(np.float32)
    factor = np.abs(turned).sum(axis=1) / math.sqrt(bits)
    return signs, factor, turned.astype(np.float32)


def estimate(signs, factor, turned) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of paired rows (code, factor) and (rotated), and
    the half width of their confidence interval."""
    bits = signs.shape[1]
    est = np.einsum("ij,ij->i", signs, turned) / math.sqrt(bits) / factor
    width = CONFIDENCE * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(bits - 1)
    return est, width


def table_keys(x: np.ndarray, bits: int, tables: int, seed: int = 1) -> np.ndarray:
    """(row, table) keys from the signs under further random rotations."""
    dim = x.shape[1]
    need = bits * tables
    if not need:
        return np.zeros((len(x), tables), np.int64)
    turns = [rotation(dim, seed + 1 + k) for k in range(-(-need // dim))]
    signs = (x @ np.concatenate(turns, axis=1)[:, :need] >= 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _clean(v):
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def links_in_keys(threshold: float, confidence: float = CONFIDENCE):
    """Counts of links and spanning links from rows sorted by key.

    Vectors of one length are compared at a time; keys hold the length, so no pair is cut apart.
    """
    names = ["label", "dim", "tab", "key", "i", "j"]

    def compare(df: pd.DataFrame, heads: np.ndarray) -> pd.DataFrame:
        x = unit(np.stack(df["vec"].to_numpy()))
        signs, factor, turned = encode(x)
        tab, part, c, node = (df[k].to_numpy() for k in ("tab", "part", "c", "node"))
        keys = np.stack(df["keys"].to_numpy())
        apart = (df["i"] != df["j"]).to_numpy()
        ends = np.repeat(np.r_[heads[1:], len(df)], np.diff(np.r_[heads, len(df)]))
        after = ends - np.arange(len(df)) - 1
        upto = np.cumsum(after)
        count, us, vs = np.zeros(len(df), np.int64), [], []
        lo = 0
        while lo < len(df):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CHUNK_PAIRS, side="right")))
            a = np.repeat(np.arange(lo, hi), after[lo:hi])
            b = spread(np.arange(lo, hi) + 1, after[lo:hi])
            lo = hi
            ok = ~apart[a] | (part[a] != part[b])
            a, b = a[ok], b[ok]
            est, width = estimate(signs[a], factor[a], turned[b])
            ok = est + width * (confidence / CONFIDENCE) >= threshold
            a, b = a[ok], b[ok]
            early = np.arange(keys.shape[1]) < tab[a][:, None]
            ok = ~((keys[a] == keys[b]) & early).any(axis=1)
            a, b = a[ok], b[ok]
            ok = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            a, b = a[ok], b[ok]
            np.add.at(count, a, c[b])
            np.add.at(count, b, c[a])
            if len(a):
                u, v = node[a], node[b]
                keep = forest(u, v)
                us.append(u[keep])
                vs.append(v[keep])
        hit = count > 0
        u, v = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (us, vs))
        keep = forest(u, v)
        a, b = int(hit.sum()), len(keep)
        none = lambda x, y: np.r_[np.full(a, x), np.full(b, y)]
        integers = lambda x, gone: pd.arrays.IntegerArray(x, gone)  # noqa: E731  64-bit ids never pass through floats
        return pd.DataFrame(
            {
                "node": np.r_[node[hit], u[keep]],
                "links": integers(np.r_[count[hit], np.zeros(b, np.int64)], none(False, True)),
                "other": integers(np.r_[np.zeros(a, np.int64), v[keep]], none(True, False)),
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            df = b if rest is None else pd.concat([rest, b], ignore_index=True)
            key = df[names].to_numpy(np.int64)
            heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            rest = df.iloc[heads[-1] :]
            if heads[-1]:
                yield from by_length(df.iloc[: heads[-1]], heads[:-1])
        if rest is not None and len(rest):
            yield compare(rest, np.zeros(1, np.int64))

    def by_length(df: pd.DataFrame, heads: np.ndarray) -> Iterator[pd.DataFrame]:
        dims = df["dim"].to_numpy()[heads]
        of_row = np.repeat(dims, np.diff(np.r_[heads, len(df)]))
        for d in np.unique(dims):
            rows = of_row == d
            first = np.zeros(len(df), bool)
            first[heads] = True
            yield compare(df[rows], np.flatnonzero(first[rows]))

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, recall: float = RECALL, part_rows: int = PART_ROWS,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    A pair with cosine at the threshold is met with probability ``recall`` (more
    above it) and then decided exactly; no pair below it links. ``recall=1``
    loses none: all pairs of a label are compared in blocks of ``part_rows``, and
    the estimate rules out none of them, so the work is quadratic in a label.

    Defined cases: a null label, and a null, empty or zero vector or one with
    null or non-finite components, links with nothing; vectors of different
    length never link; a null id is never the smallest unless a component has no
    other; repeated ids and equal vectors are rows that link with each other; an
    empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col(vec_col)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("vec"))
    usable = F.col("label").isNotNull() & _clean(F.col("vec"))
    key = [F.xxhash64(F.lit(s), "label", F.size("vec"), "vec") for s in (1, 2)]
    rows = rows.withColumns({"node": F.when(usable, key[0]), "node2": F.when(usable, key[1])})
    known = rows.where("node is not null").groupBy("node", "node2").agg(
        F.count("*").alias("c"), F.min("vec_id").alias("id"), F.first("label").alias("label"), F.first("vec").alias("vec")
    )
    known = known.withColumn("label", F.xxhash64("label")).withColumn("dim", F.size("vec"))
    classes = materialize(known, "vector-classes")
    most = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1
    bits, tables = plan_tables(most, threshold, recall)

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, df in b.groupby("dim"):
                yield df.assign(keys=list(table_keys(unit(np.stack(df["vec"].to_numpy())), bits, tables)))

    kept = ["label", "dim", "node", "c", "vec"]
    slim = classes.select(*kept)
    coded = slim.mapInPandas(spell, slim.withColumn("keys", F.lit(None).cast("array<long>")).schema)
    coded = materialize(coded, "vector-keys")
    spots = coded.select("label", "dim", F.posexplode("keys").alias("tab", "key"))
    crowded = spots.groupBy("label", "dim", "tab", "key").count().where(F.col("count") > 1)
    parts = F.ceil(F.col("count") / part_rows).cast("int")
    crowded = materialize(crowded.select("label", "dim", "tab", "key", parts.alias("parts")), "vector-crowded")
    met = coded.select("*", F.posexplode("keys").alias("tab", "key")).join(crowded, ["label", "dim", "tab", "key"])
    met = met.withColumn("part", F.pmod("node", "parts").cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda x: F.struct(F.least(x, F.col("part")).alias("i"), F.greatest(x, F.col("part")).alias("j")),
    )
    met = met.withColumn("ij", F.explode(pairs)).select(
        "label", "dim", "tab", "key", "ij.i", "ij.j", "part", "node", "c", "vec", "keys"
    )
    names = ["label", "dim", "tab", "key", "i", "j"]
    found = met.repartition(*names).sortWithinPartitions(*names).mapInPandas(
        links_in_keys(threshold, CONFIDENCE if recall < 1 else math.inf), "node long, links long, other long"
    )
    found = materialize(found, "vector-links")
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    known = classes.select("node", "c", "id").join(links, "node", "left").join(roots, "node", "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    known = materialize(known, "vector-known")
    least = known.groupBy("root").agg(F.min("id").alias("component_id"))
    known = known.join(least, "root").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("n_links"), "component_id"
    )
    out = rows.select("vec_id", "node").join(known, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
