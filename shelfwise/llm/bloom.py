"""Bloom filters built in slices, where each slice is made by one task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x.astype(np.uint64, copy=True)
    for m in (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)):
        x ^= x >> np.uint64(31)
        x *= m
    return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class Slices:
    """Bit slices of their own sizes; a key belongs to one slice."""

    bits: np.ndarray  # bytes of all slices
    start: np.ndarray  # first byte of each slice
    size: np.ndarray  # bits of each slice
    hashes: np.ndarray  # probes of each slice
    top: int = 0  # highest level of a counting filter

    def plain(self) -> tuple:
        """The fields, to be broadcast: workers need not import this class."""
        return self.bits, self.start, self.size, self.hashes, self.top

    def holds(self, keys: np.ndarray, part: np.ndarray | None = None) -> np.ndarray:
        """Membership of uint64 keys (in slice ``part``): never false for a member."""
        keys = keys.astype(np.uint64, copy=False)
        if not len(self.size):
            return np.zeros(len(keys), bool)
        if part is None:
            part = (keys % np.uint64(len(self.size))).astype(np.int64)
        at, size = self.start[part], self.size[part].astype(np.uint64)
        out = size > 0
        size = np.maximum(size, np.uint64(1))
        few = self.hashes[part]
        for i, p in enumerate(probes(keys, size, int(few.max()) if len(few) else 0)):
            byte = np.minimum(at + (p >> np.uint64(3)).astype(np.int64), max(0, len(self.bits) - 1))
            if len(self.bits):
                out &= ((self.bits[byte] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0) | (few <= i)
        return out


def probes(keys: np.ndarray, size, hashes: int):
    """Bit positions of keys in a slice of ``size`` bits, one array per hash."""
    a, b = mix64(keys), mix64(keys ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for i in range(hashes):
        yield (a + np.uint64(i) * b) % size


def fill(keys: np.ndarray, bits: int, hashes: int) -> bytes:
    out = np.zeros(bits, np.uint8)
    for p in probes(keys.astype(np.uint64), np.uint64(bits), hashes):
        out[p.astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def best_hashes(entries: int, bits: int, most: int = 6) -> int:
    """Probes that keep false positives low for so many bits per entry."""
    return int(np.clip(round(0.693 * bits / max(1, entries)), 1, most))


def assemble(rows: list, slices: int) -> Slices:
    """From rows with slice, size, hashes and bits (and top)."""
    parts = {r["slice"]: r for r in rows}
    size = np.array([parts[i]["size"] if i in parts else 0 for i in range(slices)], np.int64)
    blobs = [bytes(parts[i]["bits"]) if i in parts else b"" for i in range(slices)]
    start = np.cumsum([0, *map(len, blobs)])[:-1]
    hashes = np.array([parts[i]["hashes"] if i in parts else 1 for i in range(slices)], np.int64)
    top = max((r.get("top", 0) for r in rows), default=0)
    return Slices(np.frombuffer(b"".join(blobs), np.uint8), start, size, hashes, top)


def of_longs(keys: DataFrame, slices: int = 64, max_bytes: int = 32 << 20, bits_per_key: int = 12) -> Slices:
    """The filter of the single long column of ``keys``.

    It grows with the keys up to ``max_bytes`` in all, which bounds what is
    broadcast; beyond that more non-members pass, members always do.
    """
    most = max_bytes * 8 // slices

    def one(df: pd.DataFrame) -> pd.DataFrame:
        own = df["key"].to_numpy().view(np.uint64)
        bits = min(most, -(-len(own) * bits_per_key // 64) * 64)
        k = best_hashes(len(own), bits)
        part = int(own[0] % np.uint64(slices))
        return pd.DataFrame({"slice": [part], "size": [bits], "hashes": [k], "bits": [fill(own, bits, k)]})

    named = keys.toDF("key").where("key is not null").distinct()
    # pmod of the unsigned value: high and low half apart
    high = F.shiftrightunsigned("key", 32) * (2**32 % slices)
    low = F.col("key").bitwiseAND(F.lit(2**32 - 1))
    rows = named.groupBy(((high + low) % slices).alias("s")).applyInPandas(
        one, "slice long, size long, hashes long, bits binary"
    )
    return assemble([r.asDict() for r in rows.collect()], slices)
