"""Seeded, engine-independent randomness derived from md5 of a row key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(key: Column | str, seed: int | str) -> Column:
    """A hex string whose order is a reproducible shuffle of the keys."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def hash_int(key: Column | str, seed: int | str) -> Column:
    """A reproducible integer in [0, 2^60), wide enough to pick among all rows."""
    return F.conv(F.substring(hash_order(key, seed), 1, 15), 16, 10).cast("bigint")


def hash_uniform(key: Column | str, seed: int | str) -> Column:
    """A reproducible double in [0, 1) with 53 random bits."""
    return F.shiftright(hash_int(key, seed), 7) / F.lit(9007199254740992.0)
