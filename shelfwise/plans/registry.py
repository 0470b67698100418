"""Registry of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with an optional SQL twin."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def sql_hash_order(key: str, seed) -> str:
    return f"md5(concat(cast({key} as varchar), '|{seed}'))"


def sql_hash_int(key: str, seed) -> str:
    return f"(('0x' || substr({sql_hash_order(key, seed)}, 1, 15))::bigint)"


def sql_uniform(key: str, seed) -> str:
    return f"(({sql_hash_int(key, seed)} >> 7) / 9007199254740992::double)"
