"""Rows told apart by where they lie, and memory given back between tasks."""

from __future__ import annotations

import ctypes
import functools
import inspect

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import materialize


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores in front until no column is called so."""
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with one more column that tells its rows apart, and its name.

    Rows of files are known by a 64-bit hash of the path and their place in the
    file, which every reading finds again; nothing is copied. A table from any
    other source is written once with numbers.
    """
    name = fresh("_row", docs.columns)
    try:
        meta = docs.metadataColumn("_metadata")
        key = F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("at"))
        return docs.withColumn(name, key), name
    except AnalysisException:
        key = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))
        return materialize(docs.withColumn(name, key), "numbered"), name


def give_back() -> None:
    """Return freed memory to the system, which an idle worker would keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """``run``, a function of batches or of a group, gives memory back when it ends."""
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def each(*args, **kwargs):
            yield from run(*args, **kwargs)
            give_back()

        return each

    @functools.wraps(run)
    def once(*args, **kwargs):
        out = run(*args, **kwargs)
        give_back()
        return out

    once.__signature__ = inspect.signature(run)  # Spark counts the arguments
    return once
