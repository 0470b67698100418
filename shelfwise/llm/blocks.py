"""Corpora as blocks with a dictionary: tokens move once per block, not once each.

A task cuts its texts into tokens and gathers them in blocks. A block has one
row with its documents and, for all their tokens, the position in the block's
dictionary; and one row per distinct token. What is looked up for a token over
the whole corpus travels by dictionary rows (one per block and token, so a token
that every text holds has as many rows as there are blocks) and returns to the
block, where documents are put together again by position.

The table is written to the shared folder and bucketed by block, so that the
join with what comes back moves only that.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from shelfwise.llm.rows import tidy
from shelfwise.session import scratch_path

BLOCK_CHARS = 1 << 24
ROWS = 50_000


class Index(dict):
    """Numbers keys in the order they come."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def pack_seq(seq: np.ndarray) -> bytes:
    """Positions as three byte planes (four if needed), deflated."""
    planes = 4 if len(seq) and int(seq.max()) >> 24 else 3
    raw = seq.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :planes].T.tobytes()
    return bytes([planes]) + zlib.compress(raw, 1)


def pack_keys(keys: np.ndarray) -> bytes:
    """The low 40 bits of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack_keys(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def unpack_seq(blob: bytes) -> np.ndarray:
    planes = blob[0]
    raw = np.frombuffer(zlib.decompress(blob[1:]), np.uint8).reshape(planes, -1)
    out = np.zeros((raw.shape[1], 4), np.uint8)
    out[:, :planes] = raw.T
    return out.view("<u4").ravel()


@tidy
def cut_blocks(
    batches: Iterator[pa.RecordBatch],
    schema: pa.Schema,
    tokens: Callable[[str], Iterable[bytes]],
    weigh: Callable[[list], np.ndarray] | None,
    block_chars: int,
    more: Callable[[bytes, np.ndarray, np.ndarray, np.ndarray], Iterator[dict]] | None = None,
) -> Iterator[pa.RecordBatch]:
    """Rows of the block table from batches with columns id and text.

    ``weigh`` marks, from their ids, documents whose tokens count in ``weight``;
    ``more`` may add columns of its own from (hashes of the words, sequence, lengths, marks).
    """

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema],
            schema=schema,
        )

    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    made = 0
    index, seqs, ids, lens, marks, chars = Index(), [], [], [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal index, seqs, ids, lens, marks, chars, made
        if not ids:
            return
        if made >= 1 << 11 or part >= 1 << 20:
            raise OverflowError("over 2,048 blocks in a task, or 2^20 tasks: raise block_chars")
        block = (part << 11) | made  # below 2^31
        seq = np.concatenate(seqs) if seqs else np.zeros(0, np.uint32)
        uses = np.bincount(seq, minlength=len(index))
        rank = np.empty(len(index), np.int64)
        rank[np.argsort(-uses, kind="stable")] = np.arange(len(index))  # frequent tokens get small numbers
        words = [b""] * len(index)
        for w, i in index.items():
            words[rank[i]] = w
        seq = rank[seq].astype(np.uint32)
        size, mark = np.array(lens, np.int64), np.array(marks, bool)
        weight = np.bincount(seq[np.repeat(mark, size)], minlength=len(words))
        keys = pack_keys(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))) if more else b""
        yield rows(
            1, block=[block], ids=[ids], lens=[size], marks=[mark], blob=[pack_seq(seq)], dictionary=[keys]
        )
        for a in range(0, len(words), ROWS):
            chunk = words[a : a + ROWS]
            k = len(chunk)
            yield rows(
                k, block=np.full(k, block), local=np.arange(a, a + k), word=chunk, weight=weight[a : a + k]
            )
        for x in more(keys, seq, size, mark) if more else ():
            yield rows(len(next(iter(x.values()))), **x)
        made += 1
        index, seqs, ids, lens, marks, chars = Index(), [], [], [], [], 0

    for b in batches:
        names = b.column(0).to_pylist()
        mark = weigh(names) if weigh else np.zeros(len(names), bool)
        for i, text, m in zip(names, b.column(1), mark, strict=True):
            text = text.as_py() or ""
            words = tokens(text)
            seq = np.fromiter(map(index.__getitem__, words), np.uint32)
            seqs.append(seq)
            ids.append(i)
            lens.append(len(seq))
            marks.append(m)
            chars += len(text) + 16
            if chars >= block_chars:
                yield from flush()
    yield from flush()


def block_table(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    tokens: Callable[[str], Iterable[bytes]],
    weigh: Callable[[list], np.ndarray] | None = None,
    more=None,
    block_chars: int = BLOCK_CHARS,
    tag: str = "blocks",
) -> DataFrame:
    """The written table, bucketed by block; see the module's text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = (
        f"block long, ids array<{kind}>, lens array<long>, marks array<boolean>, blob binary, dictionary binary,"
        " local int, word binary, weight long, bucket long, keys binary, counts binary"
    )
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    cut = rows.mapInArrow(lambda b: cut_blocks(b, arrow, tokens, weigh, block_chars, more), schema)
    name = f"{tag}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = cut.write.bucketBy(buckets, "block").option("path", scratch_path(spark, tag)).option("compression", "zstd")
    out.format("parquet").saveAsTable(name)
    return spark.table(name)


def dictionary(table: DataFrame) -> DataFrame:
    """One row per block and distinct token; ``at`` is block * 2^32 + position."""
    at = F.shiftleft("block", 32) + F.col("local")
    return table.where("word is not null").select("word", at.alias("at"), "weight")


def documents(table: DataFrame) -> DataFrame:
    return table.where("blob is not null").select("block", "ids", "lens", "marks", "blob")


def pack_answers(at: np.ndarray, counts: np.ndarray, values: np.ndarray) -> Iterator[dict]:
    """What was looked up for dictionary rows, one row per block.

    ``values`` holds ``counts`` numbers for each row of ``at``. Positions go as
    differences; every array takes the narrowest type that holds it.
    """
    order = np.argsort(at, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    at, counts = at[order], counts[order]
    for a, b in runs(at >> 32):
        local = at[a:b] & 0xFFFFFFFF
        own = values[spread(starts[a:b], counts[a:b])]
        parts = (np.diff(local, prepend=0), counts[a:b], own)
        yield {"block": int(at[a] >> 32)} | dict(zip(ANSWER, map(narrow, parts), strict=True))


def unpack_answers(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, count) by position in the dictionary, and all values, of a block."""
    local = [np.cumsum(widen(x)) for x in rows["local"]]
    counts = np.concatenate([widen(x) for x in rows["n"]] or [np.zeros(0, np.int64)])
    values = np.concatenate([widen(x) for x in rows["values"]] or [np.zeros(0, np.int64)])
    at = np.concatenate(local or [np.zeros(0, np.int64)])
    start, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    start[at], size[at] = np.cumsum(counts) - counts, counts
    return start, size, values


ANSWER = ("local", "n", "values")
ANSWER_SCHEMA = "block long, local binary, n binary, values binary"


def narrow(x: np.ndarray) -> bytes:
    """Non-negative integers with the width that the largest needs in front."""
    top = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w) or w == 8)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def widen(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + size), one after the other."""
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each stretch of equal values; none for an empty array."""
    if len(x):
        cuts = np.flatnonzero(x[1:] != x[:-1]) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)], strict=True)
