"""Byte-level BPE over a corpus: every distinct word is encoded once.

Texts are cut into pre-tokens with their positions; the distinct pre-tokens of
each block are shuffled by word, encoded where equal words meet, and their ids
return to the block, where each text is put together again by position. Ids
become bytes again through the token-byte table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

import public_tokenizers
from shelfwise.llm.blocks import (
    ANSWER,
    ANSWER_SCHEMA,
    block_table,
    dictionary,
    documents,
    pack_answers,
    spread,
    unpack_answers,
    unpack_seq,
)
from shelfwise.llm.rows import tidy
from shelfwise.llm.secret_scan import VOCABULARY, load_ranks

CHUNK = 1 << 16
BLOCK_CHARS = 1 << 25
OUT_BYTES = 1 << 21
#: The white space of the pattern's engine, which Python's ``\s`` widens.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def python_pattern(pattern: str) -> str:
    """The pattern for Python's regex module, with white space spelled out."""
    inside = pattern.replace("[^\\s", "[^" + SPACES)
    return inside.replace("\\s", f"[{SPACES}]").replace("\\S", f"[^{SPACES}]")


def splitter(pattern: str):
    """Cuts a text into the UTF-8 bytes of its pre-tokens, in pieces of bounded size."""
    cut = regex.compile(python_pattern(pattern))

    def tokens(text: str) -> Iterator[bytes]:
        if len(text) < CHUNK:
            return map(str.encode, cut.findall(text))
        return _lazily(cut, text)

    return tokens


def _lazily(cut, text: str) -> Iterator[bytes]:
    found = cut.finditer(text)
    while part := [m[0].encode() for m in islice(found, CHUNK)]:
        yield from part


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
    pattern: str = public_tokenizers.PATTERN, block_chars: int = BLOCK_CHARS, decoded: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (little-endian u32, binary).

    ``decoded`` adds the bytes that the ids stand for, as :func:`decode` would,
    in the same worker. The vocabulary (about 1 MB) is broadcast; nothing else
    is. Equal words meet in one place once per block.

    Defined cases: a null text counts as empty and has no ids; ids of documents
    may be null or repeat, each row is encoded by itself; other columns are
    ignored; an empty table gives no rows; a text of any length is cut lazily
    and stays in one block.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary or public_tokenizers.path(VOCABULARY)))
    table = block_table(docs, id_col, text_col, splitter(pattern), block_chars=block_chars, tag="bpe")
    kind = table.schema["ids"].dataType.elementType.simpleString()

    @tidy
    def encode_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=ranks.value, special_tokens={})
        last, ids = None, []
        for b in batches:
            flat, counts = [], np.empty(len(b), np.int64)
            for i, w in enumerate(b["word"]):
                if w != last:  # sorted: each word is encoded once
                    last, ids = w, enc.encode_ordinary(w.decode())
                flat += ids
                counts[i] = len(ids)
            rows = pack_answers(b["at"].to_numpy(), counts, np.array(flat, np.int64))
            yield pd.DataFrame(list(rows), columns=["block", *ANSWER])

    words = dictionary(table).select("word", "at").repartition("word").sortWithinPartitions("word")
    known = words.mapInPandas(encode_words, ANSWER_SCHEMA)

    schema = f"doc_id {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    @tidy
    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        starts, sizes, flat = unpack_answers({c: right[c].to_pylist() for c in ANSWER})
        flat = flat.astype("<u4")
        back = token_bytes(ranks.value) if decoded else None
        batches, rows, held = [], [], 0

        def flush() -> None:  # batches of bounded size on their way back
            columns = zip(*rows, strict=True)
            batches.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow))
            rows.clear()

        for ids, lens, blob in zip(*(left[c].to_pylist() for c in ("ids", "lens", "blob")), strict=True):
            seq, at = unpack_seq(blob), 0
            for i, k in zip(ids, lens, strict=True):
                parts = [seq[a : min(a + CHUNK, at + k)] for a in range(at, at + k, CHUNK)]
                at += k
                out = b"".join(flat[spread(starts[x], sizes[x])].tobytes() for x in parts)
                rows.append((i, len(out) // 4, out) + ((to_bytes(out, back),) if decoded else ()))
                held += len(out)
                if held > OUT_BYTES:
                    flush()
                    held = 0
        if rows:
            flush()
        return pa.Table.from_batches(batches, arrow)

    return documents(table).groupBy("block").cogroup(known.groupBy("block")).applyInArrow(assemble, schema)


def token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and start and size by id (-1: no token)."""
    top = max(ranks.values()) + 1
    starts, sizes, at = np.zeros(top, np.int64), np.full(top, -1, np.int64), 0
    for b, i in ranks.items():
        starts[i], sizes[i] = at, len(b)
        at += len(b)
    return np.frombuffer(b"".join(ranks), np.uint8), starts, sizes


def decode(
    encoded: DataFrame, ids_col: str = "ids", out: str = "decoded", vocabulary: str | None = None
) -> DataFrame:
    """``encoded`` with the bytes of its ids as ``out``.

    Every id is joined with the token-byte table (50,000 tokens, broadcast). An
    id without a token raises an error; null ids give null.
    """
    ranks = load_ranks(vocabulary or public_tokenizers.path(VOCABULARY))
    table = encoded.sparkSession.sparkContext.broadcast(token_bytes(ranks))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[out] = [to_bytes(x, table.value) for x in b[ids_col]]
            yield b

    schema = encoded.withColumn(out, F.lit(None).cast("binary")).schema
    return encoded.mapInPandas(run, schema)


def to_bytes(blob: bytes | None, back: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes | None:
    """The bytes of little-endian ids, through the token-byte table."""
    if blob is None:
        return None
    raw, starts, sizes = back
    ids = np.frombuffer(blob, "<u4")
    if len(ids) and (ids.max() >= len(sizes) or sizes[ids].min() < 0):
        raise ValueError("an id without a token")
    parts = (ids[a : a + CHUNK] for a in range(0, len(ids), CHUNK))
    return b"".join(raw[spread(starts[x], sizes[x])].tobytes() for x in parts)
