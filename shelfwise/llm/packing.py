"""Best-fit packing of documents into token sequences of bounded length.

Hierarchical: pieces are dealt at random to groups of a fixed number of tokens,
and each group packs its own by best fit, longest first. Bins that can still take
or join another are the items of the next round, where groups are merged in a
tree and best fit runs again on whole bins; all others are done.

Which bins go up follows from best fit itself. No two bins of a group fit into
one (the later would never have been opened), so at most one bin of each group
can move, and the bins of a group will be asked to take at most ``FAN - 1``
movers in each round that is left. So many of the emptiest bins suffice, whatever
the size of the group, and a round holds a bounded number of items per group.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

import public_tokenizers
from shelfwise.llm.rows import tidy
from shelfwise.session import materialize, measured

VOCABULARY = "word_bpe_49k.json"
LIMIT = 4096
END = 1
GROUP_TOKENS = 1 << 22
GROUP_PIECES = 1 << 18
FAN = 16
CHUNK = 1 << 20
MEMO = 1 << 19
OUT_BYTES = 1 << 22
#: Parts whose rules are spelled out here: printable ASCII and the Latin-1 letters.
SIMPLE = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+").fullmatch
#: Fixed value: the vocabulary's cut into pre-tokens, for such parts in lower case.
SIMPLE_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall


class Words(dict):
    """Ids of the pre-tokens of simple parts, from the library's model alone."""

    def __init__(self, own: Tokenizer):
        super().__init__()
        named = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.own, self.names = own, {c: named(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def __missing__(self, key: str) -> bytes:
        word = key
        if len(self) > 2 * MEMO:
            self.clear()
        if not word.isascii():  # letters by their bytes, as the model names them
            word = word.translate(self.names)
        ids = [t.id for t in self.own.model.tokenize(word)]
        self[key] = found = pack_ids(f"<{len(ids)}I", *ids)
        return found


class Coder(dict):
    """Ids (little-endian unsigned 32 bit) of the parts of a text between blanks.

    No rule of this vocabulary reaches over a blank, so each distinct part is
    encoded once and remembered. In ASCII and Latin-1 letters, lower case and the
    cut into pre-tokens are spelled out, so that parts share pre-tokens; any other
    part is left to the library as a whole.
    """

    def __init__(self, path: str):
        super().__init__()
        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True  # names of special tokens are ordinary text
        self.words = Words(self.own)

    def __missing__(self, part: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        if SIMPLE(part):
            low = part.lower()
            found = self.words[low] if low.isalpha() else b"".join(map(self.words.__getitem__, SIMPLE_WORDS(low)))
        else:
            found = np.array(self.own.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        self[part] = found
        return found

    def encode(self, text: str) -> bytes:
        out, a = [], 0
        while a < len(text):  # a very long text by stretches, cut at a blank
            b = text.find(" ", a + CHUNK)
            b = len(text) if b < 0 else b
            parts = text[a:b].replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            out.append(b"".join(map(self.__getitem__, parts)))
            a = b
        return b"".join(out)


def best_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, place) of each item and the free space of each bin; longest items first.

    Each item goes to the bin with the least space that holds it. Free spaces are
    bits of one number, so the tightest is found in constant time.
    """
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    having: list[list[int]] = [[] for _ in range(limit + 1)]
    mask, free = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            own = having[space].pop()
            if not having[space]:
                mask ^= 1 << space
        else:
            space, own = limit, len(free)
            free.append(0)
        bins[i], places[i] = own, limit - space
        left = free[own] = space - n
        if left:
            having[left].append(own)
            mask |= 1 << left
    return bins, places, np.array(free, np.int64)


def emptiest(free: np.ndarray, n: int) -> np.ndarray:
    """Marks the n bins with most space, full ones never."""
    stay = np.zeros(len(free), bool)
    stay[np.argsort(-free, kind="stable")[:n]] = True
    return stay & (free > 0)


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
    limit: int = LIMIT, end: int = END, ids: bool = True,
) -> DataFrame:
    """Each document's ids and the end id, cut every ``limit`` ids: row, doc_id,
    piece, start, length, ids_crc32 and, if wanted, ids. ``row`` is unique."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    last = np.array([end], "<u4").tobytes()

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, rows, held, made = Coder(path), [], 0, TaskContext.get().partitionId() << 40

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = coder.encode(text.as_py() or "") + last
                for k, a in enumerate(range(0, len(own), 4 * limit)):
                    part = own[a : a + 4 * limit]
                    row = (made, i, k, a // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, part) if ids else row)
                    made += 1
                    held += 64 + len(part) * ids
                    if held >= OUT_BYTES:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
    limit: int = LIMIT, end: int = END, ids: bool = True, group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (if wanted),
    sequence_id and offset, the place in the sequence.

    Only documents longer than ``limit`` are cut. Sequences are filled without
    gaps from 0. Which documents share a sequence hangs on how the table is split.

    Defined cases: a null or empty text is the end id alone; null and repeated
    ids are told apart by row; names of special tokens in a text are ordinary
    text; other columns are ignored; an empty table gives no rows; very long
    texts are encoded by stretches.
    """
    cut = materialize(pieces(docs, id_col, text_col, vocabulary, limit, end, ids), "pack-pieces")
    size = cut.agg(F.sum("length").alias("tokens"), F.count("*").alias("rows")).first()
    groups = max(1, -(-(size.tokens or 0) // group_tokens), -(-size.rows // GROUP_PIECES))
    rounds = 0
    while FAN**rounds < groups:
        rounds += 1
    more = "bin long, place long, free long, open boolean"
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema), more])

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        bins, places, free = best_fit(table["length"].to_numpy(), limit)
        go = emptiest(free, rounds * (FAN - 1) + 1) if rounds else np.zeros(len(free), bool)
        table = table.drop_columns("group").append_column("bin", pa.array((key[0].as_py() << 32) + bins))
        table = table.append_column("place", pa.array(places)).append_column("free", pa.array(free[bins]))
        return table.append_column("open", pa.array(go[bins]))

    dealt = cut.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups).cast("long")))
    placed = materialize(dealt.groupBy("group").applyInArrow(fit, schema), "pack-placed")
    first = placed.where("open and place = 0")
    joined = _joined(first.select("bin", (F.lit(limit) - F.col("free")).alias("fill")), limit, rounds)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    if joined is None:
        return placed.select(*columns, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    return placed.join(joined, "bin", "left").select(
        *columns, F.coalesce("sequence", "bin").alias("sequence_id"),
        (F.col("place") + F.coalesce("base", F.lit(0))).alias("offset"),
    )


def _joined(first: DataFrame, limit: int, rounds: int) -> DataFrame | None:
    """(bin, sequence, base) of all bins that best fit puts together in the tree."""
    items = first.select(
        F.shiftright("bin", 32).alias("group"), "fill",
        F.array(F.struct("bin", F.lit(0).cast("long").alias("base"))).alias("members"),
    )
    schema = "group long, fill long, members array<struct<bin: long, base: long>>, open boolean"
    done = []
    for left in range(rounds - 1, -1, -1):
        level = items.withColumn("group", F.floor(F.col("group") / FAN)).groupBy("group")
        level = materialize(level.applyInPandas(_merge(limit, left * (FAN - 1) + 1 if left else 0), schema), "pack-round")
        done.append(level.where("not open and size(members) > 1"))
        items = level.where("open").drop("open")
    if not done:
        return None
    whole = done[0]
    for x in done[1:]:
        whole = whole.union(x)
    whole = whole.select(F.col("members")[0]["bin"].alias("sequence"), F.explode("members").alias("m"))
    return measured(whole.select("m.bin", "sequence", "m.base"), "pack-joined")


def _merge(limit: int, stay: int):
    """Best fit on the whole bins of sibling groups; ``stay`` of them go on."""

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        bins, places, free = best_fit(df["fill"].to_numpy(), limit)
        members: list[list] = [[] for _ in free]
        for own, place, items in zip(bins, places, df["members"], strict=True):
            members[own] += [{"bin": x["bin"], "base": int(x["base"] + place)} for x in items]
        return pd.DataFrame({"group": key[0], "fill": limit - free, "members": members, "open": emptiest(free, stay)})

    return run


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences of :func:`pack`: sequence_id, length and ids in their order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["ids"])), ""))
    return rows.select("sequence_id", "length", joined.alias("ids"))
