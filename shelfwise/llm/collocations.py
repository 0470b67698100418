"""Phrases that recur, from a weighted de Bruijn graph of each language.

Nodes are three words, edges the four words of two overlapping nodes, weighted by
their occurrences; a piece's end is the edge to the word 0. Only these longest
grams are counted over the corpus:

1. Tasks cut texts into blocks of word numbers; words seen often enough get a
   number over the corpus. A rarer word ends a piece, as no phrase can hold it.
2. Each block gathers its edges, equal ones once with their weight, and deals
   them out by the two words they start with. Where both are so frequent that
   they might fill a task, the third divides them over a few places, and then the
   fourth: as many places as the rarest of these words could need.
3. Each part (about ``PART_EDGES`` edges) is sorted, so the flow out of a node is a
   sum over neighbours: with the ends it gives the counts of three and of two
   words. A path that neither branches nor ends on its way from two words to four
   is one row. Sums that a part does not hold whole are added up afterwards.

All counts are exact; nothing is hashed but the place where rows meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from shelfwise.llm.blocks import Index, narrow, pack_seq, runs, unpack_seq, widen
from shelfwise.llm.bloom import mix64
from shelfwise.llm.rows import tidy
from shelfwise.session import materialize, measured, release

BLOCK_CHARS = 1 << 24
ROWS = 50_000
PART_EDGES = 1 << 20
PARTS_PER_TASK = 4
LEVELS = 16
END = b"\n"
UPPER = bytes(range(65, 91))
#: Every separator of pieces becomes a line feed, a tab a blank, A-Z lower case.
FOLD = bytes.maketrans(UPPER + b".,;:!?\x0b\x0c\x0d\t", UPPER.lower() + b"\n" * 9 + b" ")
WORDS = re.compile(rb"[^ \n]+|\n").finditer
SALTS = 64


def words(text: str) -> Iterator[bytes]:
    """The folded words of a text, and a line feed where a piece ends."""
    return (m[0] for m in WORDS(text.encode("utf-8", "surrogatepass").translate(FOLD) + END))


def _schema(text: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(text))


def _rows(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
    )


@tidy
def _blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema, block_chars: int) -> Iterator[pa.RecordBatch]:
    """Per block and language: one row with the word numbers, and the distinct words with their uses."""
    made, chars, held = (TaskContext.get().partitionId() << 32), 0, {}

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal made
        for lang, (index, parts) in held.items():
            seq = np.concatenate(parts)
            uses = np.bincount(seq, minlength=len(index))
            known = list(index)
            yield _rows(schema, 1, block=[made], lang=[lang], blob=[pack_seq(seq)])
            for a in range(1, len(known), ROWS):  # number 0 is the end of a piece
                own = known[a : a + ROWS]
                k = len(own)
                yield _rows(schema, k, block=np.full(k, made), lang=[lang] * k, local=np.arange(a, a + k), word=own, uses=uses[a : a + k])
            made += 1
        held.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if lang not in held:
                held[lang] = (Index({END: 0}), [])
            text = text.as_py() or ""
            index, parts = held[lang]
            parts.append(np.fromiter(map(index.__getitem__, words(text)), np.uint32))
            chars += len(text) + 16
            if chars >= block_chars:
                yield from flush()
                chars = 0
    yield from flush()


def edges(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (first two words, next two) with weights, sorted; 0 stands for an end.

    One edge begins at each word that has a follower. Behind an end all is 0.
    """
    g = np.concatenate([g, np.zeros(3, np.uint64)])
    a, b, c, d = (g[k : len(g) - 3 + k] for k in range(4))
    some = (a != 0) & (b != 0)
    hi = a[some] << np.uint64(32) | b[some]
    c = c[some]
    lo = c << np.uint64(32) | np.where(c == 0, np.uint64(0), d[some])
    del a, b, c, d, g
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    start = np.flatnonzero(heads(hi) | heads(lo))
    return hi[start], lo[start], np.diff(np.r_[start, len(hi)])


def heads(x: np.ndarray) -> np.ndarray:
    return np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)


def shared_level(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least level of the first two and of the first three words of each edge."""
    bits, half = np.uint64(LEVELS - 1), np.uint64(32)
    two = np.minimum(hi >> half & bits, hi & bits)
    return two, np.minimum(two, lo >> half & bits)


def home(hi: np.ndarray, lo: np.ndarray, parts: int) -> np.ndarray:
    """The part of each edge.

    Edges of one pair share a part unless both words have a level: it says into how
    many places, as a power of two, the edges of so frequent a word are split, and a
    phrase is as rare as its rarest word. The third word, then the fourth, chooses
    the place.
    """
    two, three = shared_level(hi, lo)
    one = np.uint64(1)
    place = mix64(lo >> np.uint64(32)) & ((one << two) - one)
    last = mix64(lo) & ((one << three) - one)
    h = mix64(mix64(hi) + place * np.uint64(0x9E3779B97F4A7C15) + last * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(blob: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, 8 * n).reshape(8, n).T).view("<u8").ravel()


def pack(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted edges with their weights, compressed."""
    raw = planes(np.diff(hi, prepend=np.uint64(0))) + planes(lo) + narrow(n)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return np.cumsum(unplanes(raw, n)), unplanes(raw[8 * n :], n), widen(raw[16 * n :])


def _deal(parts: int):
    """The edges of a block, packed for each part."""
    schema = _schema("part int, n int, edges binary")

    @tidy
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for blob in left["blob"].to_pylist():
            seq = unpack_seq(blob)
            ids = np.zeros(int(seq.max(initial=0)) + 1, np.uint64)
            ids[right["local"].to_numpy()] = right["id"].to_numpy().astype(np.uint64)
            hi, lo, n = edges(ids[seq])
            part = home(hi, lo, parts)
            order = np.argsort(part, kind="stable")
            for a, b in runs(part[order]):
                i = order[a:b]
                out.append((int(part[i[0]]), len(i), pack(hi[i], lo[i], n[i])))
        columns = zip(*out, strict=True) if out else [[], [], []]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def flows(hi: np.ndarray, lo: np.ndarray, c: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(hi, lo, a, since, whole) of the phrases that begin the sorted edges of a part.

    ``whole`` rows hold all of a phrase, at least ``least`` times, and stand for
    the phrases of ``since`` words up to their own, all with the same count. The
    others are parts of a sum: their words are all so frequent that their edges
    were dealt to several parts.
    """
    half = np.uint64(32)
    pair = heads(hi)
    node = pair | heads(lo >> half)
    edge = node | heads(lo)
    hot = [level > 0 for level in shared_level(hi, lo)]
    sums, starts, split, at = [], [], [], []
    for head, many in ((pair, hot[0]), (node, hot[1]), (edge, np.zeros(len(hi), bool))):
        s = np.flatnonzero(head)
        starts.append(s)
        sums.append(np.add.reduceat(c, s))
        split.append(many[s])
        at.append(np.cumsum(head) - 1)
    out = []
    s2, s3, s4 = starts
    third, fourth = (lo >> half) != 0, (lo & np.uint64(0xFFFFFFFF)) != 0

    def same(k: int, s: np.ndarray, by: int) -> np.ndarray:
        """Whether the shorter phrase at the starts ``s`` is whole and has the count of level ``by``."""
        return ~split[k][at[k][s]] & ~split[by][at[by][s]] & (sums[k][at[k][s]] == sums[by][at[by][s]])

    # four words; a node or pair of the same weight is the same path
    own = fourth[s4]
    e = s4[own]
    back3 = same(1, e, 2)
    back2 = back3 & same(0, e, 2)
    out.append((hi[e], lo[e], sums[2][own], np.where(back2, 2, np.where(back3, 3, 4)), ~split[2][own]))
    # three words, unless the path goes on
    own = third[s3]
    e = s3[own]
    goes = fourth[e] & same(1, e, 2)
    back2 = same(0, e, 1)
    top = lo[e] >> half << half
    keep = ~goes
    out.append((hi[e][keep], top[keep], sums[1][own][keep], np.where(back2, 2, 3)[keep], (~split[1][own])[keep]))
    # two words
    keep = ~(third[s2] & same(0, s2, 1))
    out.append((hi[s2][keep], np.zeros(keep.sum(), np.uint64), sums[0][keep], np.full(keep.sum(), 2), (~split[0])[keep]))
    rows = [np.concatenate(x) for x in zip(*out, strict=True)]
    stay = ~rows[4] | (rows[2] >= least)
    return tuple(x[stay] for x in rows)


def _scan(least: int):
    """The phrases of each part, from its packed edges, which come sorted by part."""
    names = ["hi", "lo", "a", "since", "whole"]

    def phrases_of(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        hi, lo, c = (np.concatenate(x) for x in zip(*(unpack(blob, n) for n, blob in rows), strict=True))
        order = np.lexsort((lo, hi))
        hi, lo, a, since, whole = flows(hi[order], lo[order], c[order], least)
        columns = (hi.astype(np.int64), lo.astype(np.int64), a, since.astype(np.int32), whole)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for b in batches:
            for k in range(len(b)):
                part, n, blob = (b.column(j)[k].as_py() for j in range(3))
                if part != last and held:
                    yield phrases_of(held)
                    held = []
                last = part
                held.append((n, blob))
        if held:
            yield phrases_of(held)

    return run


def word_table(table: DataFrame, least: int, tasks: int, total: int) -> DataFrame:
    """(lang, word, f, id) of the words seen ``least`` times or more.

    An id is a dense number and, in its last four bits, the word's level: 0 up to a
    quarter of a task's share of all words, then one more each time the word is
    twice as frequent. Fewer than 4 x tasks words have a level.
    """
    counted = table.where("word is not null").groupBy("lang", "word").agg(F.sum("uses").alias("f")).where(F.col("f") >= least)
    rows = materialize(counted.withColumn("mid", F.monotonically_increasing_id()), "phrase-words")
    part = F.shiftright("mid", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per task
    sizes = measured(sizes.select("part", F.coalesce(before, F.lit(0)).alias("before")), "phrase-sizes")
    number = F.col("before") + F.col("mid").bitwiseAND((1 << 33) - 1) + 1
    share = F.ceil(F.log2(F.col("f") * (4.0 * tasks / max(total, 1))))
    level = F.least(F.greatest(share, F.lit(0)), F.lit(LEVELS - 1)).cast("long")
    fits = F.when(number < 1 << 28, number * LEVELS + level).otherwise(F.raise_error(F.lit("2^28 frequent words or more")).cast("long"))
    return materialize(rows.join(sizes, part == F.col("part")).select("lang", "word", "f", fits.alias("id")), "phrase-ids")


def phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, block_chars: int = BLOCK_CHARS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases: hi, lo, a, since), (words: lang, word, f, id), (totals: lang, n).

    A phrase is two to four word ids, two in each of hi and lo, 0 where it has
    ended. Its row stands for its beginnings of ``since`` words or more, too.
    """
    spark = docs.sparkSession
    schema = "block long, lang string, blob binary, local int, word binary, uses long"
    arrow = _schema(schema)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    table = materialize(rows.mapInArrow(lambda b: _blocks(b, arrow, block_chars), schema), "phrase-blocks")
    totals = measured(
        table.where("word is not null").groupBy("lang").agg(F.sum("uses").alias("n")), "phrase-totals"
    )
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(PARTS_PER_TASK * shuffle, total // PART_EDGES + 1)
    tasks = max(shuffle, parts // PARTS_PER_TASK)
    known = word_table(table, least, tasks, total)

    local = table.where("word is not null").select(F.col("block").alias("at"), "lang", "word", "local")
    local = local.join(known.select("lang", "word", "id"), ["lang", "word"]).select("at", "local", "id")
    seqs = table.where("blob is not null").select("block", "blob")
    dealt = seqs.groupBy("block").cogroup(local.groupBy("at")).applyInArrow(_deal(parts), "part int, n int, edges binary")
    found = dealt.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(
        _scan(least), "hi long, lo long, a long, since int, whole boolean"
    )
    found = materialize(found, "phrase-flows")
    release(table)
    length = F.when(F.col("lo") == 0, 2).when(F.col("lo").bitwiseAND(0xFFFFFFFF) == 0, 3).otherwise(4)
    added = found.where("not whole").groupBy("hi", "lo").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    whole = found.where("whole").select("hi", "lo", "a", "since")
    return materialize(whole.union(added.select("hi", "lo", "a", length.alias("since"))), "phrase-counts"), known, totals


def _numbers() -> list[Column]:
    low = 0xFFFFFFFF
    return [F.shiftright("hi", 32), F.col("hi").bitwiseAND(low), F.shiftright("lo", 32), F.col("lo").bitwiseAND(low)]


def _key(*g: Column) -> list[Column]:
    """hi and lo of a phrase of these words."""
    g = [*g, F.lit(0).cast("long"), F.lit(0).cast("long")][:4]
    return [(F.shiftleft(g[0], 32).bitwiseOR(g[1])).alias("hi"), F.shiftleft(g[2], 32).bitwiseOR(g[3]).alias("lo")]


def _with_words(rows: DataFrame, known: DataFrame, column: str, *wanted: Column) -> DataFrame:
    """``rows`` with columns of the word whose id is in ``column``.

    The words that many rows share have a level, are fewer than four times the
    tasks, and are broadcast; the others are joined by shuffle.
    """
    side = known.select(F.col("id").alias(column), *wanted)
    many = F.col(column).bitwiseAND(LEVELS - 1) > 0
    return rows.where(many).join(F.broadcast(side.where(many)), column).unionByName(rows.where(~many).join(side.where(~many), column))


def mine(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, inside: int = 80, top: int = 2000,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of two to four words occurs ``least`` times or more within pieces.
    Cut in two parts that occur l and r times it scores 2,000,000 a / (l + r),
    rounded down; the lowest cut counts, the first of equal ones. It goes if a
    longer one holds it and has ``inside`` percent of its occurrences.

    Defined cases: a null or empty text has no words; a null language is ``und``,
    with documents so marked; equal texts count each; words are bytes of UTF-8,
    only A-Z is folded; other columns are ignored; an empty table gives no rows.
    """
    paths, known, totals = phrases(docs, text_col, lang_col, least, block_chars)
    g = _numbers()
    long_, full = F.col("lo") != 0, F.col("lo").bitwiseAND(0xFFFFFFFF) != 0
    size = F.when(full, 4).when(long_, 3).otherwise(2)

    # what the longer phrases hold
    held = lambda when, *w: F.when(when, F.struct(*_key(*w)))
    subs = F.array_compact(
        F.array(
            held(full, *g[:3]), held(full, *g[1:]), held(long_, *g[:2]), held(long_, *g[1:3]), held(full, *g[2:])
        )
    )
    inner = paths.where(long_).select(F.explode(subs).alias("s"), "a").groupBy("s.hi", "s.lo").agg(F.max("a").alias("over"))
    open_ = paths.join(inner, ["hi", "lo"], "left").where(
        F.col("over").isNull() | (F.col("over").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * inside)
    ).drop("over")
    open_ = materialize(open_, "phrase-open")

    # counts of the parts of two and three words that lie on other paths
    part = lambda when, name, *w: F.when(when, F.struct(F.lit(name).alias("part"), *_key(*w)))
    since = F.col("since")
    asked = F.array_compact(
        F.array(
            part(long_ & (since > 2), "l2", *g[:2]), part(full & (since > 3), "l3", *g[:3]),
            part(long_ & ~full, "r2", *g[1:3]), part(full, "r2", *g[2:]), part(full, "r3", *g[1:]),
        )
    )
    asked = open_.where(long_).select(F.col("hi").alias("h"), F.col("lo").alias("o"), F.explode(asked).alias("s"))
    first = lambda k: F.struct(*_key(*g[:k]))
    every = paths.select(
        F.explode(
            F.array_compact(F.array(
                first(4), F.when(full & (since <= 3), first(3)), F.when(long_ & (since <= 2), first(2))
            ))
        ).alias("p"),
        F.col("a").alias("f"),
    ).select("p.hi", "p.lo", "f")
    parts = asked.select("h", "o", "s.part", "s.hi", "s.lo").join(every, ["hi", "lo"])
    parts = parts.groupBy("h", "o").agg(*[F.max(F.when(F.col("part") == x, F.col("f"))).alias(x) for x in ("l2", "l3", "r2", "r3")])
    rows = open_.select("hi", "lo", "a", size.alias("size"), g[0].alias("first"), F.when(full, g[3]).when(long_, g[2]).otherwise(g[1]).alias("last"))
    rows = rows.join(parts.toDF("hi", "lo", "l2", "l3", "r2", "r3"), ["hi", "lo"], "left")
    rows = _with_words(rows, known, "first", F.col("f").alias("l1"), "lang")
    rows = _with_words(rows, known, "last", F.col("f").alias("r1"))

    # a beginning without a count of its own lies on the phrase's path
    l2, l3 = F.coalesce("l2", "a"), F.coalesce("l3", "a")
    cut = lambda when, k, l, r: F.when(  # noqa: E731, E741
        when,
        F.struct(
            F.expr("cast(a as decimal(20,0)) * 2000000").alias("up"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")
        ),
    )
    n, two, three, four = F.col("size"), F.col("r1"), F.col("r2"), F.col("r3")
    cuts = F.array_compact(
        F.array(
            cut(n >= 2, 1, F.col("l1"), F.when(n == 2, two).when(n == 3, three).otherwise(four)),
            cut(n >= 3, 2, l2, F.when(n == 3, two).otherwise(three)),
            cut(n == 4, 3, l3, two),
        )
    )
    rows = rows.withColumn("cuts", cuts).withColumn(
        "best", F.expr("array_min(transform(cuts, x -> struct(x.up div (x.l + x.r) as score, x.k as k, x.l as l, x.r as r)))")
    )
    rows = rows.select("lang", "hi", "lo", "a", "best.l", "best.r", "best.score")

    # the first by score and count with all ties, from many parts, then their words
    order = [F.desc("score"), F.desc("a")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("hi", "lo"), F.lit(SALTS)))
    near = salted.withColumn("at", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("at") <= top)
    near = near.withColumn("at", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("at") <= top)
    near = materialize(near.drop("salt", "at"), "phrase-near")
    spelled = near.select("hi", "lo", F.posexplode(F.array(*g)).alias("k", "id")).where("id <> 0")
    spelled = spelled.join(known.select("id", F.col("word").cast("string").alias("word")), "id")
    spelled = spelled.groupBy("hi", "lo").agg(F.sort_array(F.collect_list(F.struct("k", "word"))).alias("w"))
    spelled = spelled.select("hi", "lo", F.array_join(F.col("w.word"), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")
    out = near.join(spelled, ["hi", "lo"]).withColumn("rank", rank).where(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
