"""Language-model scores from a log-frequency Bloom filter.

The filter holds, for each word and each pair of neighbouring words of the
training texts, as many entries as its quantised log count: (gram, 1) to
(gram, q). A count is read back by probing (gram, 1), (gram, 2), ... until one is
missing. The filter is made in slices, one task each, with the same bits per entry
at every size. A small one is broadcast; of a larger one each slice stays with its
task, meets there the distinct grams of all blocks that belong to it, and the
levels go back by block. The score of a word after another is a
Dirichlet-smoothed pair count over a smoothed word count, both from probes.

The exact word counts of the base score go through the dictionaries of blocks
(:mod:`shelfwise.llm.blocks`): one row per block and distinct word is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.blocks import (
    ANSWER,
    ANSWER_SCHEMA,
    BLOCK_CHARS,
    block_table,
    dictionary,
    narrow,
    pack_answers,
    pack_seq,
    runs,
    spread,
    unpack_answers,
    unpack_keys,
    unpack_seq,
    widen,
)
from shelfwise.llm.bloom import Slices, assemble, best_hashes, fill, mix64
from shelfwise.session import materialize, release

END = b"\n"  # no word holds a line end
START_KEY = np.uint64(0x5DEECE66D)
STEP = np.uint64(0x9E3779B97F4A7C15)
BASE = 1.5
BITS_PER_ENTRY = 10
MAX_BYTES = 128 << 20
PRIOR = 20.0
CHUNK = 1 << 19
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_and_end(text: str) -> Iterator[bytes]:
    """Words with A-Z lower-cased, then the end token."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    if len(raw) < 1 << 20:
        yield from raw.split()
    else:
        for m in WORD.finditer(raw):
            yield m[0]
    yield END


def held_out(ids: list, parts: int = 7, part: int = 2) -> np.ndarray:
    """Whether crc32 of the id as text leaves the remainder (a null id: as empty text)."""
    text = ("" if i is None else str(i) for i in ids)
    return np.fromiter((zlib.crc32(t.encode()) % parts == part for t in text), bool, len(ids))


def quantise(counts: np.ndarray) -> np.ndarray:
    """1 for 1, then one more each time the count grows by the base."""
    return 1 + np.floor(np.log(counts.astype(np.float64)) / np.log(BASE) + 1e-9).astype(np.int64)


def expected(q: np.ndarray) -> np.ndarray:
    """Middle of the counts that share a level; 0 for level 0."""
    return np.where(q > 0, (BASE ** (q - 1) + np.maximum(BASE**q - 1, 1)) / 2, 0.0)


def pair_keys(seq: np.ndarray, lens: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Keys of (word before, word); the first word of a text follows the start."""
    now = keys[seq]
    before = np.empty_like(now)
    before[1:] = now[:-1]
    first = np.cumsum(lens) - lens
    before[first[lens > 0]] = START_KEY
    return mix64(mix64(before) * STEP + now)


def gram_rows(buckets: int):
    """Columns bucket, keys, counts of a block's training grams."""

    def rows(dictionary: bytes, seq: np.ndarray, lens: np.ndarray, marks: np.ndarray) -> Iterator[dict]:
        own = seq[np.repeat(marks, lens)]
        lens = lens[marks]
        if not len(own):
            return
        keys = unpack_keys(dictionary)
        used = np.bincount(own, minlength=len(keys))
        pairs, n = np.unique(pair_keys(own, lens, keys), return_counts=True)
        grams = np.concatenate([mix64(keys[used > 0]), pairs, mix64(np.array([START_KEY]))])
        counts = np.concatenate([used[used > 0], n, [len(lens)]])
        del own, pairs, n
        where, low = slot(grams, buckets)
        order = np.argsort(where.astype(np.uint64) << np.uint64(32) | low)
        where, low, counts = where[order], low[order], counts[order]
        out = [
            (
                int(where[a]),
                pack_seq(np.diff(low[a:b], prepend=np.uint64(0))),
                zlib.compress(narrow(counts[a:b]), 1),
            )
            for a, b in runs(where)
        ]
        yield {"bucket": [x[0] for x in out], "keys": [x[1] for x in out], "counts": [x[2] for x in out]}

    return rows


def slot(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Slice and 32-bit key inside it."""
    return ((grams >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), grams & np.uint64(0xFFFFFFFF)


def code(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Slice and key inside it as one number."""
    where, low = slot(grams, buckets)
    return where.astype(np.uint64) << np.uint64(32) | low


def gram_codes(seq: np.ndarray, lens: np.ndarray, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Codes of all distinct grams that scores of a block ask for, sorted."""
    return np.unique(code(np.concatenate([mix64(keys), pair_keys(seq, lens, keys), mix64(np.array([START_KEY]))]), buckets))


def fill_slice(most_bits: int | None = None):
    """One slice of the filter from all counts of its grams."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        low = np.concatenate([np.cumsum(unpack_seq(x).astype(np.uint64)) for x in df["keys"]])
        n = np.concatenate([widen(zlib.decompress(x)) for x in df["counts"]])
        keys, at = np.unique(low, return_inverse=True)
        q = quantise(np.bincount(at, n))
        entries = np.repeat(keys, q) | (spread(np.ones(len(q), np.int64), q).astype(np.uint64) << np.uint64(32))
        bits = -(-len(entries) * BITS_PER_ENTRY // 64) * 64
        if most_bits is not None:
            bits = min(most_bits, bits)
        k = best_hashes(len(entries), bits)
        return pd.DataFrame(
            {"slice": [df["bucket"].iloc[0]], "size": [bits], "hashes": [k], "bits": [fill(entries, bits, k)], "top": [q.max()]}
        )

    return one


def levels(model: Slices, grams: np.ndarray) -> np.ndarray:
    """Quantised log counts by repeated probes; 0 for a gram that is not there."""
    part, low = slot(grams, len(model.size))
    return climb(model, low, part, model.top)


def climb(model: Slices, low: np.ndarray, part: np.ndarray, top: int) -> np.ndarray:
    """Levels of keys in their slices, at most ``top``."""
    q = np.zeros(len(low), np.int64)
    left, j = np.arange(len(low)), 0
    while len(left) and j < top:
        j += 1
        hit = model.holds(low[left] | np.uint64(j << 32), part[left])
        left = left[hit]
        q[left] = j
    return q


def ask(buckets: int):
    """Per slice, the keys of a block's distinct grams."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for block, lens, blob, dictionary in zip(*(df[c] for c in ("block", "lens", "blob", "dictionary")), strict=True):
            codes = gram_codes(unpack_seq(blob), np.asarray(lens), unpack_keys(dictionary), buckets)
            where, low = (codes >> np.uint64(32)).astype(np.int64), codes & np.uint64(0xFFFFFFFF)
            rows += [(int(where[a]), block, pack_seq(np.diff(low[a:b], prepend=np.uint64(0)))) for a, b in runs(where)]
        return pd.DataFrame(rows, columns=["bucket", "block", "keys"])

    return one


def answer_slice(top: int):
    """Per block, the levels of the keys it asks of one slice, in their order."""

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        model = assemble([r | {"slice": 0} for r in right.to_dict("records")], 1)
        rows = []
        for bucket, block, keys in zip(left["bucket"], left["block"], left["keys"], strict=True):
            low = np.cumsum(unpack_seq(keys).astype(np.uint64))
            q = climb(model, low, np.zeros(len(low), np.int64), top)
            rows.append((block, bucket, zlib.compress(narrow(q), 1)))
        return pd.DataFrame(rows, columns=["block", "slice", "levels"])

    return one


def log_probs(look, seq, lens, keys, uni, tokens: int, types: int, prior: float) -> np.ndarray:
    """log10 probability of each token after the one before it; ``look`` gives the levels of grams."""
    pairs, at = np.unique(pair_keys(seq, lens, keys), return_inverse=True)
    both = expected(look(pairs))[at]
    p1 = (uni[seq] + 1) / (tokens + types + 1)
    context = np.empty(len(seq))
    context[1:] = uni[seq[:-1]]
    first = (np.cumsum(lens) - lens)[lens > 0]
    context[first] = expected(look(mix64(np.array([START_KEY]))))[0]
    context = np.maximum(context, both)
    return np.log10(np.minimum(1.0, (both + prior * p1) / (context + prior)))


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR, max_bytes: int = MAX_BYTES,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    The filter takes 10 bits per entry at every size and so grows with the grams
    of the corpus. ``max_bytes`` bounds what is broadcast: a larger filter stays
    in its slices and the grams of each block are sent to them. Scores do not
    hang on which way is taken.

    Defined cases: a null or empty text is one end token; a null id counts as an
    empty text in the split; ids may repeat, each row is a text of its own;
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = block_table(
        docs, id_col, text_col, words_and_end, lambda ids: ~held_out(ids), gram_rows(buckets), block_chars, "lm"
    )
    kind = table.schema["ids"].dataType.elementType.simpleString()
    made = (
        table.where("keys is not null").select("bucket", "keys", "counts").groupBy("bucket")
        .applyInPandas(fill_slice(), "slice long, size long, hashes long, bits binary, top long")
    )
    slices = materialize(made, "lm-slices")
    most = slices.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0)), F.coalesce(F.max("top"), F.lit(0))).first()
    texts = table.where("blob is not null").select("block", "ids", "lens", "marks", "blob", "dictionary")
    model = None
    if most[0] <= max_bytes:
        model = spark.sparkContext.broadcast(assemble([r.asDict() for r in slices.collect()], buckets).plain())
        release(slices)
    else:
        asked = texts.groupBy("block").applyInPandas(ask(buckets), "bucket long, block long, keys binary")
        answers = asked.groupBy("bucket").cogroup(slices.groupBy("slice"))
        answers = answers.applyInPandas(answer_slice(most[1]), "block long, slice long, levels binary")

    words = dictionary(table).repartition("word").sortWithinPartitions("word")
    known = materialize(words.mapInPandas(count_words, ANSWER_SCHEMA + ", tokens long, types long"), "lm-counts")
    total = known.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    tokens, types = int(total[0]), int(total[1])
    back = known.where("block is not null").select("block", *ANSWER)
    if model is None:
        back = back.unionByName(answers, allowMissingColumns=True)

    def rate(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if model is None:
            # one block meets here, so one row on the left
            found = right[right["levels"].notna()].sort_values("slice")
            right = right[right["levels"].isna()]
            q = np.concatenate([widen(zlib.decompress(x)) for x in found["levels"]])
        else:
            grams = Slices(*model.value)
        start, size, counts = unpack_answers(right)
        exact = counts[start] if len(counts) else np.zeros(0, np.int64)
        base = np.log10((exact + 1) / (tokens + types + 1))
        out = []
        for ids, lens, marks, blob, dictionary in zip(*(left[c] for c in ("ids", "lens", "marks", "blob", "dictionary")), strict=True):
            keys = unpack_keys(dictionary)
            seq, ends = unpack_seq(blob), np.cumsum(lens)
            if model is None:
                codes = gram_codes(seq, np.asarray(lens), keys, buckets)
                look = lambda g: q[np.searchsorted(codes, code(g, buckets))]  # noqa: B023, E731
            else:
                look = lambda g: levels(grams, g)
            uni = expected(look(mix64(keys)))
            a = 0
            while a < len(lens):
                begin = ends[a] - lens[a]
                b = max(a + 1, int(np.searchsorted(ends, begin + CHUNK, side="right")))
                s, n = seq[begin : ends[b - 1]], np.asarray(lens[a:b])
                cut = np.cumsum(n) - n
                own = log_probs(look, s, n, keys, uni, tokens, types, prior)
                out.append(
                    pd.DataFrame(
                        {
                            "doc_id": list(ids[a:b]),
                            "held_out": ~np.asarray(marks[a:b], bool),
                            "n_tokens": n,
                            "n_known": np.add.reduceat((exact[s] > 0).astype(np.int64), cut),
                            "train_tokens": tokens,
                            "base_score": np.add.reduceat(base[s], cut),
                            "score": np.add.reduceat(own, cut),
                        }
                    )
                )
                a = b
        return pd.concat(out)

    return (
        texts.groupBy("block")
        .cogroup(back.groupBy("block"))
        .applyInPandas(
            rate,
            f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long,"
            " base_score double, score double",
        )
    )


def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Training counts of words that come sorted; each row of a word gets its sum.

    The rows of a word are as many as blocks hold it; those of the last word of
    a batch wait for the next one. Rows without a block carry the totals.
    """
    columns = ["block", *ANSWER, "tokens", "types"]
    rest: pd.DataFrame | None = None

    def answer(df: pd.DataFrame) -> pd.DataFrame:
        w = df["word"].to_numpy()
        head = np.r_[True, w[1:] != w[:-1]]
        at = np.cumsum(head) - 1
        total = np.bincount(at, df["weight"]).astype(np.int64)
        rows = list(pack_answers(df["at"].to_numpy(), np.ones(len(df), np.int64), total[at]))
        rows.append({"tokens": int(total.sum()), "types": int((total > 0).sum())})
        return pd.DataFrame(rows, columns=columns)

    for b in batches:
        df = b if rest is None else pd.concat([rest, b], ignore_index=True)
        w = df["word"].to_numpy()
        cut = int(np.flatnonzero(w != w[-1])[-1]) + 1 if (w != w[-1]).any() else 0
        rest = df.iloc[cut:]
        if cut:
            yield answer(df.iloc[:cut])
    if rest is not None and len(rest):
        yield answer(rest)
