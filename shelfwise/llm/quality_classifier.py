"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed once per document where it is read and written as a
narrow table. The trees are grown on a bounded sample of labelled rows, by
histograms of binned features, and flattened into arrays of complete trees;
scoring walks all rows of a batch through one level of a tree at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.bloom import mix64
from shelfwise.session import materialize

MAX_TRAIN_ROWS = 40_000
PARTS, HELD_PART = 4, 2
CUTOFF = 0.7

FEATURES = (
    "log_words", "word_length", "long_words", "upper", "digits", "symbols", "exclaims", "punctuation", "spaces",
    "wide", "log_lines", "words_per_line", "dup_lines", "distinct_words", "top_word", "distinct_triples",
    "capital_words", "byte_entropy",
)


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256)
    m[list(chars)] = 1
    return m


MASKS = np.stack(
    [
        _mask(bytes(range(65, 91))),
        _mask(b"0123456789"),
        _mask(b"#*$%&|<>"),
        _mask(b"!"),
        _mask(b".,;:?'\"()-"),
        _mask(b" \t\n\x0b\x0c\r"),
        _mask(bytes(range(128, 256))),
    ],
    axis=1,
)
STEP = np.uint64(0x9E3779B97F4A7C15)


def statistics(text: str | None) -> np.ndarray:
    """The features of one text; a null, empty or blank text has zeros where a
    ratio has no base."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(FEATURES))
    if not raw:
        return out
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = hist[hist > 0] / len(raw)
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[3:10] = hist @ MASKS / len(raw)
    out[10] = np.log1p(len(lines))
    out[17] = -(p * np.log2(p)).sum()
    if n:
        size = np.fromiter(map(len, words), np.int64, n)
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        _, times = np.unique(h, return_counts=True)
        out[0], out[1], out[2] = np.log1p(n), size.mean(), (size > 12).mean()
        out[11], out[12] = n / len(lines), 1 - len(set(lines)) / len(lines)
        out[13], out[14] = len(times) / n, times.max() / n
        triples = mix64(mix64(h[:-2] * STEP + h[1:-1]) * STEP + h[2:]) if n > 2 else h[:1]
        out[15] = len(np.unique(triples)) / len(triples)
        out[16] = sum(65 <= w[0] <= 90 for w in words) / n
    return out


def statistics_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written table: doc_id and one float column per feature."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([statistics(t) for t in b["text"]]).reshape(-1, len(FEATURES)).astype(np.float32)
            yield pd.concat([b[["doc_id"]], pd.DataFrame(x, columns=list(FEATURES), index=b.index)], axis=1)

    schema = f"doc_id {kind}, " + ", ".join(f"{f} float" for f in FEATURES)
    return materialize(rows.mapInPandas(run, schema), "quality-statistics")


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: node i has the children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes); infinite where a node was not split
    leaf: np.ndarray  # (trees, leaves)
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - (leaf.shape[0] - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
    ridge: float = 1.0, least: float = 2.0,
) -> Trees:
    """Newton boosting of the logistic loss on binned features.

    With no rows the score is 1/2 everywhere; with one class it is the smoothed
    share of that class.
    """
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(share / (1 - share)))
    feature = np.zeros((rounds, inner), np.int64)
    threshold = np.full((rounds, inner), np.inf, np.float32)
    leaf = np.zeros((rounds, leaves))
    if not len(y) or y.min() == y.max():
        return Trees(feature[:0], threshold[:0], leaf[:0], prior)
    x = x.astype(np.float32)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)], axis=1)
    margin = np.full(len(y), prior)
    for r in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for d in range(depth):
            first, width = 2**d - 1, 2**d
            best = np.full(width, 1e-6)
            where = [(0, np.inf)] * width
            total_g, total_h = np.bincount(node - first, g, width), np.bincount(node - first, h, width)
            base = total_g**2 / (total_h + ridge)
            for j in range(x.shape[1]):
                if not len(cuts[j]):
                    continue
                at = (node - first) * bins + binned[:, j]
                gl = np.bincount(at, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hl = np.bincount(at, h, width * bins).reshape(width, bins).cumsum(axis=1)
                gr, hr = total_g[:, None] - gl, total_h[:, None] - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - base[:, None]
                gain[(hl < least) | (hr < least)] = 0
                k = gain[:, : len(cuts[j])].argmax(axis=1)
                top = gain[np.arange(width), k]
                for i in np.flatnonzero(top > best):
                    best[i], where[i] = top[i], (j, cuts[j][k[i]])
            for i, (j, t) in enumerate(where):
                feature[r, first + i], threshold[r, first + i] = j, t
            go = x[np.arange(len(x)), feature[r, node]] > threshold[r, node]
            node = 2 * node + 1 + go
        at = node - inner
        leaf[r] = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        margin += leaf[r][at]
    return Trees(feature, threshold, leaf, prior)


def held_out(id_col: str = "doc_id"):
    """Rows of which no label is learned; a null id is one of the others."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % PARTS == HELD_PART, F.lit(False))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_rows: int = MAX_TRAIN_ROWS,
) -> DataFrame:
    """One row per input row: doc_id, the features, held_out, score, predicted.

    At most about ``max_rows`` labelled rows, chosen by a hash of their id, are
    learned from (the documented bound of the sample); all rows are scored.

    Defined cases: a null text counts as empty and is scored like any other; a
    null label or id teaches nothing; of several labels of one id the lowest
    counts; repeated rows are scored each; without labels every score is 1/2;
    an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    table = statistics_table(docs, id_col, text_col)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("y"))
    known = known.where(~held_out("doc_id"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    sample = table.join(known, "doc_id").select("doc_id", *FEATURES, "y").toArrow().to_pandas()
    sample = sample.sort_values(["doc_id", *FEATURES])  # reruns meet the rows in one order
    grown = fit(sample[list(FEATURES)].to_numpy(), (sample["y"] > 0).to_numpy().astype(float))
    plain = spark.sparkContext.broadcast((grown.feature, grown.threshold, grown.leaf, grown.prior))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = Trees(*plain.value)
        for b in batches:
            b["score"] = trees.score(b[list(FEATURES)].to_numpy(np.float32))
            b["predicted"] = (b["score"] >= CUTOFF).astype(np.int32)
            yield b

    marked = table.withColumn("held_out", held_out())
    return marked.mapInPandas(run, marked.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)
