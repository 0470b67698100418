"""Words of the topics of many parameter sets, counted together.

A document is in one topic of every set. Its distinct words meet the topics of all
sets as arrays: a block of documents gives one row per word, with a (count, topics)
record per document or, for words of many documents, the counts of all topics. These
rows meet by word; only words that can be among the heaviest of a topic leave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.scalars import tokenize
from shelfwise.session import materialize

#: words of a block of documents; rows of a batch that leaves it
BLOCK_TOKENS = 1 << 21
BATCH_ROWS = 1 << 12
#: bytes of the rows that meet in a group, and (word, topic) cells weighed at a time
BUCKET_BYTES = 16 << 20
CELLS = 1 << 20
#: weights are compared to so many digits; those next to the last one kept stay as well
DIGITS = 12
_PACKED = "term string, records binary, counts binary"
_FOUND = "run int, topic int, term string, tf long, f long"


class _Slots:
    """The topics of all sets in a row; ``topics`` holds the ids of each set, ascending."""

    def __init__(self, topics: Sequence[np.ndarray]):
        self.topics = topics
        self.widths = np.array([len(t) for t in topics])
        self.ends = np.cumsum(self.widths)
        self.heads = self.ends - self.widths
        self.record = np.dtype([("tf", "<u4"), ("at", np.min_scalar_type(int(self.widths.max()) - 1), (len(topics),))])

    def places(self, clusters: np.ndarray) -> np.ndarray:
        """Per document and set the place of its topic among those of the set."""
        found = [np.searchsorted(t, clusters[:, r]) for r, t in enumerate(self.topics)]
        return np.stack(found, axis=1).astype(self.record["at"].base)

    def add(self, into: np.ndarray, row: np.ndarray, tf: np.ndarray, at: np.ndarray) -> None:
        """Add counts to the rows of a (rows, topics) table."""
        for r, w in enumerate(self.widths):
            own = np.bincount(row * w + at[:, r], weights=tf, minlength=len(into) * w)
            into[:, self.heads[r] : self.ends[r]] += own.reshape(len(into), w).astype(into.dtype)


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def _content(column: pa.ChunkedArray) -> tuple[bytes, np.ndarray]:
    """(bytes, length of each row) of a binary column without nulls."""
    rows = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1]
    return memoryview(rows.buffers()[2] or b"")[ends[0] : ends[-1]], np.diff(ends)


def _pack(slots: _Slots) -> Callable:
    """(clusters, tokens) -> rows of :data:`_PACKED`; a task's last row has no term and holds
    the number of words in each topic."""
    whole = int(slots.ends[-1])

    def block(tokens: pa.Array, lengths: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, coded = len(lengths), tokens.dictionary_encode()
        doc = np.repeat(np.arange(n, dtype=np.int64), lengths)
        keys, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + doc, return_counts=True)
        term, doc = np.divmod(keys, n)
        met = np.bincount(term, minlength=len(coded.dictionary))
        many = met * slots.record.itemsize > 4 * whole
        few = ~many[term]
        records = np.empty(few.sum(), slots.record)
        records["tf"], records["at"] = tf[few], places[doc[few]]
        counts = np.zeros((many.sum(), whole), "<u4")
        if len(counts):
            slots.add(counts, (np.cumsum(many) - 1)[term[~few]], tf[~few], places[doc[~few]])
        out = pa.RecordBatch.from_arrays(
            [coded.dictionary, _binary(records, np.where(many, 0, met) * slots.record.itemsize), _binary(counts, many * 4 * whole)],
            names=["term", "records", "counts"],
        )
        yield from (out.slice(a, BATCH_ROWS) for a in range(0, out.num_rows, BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros((1, whole))
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, clusters = batch.column("tokens"), batch.column("clusters")
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            tokens, stops = lists.flatten(), np.cumsum(lengths)
            places = slots.places(clusters.flatten().to_numpy().reshape(batch.num_rows, -1))
            slots.add(sizes, np.zeros(batch.num_rows, np.int64), lengths, places)
            cut = np.flatnonzero(np.diff(stops // BLOCK_TOKENS)) + 1
            for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                first = stops[a] - lengths[a]
                if stops[b - 1] > first:
                    yield from block(tokens.slice(first, stops[b - 1] - first), lengths[a:b], places[a:b])
        last = [pa.array([None], pa.string()), pa.array([b""], pa.binary()), pa.array([sizes[0].tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(last, names=["term", "records", "counts"])

    return run


def _heaviest(slots: _Slots, sizes: np.ndarray, means: np.ndarray, top_n: int) -> Callable:
    """All rows of some words -> those that are among the ``top_n`` heaviest of a topic."""
    whole, step = int(slots.ends[-1]), max(1, CELLS // int(slots.ends[-1]))
    safe = np.maximum(sizes, 1.0)

    def run(table: pa.Table) -> pa.Table:
        coded = pa.concat_arrays(table.column("term").chunks).dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
        data, lengths = _content(table.column("records"))
        records, of = np.frombuffer(data, slots.record), np.repeat(code, lengths // slots.record.itemsize)
        data, lengths = _content(table.column("counts"))
        dense, dense_of = np.frombuffer(data, "<u4").reshape(-1, whole), code[lengths > 0]
        order = np.argsort(of, kind="stable")
        records, of = records[order], of[order]
        least, found = np.zeros(whole), []
        for a in range(0, len(words), step):
            b = min(a + step, len(words))
            own, counts = slice(*np.searchsorted(of, [a, b])), np.zeros((b - a, whole))
            slots.add(counts, of[own] - a, records["tf"][own], records["at"][own])
            for i in np.flatnonzero((dense_of >= a) & (dense_of < b)):
                counts[dense_of[i] - a] += dense[i]
            total = counts[:, : slots.ends[0]].sum(1)
            weight = np.round(counts / safe * np.log(1 + means / total[:, None]), DIGITS)
            if b - a > top_n:
                least = np.maximum(least, np.partition(weight, -top_n, axis=0)[-top_n])
            row, col = np.nonzero((counts > 0) & (weight >= least - 1.5 * 10.0**-DIGITS))
            found.append((row + a, col, weight[row, col], counts[row, col], total[row]))
        term, col, weight, tf, total = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort([rank[term], -weight, col])
        term, col, weight, tf, total = (x[order] for x in (term, col, weight, tf, total))
        first = np.searchsorted(col, col)
        last = weight[np.minimum(first + top_n, np.searchsorted(col, col, side="right")) - 1]
        # a weight next to the last one may be the other side of it in other arithmetic
        keep = (np.arange(len(col)) < first + top_n) | ((weight != last) & (weight > last - 1.5 * 10.0**-DIGITS))
        run_of = np.repeat(np.arange(len(slots.widths)), slots.widths)
        topics = np.concatenate(slots.topics)
        col, term = col[keep], term[keep]
        columns = [run_of[col].astype(np.int32), topics[col].astype(np.int32), words.take(pa.array(term))]
        columns += [tf[keep].astype(np.int64), total[keep].astype(np.int64)]
        return pa.table(dict(zip(("run", "topic", "term", "tf", "f"), columns, strict=True)))

    return run


def leading_terms(
    docs: DataFrame, text: str, assigned: DataFrame, topics: Sequence[np.ndarray], key: str, top_n: int
) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """((run, topic, term, tf, f), [(run, topic, words)]): counts in the topic and in all
    of the words that can be among the ``top_n`` heaviest of a topic by
    :func:`topics.weigh_terms`, and the words of each topic.

    ``assigned``: (key, clusters), the topic of each document under every run;
    ``topics``: the ids found in each run, ascending.
    """
    slots = _Slots(topics)
    tokens = docs.join(assigned, key).select("clusters", tokenize(text).alias("tokens"))
    packed = materialize(tokens.mapInArrow(_pack(slots), _PACKED), "topicterms")
    last = packed.filter("term is null").select("counts").collect()  # a row per task
    sizes = np.sum([np.frombuffer(r["counts"]) for r in last], axis=0)
    # topics without words do not count
    means = [(s := sizes[a:b]).sum() / max(np.count_nonzero(s), 1) for a, b in zip(slots.heads, slots.ends, strict=True)]
    size = int(str(packed._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    slots_of_spark = docs.sparkSession.sparkContext.defaultParallelism
    buckets = max(min(2 * slots_of_spark, 1 + (size >> 20)), size // BUCKET_BYTES)
    words = packed.filter("term is not null").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    run = _heaviest(slots, sizes, np.repeat(means, slots.widths), top_n)
    found = words.groupBy("bucket").applyInArrow(lambda t: run(t.select(["term", "records", "counts"])), _FOUND)
    run_of = np.repeat(np.arange(len(slots.widths)), slots.widths)
    at = [(int(r), int(t), int(n)) for r, t, n in zip(run_of, np.concatenate(topics), sizes, strict=True) if n]
    return materialize(found, "leading"), at
