"""Exact Jaccard self-join of shingle sets under several global token orders.

A pair with Jaccard 3/4 or more shares a token of its prefixes under every total
order of tokens. The steps, each written to the shared folder:

1. Sets are hashed; copies become one class. Under a first order (hash order)
   the tokens of a longer prefix are matched between classes, packed in buckets
   per group of documents; a class stays only if it shares as many as any
   partner would need. Nearly all documents without a near copy end here.
2. For the classes that stay, document frequencies of their tokens (again one
   entry per group and token) give further orders: rarest first, ties by
   different hashes.
3. Candidates share a token of their prefixes under the first of these orders
   (each as long as the sizes of both leave room for the overlap they need), and
   must do so under the others before the sets are compared. To keep a group of thousands of near
   copies from making all its pairs, each class is first compared with one
   leader of its groups; after that only pairs between different components
   found so far are candidates, which loses no component.

Shingles are 64-bit hashes of five words; classes are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.blocks import runs
from shelfwise.llm.bloom import Slices, mix64, of_longs
from shelfwise.llm.components import components
from shelfwise.llm.rows import fresh, tidy, with_row
from shelfwise.session import materialize, release

WORDS = 5
ORDERS = 3
GROUP_DOCS = 1 << 14
GROUP_TOKENS = 1 << 20
FLAG = np.uint16(65535)
MEMO = 1 << 19
BUCKETS_PER_PARTITION = 4
STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def shingles(text: str | None, memo: WordHash, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``words`` words, A-Z lower-cased.

    With fewer words the whole sequence is one; null, empty or blank: none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    k = min(words, len(h))
    acc = mix64(h[: len(h) - k + 1] + np.uint64(k))
    for i in range(1, k):
        acc = acc * STEP + h[i : len(h) - k + 1 + i]
        acc ^= acc >> np.uint64(32)
    acc = np.sort(mix64(acc))
    return acc[np.r_[True, acc[1:] != acc[:-1]]]


def probe_length(n):
    """Tokens of a set that any partner, longer or shorter, must meet."""
    return n - (3 * n + 3) // 4 + 1


def overlap(a, b):
    """Common tokens that sets of these sizes need for a link."""
    return (3 * (a + b) + 6) // 7


def needed(n):
    """Shared tokens asked for in the first order's prefix, longer by as many less one."""
    return np.maximum(1, n // 12)


def _class_of(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
    )


@tidy
def _first_order(batches: Iterator[pa.RecordBatch], schema: pa.Schema, buckets: int) -> Iterator[pa.RecordBatch]:
    """Document rows, and per bucket the prefix tokens of the group's classes."""
    memo = WordHash()
    part = TaskContext.get().partitionId()
    made, ids, classes, sizes, first, tokens, owners, held = 0, [], [], [], {}, [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        block = (part << 32) | made
        known = np.zeros(len(ids), np.int64)
        rows = []
        if tokens:
            t = np.concatenate(tokens)
            own = np.repeat(np.array(owners, np.uint16), [len(x) for x in tokens])
            order = np.argsort(t, kind="stable")
            t, own = t[order], own[order]
            head = np.r_[True, t[1:] != t[:-1]]
            run = np.diff(np.r_[np.flatnonzero(head), len(t)])
            many = np.repeat(run > 1, run)
            np.add.at(known, own[many].astype(np.int64), 1)
            keep = head  # a token shared inside the group is sent once, marked
            t, own = t[keep], np.where(many[keep], FLAG, own[keep])
            where = ((t >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(buckets + 1))
            for k in range(buckets):
                i = order[cuts[k] : cuts[k + 1]]
                if len(i):
                    rows.append((k, (t[i] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), own[i].tobytes()))
        n = len(ids)
        # a copy inside the group stands with the first of its class
        yield _batch(
            schema, block=np.full(n, block), ord=np.array([first[c] for c in classes]), id=ids, cls=classes, n=sizes,
            known=known[[first[c] for c in classes]],
        )
        if rows:
            yield _batch(
                schema, block=np.full(len(rows), block), bucket=[r[0] for r in rows], keys=[r[1] for r in rows],
                owners=[r[2] for r in rows],
            )

    for b in batches:
        for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            s = shingles(text.as_py(), memo)
            c = _class_of(s)
            if c not in first:
                first[c] = len(ids)
                n = len(s)
                if n:
                    tokens.append(s[: min(n, probe_length(n) + int(needed(n)) - 1)])
                    owners.append(len(ids))
                    held += len(tokens[-1])
            ids.append(i)
            classes.append(c)
            sizes.append(len(s))
            if len(ids) >= GROUP_DOCS or held >= GROUP_TOKENS:
                yield from flush()
                made, ids, classes, sizes, first, tokens, owners, held = made + 1, [], [], [], {}, [], [], 0
    if ids:
        yield from flush()


@tidy
def _match_bucket(df: pd.DataFrame) -> pd.DataFrame:
    """Per group, its documents whose tokens occur in another place, with counts."""
    keys = [np.frombuffer(x, np.uint32) for x in df["keys"]]
    own = np.concatenate([np.frombuffer(x, np.uint16) for x in df["owners"]])
    group = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
    t = np.concatenate(keys)
    order = np.argsort(t, kind="stable")
    t = t[order]
    run = np.diff(np.r_[np.flatnonzero(np.r_[True, t[1:] != t[:-1]]), len(t)])
    shared = np.repeat(run > 1, run)
    i = order[shared]
    i = i[own[i] != FLAG]
    pairs, count = np.unique(group[i] << 16 | own[i], return_counts=True)
    g = pairs >> 16
    block = df["block"].to_numpy()
    return pd.DataFrame(
        [
            (block[g[a]], (pairs[a:b] & 0xFFFF).astype(np.uint16).tobytes(), count[a:b].astype(np.uint32).tobytes())
            for a, b in runs(g)
        ],
        columns=["block", "owners", "counts"],
    )


@tidy
def _survivors(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Classes of a group that share enough tokens."""
    total = np.zeros(GROUP_DOCS + 1, np.int64)
    for o, c in zip(right["owners"], right["counts"], strict=True):
        np.add.at(total, np.frombuffer(o, np.uint16).astype(np.int64), np.frombuffer(c, np.uint32))
    n = left["n"].to_numpy()
    stay = (n > 0) & (left["known"].to_numpy() + total[left["ord"].to_numpy()] >= needed(n))
    return pd.DataFrame({"cls": left["cls"][stay].drop_duplicates()})


@tidy
def _sets(batches: Iterator[pa.RecordBatch], schema: pa.Schema, members) -> Iterator[pa.RecordBatch]:
    """(cls, n, set) of the documents whose key may be a member's, once per batch."""
    memo, known = WordHash(), Slices(*members.value)
    for b in batches:
        hit = known.holds(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        out: dict[bytes, np.ndarray] = {}
        for k in np.flatnonzero(hit):
            s = shingles(b.column(1)[int(k)].as_py(), memo)
            if len(s):
                out[_class_of(s)] = s
        if out:
            yield _batch(
                schema, cls=list(out), n=[len(s) for s in out.values()], set=[s.tobytes() for s in out.values()]
            )


def _pack_sets(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sets that come sorted by class, each class once, with a group number."""
    part, made, held, last = TaskContext.get().partitionId(), 0, 0, None
    for b in batches:
        rows = []
        for c, n, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if c != last:
                rows.append(((part << 32) | made, int.from_bytes(c[:8], "little", signed=True), n, s, c))
                held += n
                last = c
                if held >= GROUP_TOKENS:
                    made, held = made + 1, 0
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
            )


def _group_tokens(buckets: int):
    @tidy
    def run(df: pd.DataFrame) -> pd.DataFrame:
        t, c = np.unique(np.frombuffer(b"".join(df["set"]), np.uint64), return_counts=True)
        where = ((t >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(buckets + 1))
        block = int(df["block"].iloc[0])
        return pd.DataFrame(
            [
                (k, block, t[i].tobytes(), c[i].astype(np.uint32).tobytes())
                for k in range(buckets)
                if len(i := order[cuts[k] : cuts[k + 1]])
            ],
            columns=["bucket", "block", "keys", "counts"],
        )

    return run


@tidy
def _frequencies(df: pd.DataFrame) -> pd.DataFrame:
    """Per group, its tokens that occur in two classes or more, with how many."""
    keys = [np.frombuffer(x, np.uint64) for x in df["keys"]]
    t = np.concatenate(keys)
    c = np.concatenate([np.frombuffer(x, np.uint32) for x in df["counts"]])
    _, at = np.unique(t, return_inverse=True)
    total = np.bincount(at, c).astype(np.uint32)[at]
    rows, a = [], 0
    for block, k in zip(df["block"], keys, strict=True):
        f = total[a : a + len(k)]
        a += len(k)
        if (f > 1).any():
            rows.append((block, k[f > 1].tobytes(), f[f > 1].tobytes()))
    return pd.DataFrame(rows, columns=["block", "keys", "counts"])


PREFIX_SCHEMA = (
    "node long, cls binary, n long, set binary, alone int, weight double, "
    + ", ".join(f"p{k} array<long>" for k in range(1, ORDERS + 1))
)


@tidy
def _prefixes(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Prefixes of a group's sets under each order, without tokens of one class.

    Rare tokens come first, so those of a single class (which match nothing)
    fill the head of the prefix; only what is left of its length is returned.
    """
    t = np.frombuffer(b"".join(right["keys"]), np.uint64)
    f = np.frombuffer(b"".join(right["counts"]), np.uint32)
    order = np.argsort(t, kind="stable")
    t, f = t[order], f[order]
    rows = []
    for node, cls, n, blob in zip(left["node"], left["cls"], left["n"], left["set"], strict=True):
        s = np.frombuffer(blob, np.uint64)
        at = np.searchsorted(t, s)
        hit = at < len(t)
        hit[hit] = t[at[hit]] == s[hit]
        shared, df = s[hit], f[at[hit]]
        alone = n - len(shared)
        probe = probe_length(n) - alone
        if probe <= 0:
            continue
        parts = [
            shared[np.lexsort((mix64(shared ^ np.uint64(k)), df))[:probe]].view(np.int64) for k in range(1, ORDERS + 1)
        ]
        rows.append((node, cls, n, blob, alone, np.log2(df).sum() / n, *parts))
    return pd.DataFrame(rows, columns=["node", "cls", "n", "set", "alone", "weight"] + [f"p{k}" for k in range(1, ORDERS + 1)])


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes meet under all orders and whose sets are alike."""
    keep = ["n", "set", "alone", *[f"p{k}" for k in range(2, ORDERS + 1)]]
    side = lambda x: sets.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in keep])
    rows = pairs.join(side("a"), "a").join(side("b"), "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yes = np.zeros(len(df), bool)
            for i, r in enumerate(df.itertuples(index=False)):
                least = overlap(r.a_n, r.b_n)
                x, y = max(0, r.a_n - least + 1 - r.a_alone), max(0, r.b_n - least + 1 - r.b_alone)
                if all(
                    len(np.intersect1d(getattr(r, f"a_p{k}")[:x], getattr(r, f"b_p{k}")[:y])) for k in range(2, ORDERS + 1)
                ):
                    x, y = np.frombuffer(r.a_set, np.uint64), np.frombuffer(r.b_set, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    yes[i] = 100 * both >= 75 * (len(x) + len(y) - both)
            yield df.loc[yes, ["a", "b"]]

    return rows.mapInPandas(check, "a long, b long")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: id, cls, n) and (links between classes: u, v), both written.

    The links span every component of the classes with Jaccard 3/4 or more; not
    every link inside a component is listed.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    schema = f"block long, ord long, id {kind.simpleString()}, cls binary, n long, known long, bucket long, keys binary, owners binary"
    arrow = _arrow(schema)
    first = materialize(rows.mapInArrow(lambda b: _first_order(b, arrow, buckets), schema), "ngram-first")
    members = first.where("cls is not null").select("id", "cls", "n")
    matched = (
        first.where("keys is not null").select("bucket", "block", "keys", "owners")
        .groupBy("bucket").applyInPandas(_match_bucket, "block long, owners binary, counts binary")
    )
    grouped = first.where("cls is not null").select("block", "ord", "cls", "n", "known").groupBy("block")
    stay = grouped.cogroup(matched.groupBy("block")).applyInPandas(_survivors, "cls binary").distinct()
    chosen = members.groupBy("cls").agg(F.min("id").alias("id")).join(stay, "cls", "left_semi")
    chosen = materialize(chosen.select(F.xxhash64("id").alias("key")), "ngram-chosen")
    documents = materialize(members, "ngram-docs")
    release(first)
    bloom = sc.broadcast(of_longs(chosen).plain())

    arrow_sets, set_schema = _arrow("cls binary, n long, set binary"), "cls binary, n long, set binary"
    keyed = rows.select(F.xxhash64("id").alias("key"), "text")
    sets = keyed.mapInArrow(lambda b: _sets(b, arrow_sets, bloom), set_schema)
    pack_schema = "block long, node long, n long, set binary, cls binary"
    arrow_pack = _arrow(pack_schema)
    packed = materialize(
        sets.repartition("cls").sortWithinPartitions("cls").mapInArrow(lambda b: _pack_sets(b, arrow_pack), pack_schema),
        "ngram-sets",
    )
    by_bucket = packed.select("block", "set").groupBy("block").applyInPandas(
        _group_tokens(buckets), "bucket long, block long, keys binary, counts binary"
    )
    known = by_bucket.groupBy("bucket").applyInPandas(_frequencies, "block long, keys binary, counts binary")
    prefixes = materialize(
        packed.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(_prefixes, PREFIX_SCHEMA), "ngram-prefixes"
    )
    release(packed)

    tokens = prefixes.select("node", "n", "weight", "alone", F.posexplode("p1").alias("pos", "t"))
    # every class with the leader of most of its groups
    lead = tokens.groupBy("t").agg(F.max_by("node", F.struct("weight", "node")).alias("leader"), F.count("*").alias("c"))
    led = tokens.join(lead.where("c > 1"), "t").where("node <> leader").groupBy("node", "leader").count()
    star = led.groupBy("node").agg(F.max_by("leader", F.struct("count", "leader")).alias("leader"))
    links = materialize(_linked(star.select(F.col("node").alias("a"), F.col("leader").alias("b")), prefixes), "ngram-stars")
    roots = materialize(components(links.toDF("u", "v")), "ngram-roots")

    # pairs between components: of each token, the members outside its largest component against all others
    tagged = (
        tokens.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        .select("t", "node", "n", "root", (F.col("pos") + F.col("alone")).alias("at"))
    )
    sizes = tagged.groupBy("t", "root").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("t").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots"))
    mixed = mixed.where("roots > 1").select("t", "main")
    open_ = materialize(tagged.join(mixed, "t"), "ngram-open")
    columns = ("node", "n", "root", "at")
    x = open_.where("root <> main").select("t", *[F.col(c).alias("x_" + c) for c in columns])
    y = open_.select("t", *[F.col(c).alias("y_" + c) for c in columns])
    # the first token two sets share leaves behind it, in both, at least the overlap they need
    least = F.floor((3 * (F.col("x_n") + F.col("y_n")) + 6) / 7)
    rule = (
        (F.col("x_root") != F.col("y_root"))
        & (F.col("x_at") <= F.col("x_n") - least)
        & (F.col("y_at") <= F.col("y_n") - least)
    )
    across = (
        x.join(y, "t").where(rule)
        .select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    )
    links = links.union(_linked(across, prefixes)).toDF("u", "v")
    named = prefixes.select(F.col("node"), F.col("cls"))
    return documents, links.join(named.toDF("u", "cu"), "u").join(named.toDF("v", "cv"), "v").select(
        F.col("cu").alias("u"), F.col("cv").alias("v")
    )


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Defined cases: null, empty and blank texts have no shingles and each row is
    its own component; a null id is never the smallest unless all ids of a
    component are null (then component_id is null); an id that occurs on rows
    with different texts joins none of them by itself; equal rows are copies;
    other columns are ignored; an empty table gives no rows.
    """
    rows = _grouped(docs, id_col, text_col)
    least = rows.where("n > 0").groupBy("root").agg(F.min("id").alias("component_id"))
    some = rows.where("n > 0").join(least, "root").select("id", "n", "component_id")
    none = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return some.union(none).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per input row: id, n and the root class of its component."""
    documents, links = similar_classes(docs, id_col, text_col)
    roots = materialize(components(links), "ngram-roots")
    return documents.join(roots, documents["cls"] == roots["node"], "left").select(
        "id", "n", F.coalesce("root", "cls").alias("root")
    )


def one_row_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: of the rows with the smallest id
    (null last) the one that lies first.

    Rows are told apart by their place in the files (or a numbered copy), so
    repeated rows, repeated and null ids are, too. Documents without shingles stay.
    """
    numbered, row = with_row(docs)
    key = F.struct(F.col(id_col).isNull().alias("late"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    name = fresh("_key", [*docs.columns, row])
    rows = _grouped(numbered.select(key.alias(name), text_col), name, text_col).where("n > 0")
    rows = materialize(rows.select(F.col("id").alias("key"), "root"), "ngram-components")
    first = rows.groupBy("root").agg(F.min("key").alias("first"))
    gone = rows.join(first, "root").where("key.row <> first.row").select(F.col("key.row").alias(row))
    gone = materialize(gone, "ngram-gone")
    return numbered.join(gone, row, "left_anti").select(*docs.columns)
