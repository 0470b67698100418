import hashlib
import random
import struct

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from shelfwise.llm import blocks, byte_bpe, lm_scoring
from shelfwise.llm.bloom import of_longs
from shelfwise.llm.secret_scan import load_ranks
from tests.llm.brute import base_scores, edge_docs, no_docs

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def own():
    ranks = load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_cuts_as_the_library(own):
    cut = byte_bpe.splitter(P.PATTERN)
    random.seed(3)
    pool = [chr(c) for c in [*range(0x250), 0x1680, 0x2028, 0x3000, 0x200B, 0x661, 0x2164, 0x4E00, 0x1F600, 0x10400]]
    for _ in range(4000):
        s = "".join(random.choice(pool if random.random() < 0.5 else " \n\t'sa1 .\x1c\x85\xa0") for _ in range(12))
        assert [i for w in cut(s) for i in own.encode_ordinary(w.decode())] == own.encode_ordinary(s)


@pytest.mark.parametrize("block_chars", [3000, 1 << 24])
def test_encoding_equals_the_library(spark, own, block_chars):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    docs = docs.union(edge_docs(spark).select("doc_id", "text"))
    want = sorted(
        ((r.doc_id is None, r.doc_id), tuple(own.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect()
    )
    coded = byte_bpe.encode(docs, decoded=True, block_chars=block_chars).collect()
    got = sorted(((r.doc_id is None, r.doc_id), struct.unpack(f"<{r.n_tokens}I", r.ids), bytes(r.decoded)) for r in coded)
    assert got == want


def test_decode_alone_and_edge_cases(spark, own):
    coded = byte_bpe.encode(edge_docs(spark))
    back = byte_bpe.decode(coded)
    assert back.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    for r in back.collect():
        assert hashlib.sha256(bytes(r.decoded)).digest() and len(r.ids) == 4 * r.n_tokens
    assert byte_bpe.encode(no_docs(spark)).count() == 0
    bad = spark.createDataFrame([(bytearray(b"\xff\xff\xff\x7f"),), (None,)], "ids binary")
    assert byte_bpe.decode(bad.where("ids is null")).collect()[0].decoded is None
    with pytest.raises(Exception, match="without a token"):
        byte_bpe.decode(bad).collect()


def test_block_packing():
    rng = np.random.default_rng(1)
    for top in (1, 200, 70_000, 1 << 25):
        x = rng.integers(0, top, 1000)
        assert (blocks.unpack_seq(blocks.pack_seq(x)) == x).all()
        assert (blocks.widen(blocks.narrow(x)) == x).all()
    assert len(blocks.unpack_seq(blocks.pack_seq(np.zeros(0, np.uint32)))) == 0
    assert list(blocks.runs(np.array([1, 1, 2]))) == [(0, 2), (2, 3)] and not list(blocks.runs(np.zeros(0)))


def test_bloom_never_misses(spark):
    keys = spark.range(20_000).selectExpr("xxhash64(id) k")
    bloom = of_longs(keys, max_bytes=1 << 16)
    own = np.array([r.k for r in keys.collect()], np.int64).view(np.uint64)
    assert bloom.holds(own).all()
    assert len(bloom.bits) <= 1 << 16
    other = np.arange(20_000, dtype=np.uint64) * np.uint64(7919)
    assert bloom.holds(other).mean() < 0.05
    assert not of_longs(keys.limit(0)).holds(other).any()


@pytest.mark.parametrize("block_chars", [5000, 1 << 24])
def test_base_scores(spark, block_chars):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    docs = docs.union(edge_docs(spark).select("doc_id", "text"))
    rows = docs.collect()
    want = sorted((str(r.doc_id), *x) for r, x in zip(rows, base_scores([(r.doc_id, r.text) for r in rows]), strict=True))
    got = sorted(
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
        for r in lm_scoring.score(docs, block_chars=block_chars).collect()
    )
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert all(g[6] <= 0 for g in got)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)  # pairs help on unseen texts
    assert lm_scoring.score(no_docs(spark)).count() == 0


def test_scores_do_not_hang_on_what_is_broadcast(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    docs = docs.union(edge_docs(spark).select("doc_id", "text"))
    rows = lambda **o: sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in lm_scoring.score(docs, block_chars=1 << 18, **o).collect())
    whole, sliced = rows(), rows(max_bytes=1 << 10)
    assert [w[:3] for w in whole] == [s[:3] for s in sliced]
    assert np.allclose([w[3:] for w in whole], [s[3:] for s in sliced], rtol=1e-12)
    assert lm_scoring.score(no_docs(spark), max_bytes=-1).count() == 0


def test_levels_read_back_quantised_counts():
    import pandas as pd

    counts = np.array([1, 2, 3, 10, 1000, 10**6])
    grams = np.arange(1, 7, dtype=np.uint64) * np.uint64(0x123456789ABCDEF)
    where, low = lm_scoring.slot(grams, 1)
    order = np.argsort(low)
    import zlib

    df = pd.DataFrame(
        {
            "bucket": [0],
            "keys": [blocks.pack_seq(np.diff(low[order], prepend=np.uint64(0)))],
            "counts": [zlib.compress(blocks.narrow(counts[order]))],
        }
    )
    row = lm_scoring.fill_slice(1 << 20)(df).iloc[0].to_dict()
    model = lm_scoring.assemble([row], 1)
    q = lm_scoring.levels(model, grams)
    assert (q >= lm_scoring.quantise(counts)).all() and (q <= lm_scoring.quantise(counts) + 1).all()
    near = lm_scoring.expected(lm_scoring.quantise(counts))
    assert ((near / counts < 1.6) & (near / counts > 0.6)).all()
    assert (lm_scoring.levels(model, np.array([99, 98], np.uint64)) == 0).all()
