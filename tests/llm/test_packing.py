import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from shelfwise.llm import packing
from tests.llm.brute import edge_docs, no_docs

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def own():
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def ids_of(own, text):
    return [*own.encode(text or "", add_special_tokens=False).ids, 1]


def test_coder_equals_the_library(own):
    coder = packing.Coder(P.path("word_bpe_49k.json"))
    random.seed(9)
    points = [*range(0x250), *range(0x300, 0x310), 0x3A3, 0x130, 0x1680, 0x2028, 0x3000, 0x200B, 0x661, 0x1F600, 0x1E9E]
    pool = [chr(c) for c in points]
    texts = ["".join(random.choice(pool if random.random() < 0.5 else " \n\t\r'sLlaé1 .\x1c\x85") for _ in range(14)) for _ in range(4000)]
    texts += ["<|endoftext|> a<|startoftext|>", "", "  ", "a\x0bb", "'S's 'RE", "é" * 50]
    for t in texts:
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids


def test_long_texts_in_stretches(own, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 50)
    monkeypatch.setattr(packing, "MEMO", 10)
    text = " ".join(f"w{i} q{i % 7}," for i in range(500))
    assert np.frombuffer(packing.Coder(P.path("word_bpe_49k.json")).encode(text), "<u4").tolist() == ids_of(own, text)[:-1]


def check(rows, docs, own, limit=4096):
    """Whole pieces in gapless sequences; returns their number."""
    want = sorted(
        (
            (str(r.doc_id), k, a, struct.pack(f"<{len(part)}I", *part))
            for r in docs.collect()
            for ids in [ids_of(own, r.text)]
            for k, a in enumerate(range(0, len(ids), limit))
            for part in [ids[a : a + limit]]
        ),
        key=repr,
    )
    got = sorted(((str(r.doc_id), r.piece, r.start, bytes(r.ids)) for r in rows), key=repr)
    assert got == want
    assert all(r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in rows)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(by_sequence)


@pytest.mark.parametrize("group_tokens", [1 << 22, 1 << 13])
def test_pack_is_whole_and_tight(spark, own, group_tokens):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    docs = docs.union(edge_docs(spark).select("doc_id", "text"))
    packed = packing.pack(docs, group_tokens=group_tokens)
    rows = packed.collect()
    n = check(rows, docs, own)
    total = sum(r.length for r in rows)
    whole = packing.best_fit(np.array([r.length for r in rows]), 4096)[2]
    assert -(-total // 4096) <= n <= len(whole) * 1.06 + 1  # close to one global best fit
    made = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in rows:
        s = made[r.sequence_id]
        assert bytes(s.ids)[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) and s.length * 4 == len(s.ids)


def test_rounds_of_the_tree_join_what_groups_leave(spark, own):
    docs = spark.range(3000).selectExpr("id doc_id", "repeat('the ', cast(20 + id % 60 as int)) text")
    rows = packing.pack(docs, limit=256, group_tokens=512).collect()
    total = sum(r.length for r in rows)
    groups = -(-total // 512)
    assert groups > packing.FAN**2  # three rounds
    n = check(rows, docs, own, 256)
    assert n <= total / 256 * 1.12


def test_best_fit_leaves_no_two_bins_that_fit():
    rng = np.random.default_rng(2)
    for top in (50, 400, 1000):
        lengths = rng.integers(1, top, 500)
        bins, places, free = packing.best_fit(lengths, 1000)
        fill = np.bincount(bins, lengths, len(free)).astype(int)
        assert (fill + free == 1000).all() and (places >= 0).all()
        low = np.sort(fill)
        assert len(low) < 2 or low[0] + low[1] > 1000
    assert len(packing.best_fit(np.zeros(0, np.int64), 10)[2]) == 0


def test_kept_bins_lose_nothing():
    """Whole bins merged at once or by the emptiest few give the same number."""
    rng = np.random.default_rng(4)
    groups = [packing.best_fit(rng.integers(1, 900, rng.integers(1, 40)), 1000)[2] for _ in range(16)]
    fills = [1000 - g for g in groups]
    whole = len(packing.best_fit(np.concatenate(fills), 1000)[2])
    few = [f[packing.emptiest(g, 16)] for f, g in zip(fills, groups, strict=True)]
    rest = sum(len(f) for f in fills) - sum(len(f) for f in few)
    assert len(packing.best_fit(np.concatenate(few), 1000)[2]) + rest == whole


def test_empty_table(spark):
    assert packing.pack(no_docs(spark)).count() == 0
    assert packing.sequences(packing.pack(no_docs(spark))).count() == 0
