import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfwise.llm import collocations as co
from tests.llm.brute import edge_docs, no_docs


def plain(docs, least=30, inside=80, top=2000):
    """The contract by counting every phrase, from [(lang, text)]."""
    f = defaultdict(Counter)
    for lang, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 5):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        many = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        over = Counter()
        for p, c in many.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    over[p[i : i + k]] = max(over[p[i : i + k]], c)
        rows = []
        for p, a in many.items():
            if 100 * over[p] < inside * a:
                score, k = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def mined(docs, **o):
    return sorted(tuple(r) for r in co.mine(docs, **o).collect())


def prose(n, seed, pool=40):
    """Texts with repeated passages, a very common pair, ends and odd characters."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(pool)] + ["É", "É", "naïve", "x\x0by", "a\tb", "\x00", "\xa0", "İx"]
    passage = [rng.choice(vocab) for _ in range(30)]
    out = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(60)):
            u = rng.random()
            w += passage[:] if u < 0.02 else ["spam", "spam", rng.choice(vocab)] if u < 0.3 else ["of", "the"] if u < 0.5 else [rng.choice(vocab)]
            if rng.random() < 0.15:
                w.append(rng.choice([".", ",", "!\n", ";", "?", ":", "\r"]))
        out.append((i, rng.choice(["en", "de", None, "und"]), " ".join(w)))
    return out


@pytest.mark.parametrize(("least", "block_chars", "batch", "top"), [(3, 2000, 7, 2000), (5, 1 << 24, 10_000, 15), (30, 5000, 100, 2000)])
def test_equals_counting_every_phrase(spark, least, block_chars, batch, top):
    rows = prose(150, least)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        got = mined(docs, least=least, block_chars=block_chars, top=top)
    finally:
        spark.conf.set(key, before)
    assert got == plain([(r[1], r[2]) for r in rows], least, top=top)
    assert got


def test_edges_and_empty(spark):
    docs = edge_docs(spark)
    rows = docs.collect()
    assert mined(docs, least=2) == plain([(r.lang, r.text) for r in rows], 2)
    assert mined(docs) == plain([(r.lang, r.text) for r in rows])
    assert mined(no_docs(spark)) == []


def test_ties_rank_by_bytes(spark):
    rows = [(i, "en", f"{c}{c} {c}z") for c in ["b", "a", "é", "😀", "z", "￿"] for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = mined(docs, least=3, top=4)
    assert got == plain([(r[1], r[2]) for r in rows], 3, top=4) and len(got) == 4


def test_common_words_are_dealt_to_many_parts():
    rng = np.random.default_rng(3)
    follower = rng.integers(1, 1 << 20, 5000).astype(np.uint64) * np.uint64(16)
    hot = np.full(5000, 16 | 8, np.uint64)  # level 8: up to 256 places
    for g, most in (([hot, hot, hot, follower], 300), ([hot, hot, follower, follower], 300), ([hot, follower, hot, hot], 300)):
        hi, lo = g[0] << np.uint64(32) | g[1], g[2] << np.uint64(32) | g[3]
        assert np.bincount(co.home(hi, lo, 64)).max() < most
    warm = np.full(5000, 32 | 1, np.uint64)  # level 1: two places at most
    assert len(set(co.home(hot << np.uint64(32) | warm, follower << np.uint64(32) | follower, 64))) == 2
    hi = np.full(5000, (16 | 8) << 32 | 32, np.uint64)  # a pair that is not all common words stays whole
    assert len(set(co.home(hi, follower << np.uint64(32), 64))) == 1
    node = np.full(5000, follower[0], np.uint64)  # so does a node with one rare word
    assert len(set(co.home(hot << np.uint64(32) | hot, node << np.uint64(32) | follower, 64))) == 1


def test_edges_pack_and_flow():
    w = {k: k * 16 for k in range(12)}
    g = np.array([w[k] for k in (2, 4, 6, 8, 0, 2, 4, 6, 8, 0, 2, 4, 0, 6, 0)], np.uint64)
    hi, lo, n = co.edges(g)
    back = co.unpack(co.pack(hi, lo, n), len(hi))
    assert all((x == y).all() for x, y in zip(back, (hi, lo, n), strict=True))

    def key(*k):
        k = [*(w.get(x, x) for x in k), 0, 0]
        return k[0] << 32 | k[1], k[2] << 32 | k[3]

    assert dict(zip(zip(hi.tolist(), lo.tolist(), strict=True), n.tolist(), strict=True)) == {
        key(2, 4, 6, 8): 2, key(4, 6, 8): 2, key(6, 8): 2, key(2, 4): 1,
    }
    # pair and node are one path; a pair of words that are both common is part of a sum
    hot, warm = 5 * 16 + 1, 7 * 16 + 3
    edges = {key(4, 6, 8): 2, key(4, 6, 8, 10): 5, key(hot, warm, 2): 3, key(hot, warm, 9 * 16 + 2, 4): 4}
    hi, lo = (np.array(x, np.uint64) for x in zip(*sorted(edges), strict=True))
    c = np.array([edges[k] for k in sorted(edges)])
    rows = set(zip(*[x.tolist() for x in co.flows(hi, lo, c, 1)], strict=True))
    third = 9 * 16 + 2
    assert rows == {
        (*key(4, 6, 8), 7, 2, True), (*key(4, 6, 8, 10), 5, 4, True), (*key(hot, warm), 7, 2, False),
        (*key(hot, warm, 2), 3, 3, True), (*key(hot, warm, third), 4, 3, False), (*key(hot, warm, third, 4), 4, 4, True),
    }
