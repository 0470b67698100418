import random

import numpy as np
import pytest

import corpus_pipeline
from shelfwise.llm import embedding_dedup as ed
from shelfwise.llm import ngram_join as nj
from shelfwise.llm.components import components, forest
from tests.llm.brute import edge_docs, find, near_groups, no_docs, shingle_set

D = "/root/testdata/sf0.01"


def check_texts(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.near_duplicates(df).collect()}
    root = near_groups(docs)
    assert got == {i: (len(shingle_set(t)), docs[root[k]][0]) for k, (i, t) in enumerate(docs)}


def test_near_copies_of_all_degrees(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for base in range(25):
        text = random.choices(words, k=random.choice([3, 5, 6, 12, 60, 150]))
        for _ in range(random.choice([1, 2, 8])):
            own = list(text)
            for _ in range(random.choice([0, 0, 1, 2, 4, 9])):
                own[random.randrange(len(own))] = random.choice(words)
            docs.append((len(docs), " ".join(own)))
    check_texts(spark, docs)


def test_common_passage_and_a_large_group(spark, monkeypatch):
    random.seed(6)
    monkeypatch.setattr(nj, "GROUP_DOCS", 50)
    words = [f"w{i}" for i in range(5000)]
    passage = random.choices(words, k=54)
    docs = [(i, " ".join(passage + random.choices(words, k=random.choice([2, 8, 9, 10, 12, 20])))) for i in range(120)]
    base = random.choices(words, k=100)
    for i in range(120, 240):
        own = list(base)
        for _ in range(random.choice([1, 3, 5])):
            own[random.randrange(100)] = random.choice(words)
        docs.append((i, " ".join(own)))
    docs += [(i, docs[130][1]) for i in range(240, 300)]
    check_texts(spark, docs)


def test_chain_has_one_component(spark):
    words = [f"w{i}" for i in range(200)]
    check_texts(spark, [(i, " ".join(words[2 * i : 2 * i + 40])) for i in range(60)])


def test_edge_cases_of_texts(spark):
    rows = nj.near_duplicates(edge_docs(spark)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert len(rows) == 11 and got[1] == {(0, 1)} and got[3] == {(0, 3)} and got[5] == {(2, 5)} and got[6] == {(2, 5)}
    assert got[4] == {(1, 4)} and got[None] == {(1, None)}
    assert nj.near_duplicates(no_docs(spark)).count() == 0
    left = nj.one_row_of_each(edge_docs(spark))
    assert left.columns == edge_docs(spark).columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9]


def test_one_row_of_each_group_stays(spark):
    w = [f"w{i}" for i in range(60)]
    base, near = " ".join(w), " ".join(w[:-1] + ["other"])
    other, third = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    rows = [(5, base), (5, base), (3, near), (5, third), (None, other), (None, other), (7, third), (None, None), (8, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    left = corpus_pipeline.drop_copies(spark, docs, D).collect()
    got = sorted((str(r.doc_id), r.text or "") for r in left)
    assert got == sorted([("3", near), ("5", third), ("None", other), ("None", ""), ("8", ""), ("8", "")])


def test_components_against_union_find(spark):
    random.seed(1)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(330)] + [(1000, i) for i in range(1001, 1300)]
    edges += [(2000 + i, 2001 + i) for i in range(100)] + [(None, 3), (7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in components(df).collect()}
    up = {x: x for e in edges for x in e if x is not None}
    for u, v in edges:
        if u is not None and u != v:
            a, b = find(up, u), find(up, v)
            up[max(a, b)] = min(a, b)
    linked = {x for u, v in edges if u is not None and u != v for x in (u, v)}
    assert got == {x: find(up, x) for x in linked}
    assert components(df.limit(0)).count() == 0
    u, v = np.array([5, 6, 5, 9]), np.array([6, 7, 7, 5])
    assert len(forest(u, v)) == 3


def links(rows, threshold=0.93):
    """n_links, component by position, of (id, vec, label)."""
    def ok(r):
        return r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    n, up = [0] * len(rows), list(range(len(rows)))
    x = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if ok(r) else None for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold:
                n[i], n[j] = n[i] + 1, n[j] + 1
                a, b = find(up, i), find(up, j)
                up[max(a, b)] = min(a, b)
    return n, [find(up, i) for i in range(len(rows))]


@pytest.mark.parametrize("part_rows", [8, 4096])
def test_vectors_against_all_pairs(spark, part_rows):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 64))
    rows = []
    for k in range(900):
        v = base[k % 40 if k % 3 else 0] + rng.choice([0, 0.02, 0.2, 0.26]) * rng.standard_normal(64)
        rows.append((k, v.astype(np.float32).tolist(), int(k % 2)))
    rows += [(k, rows[3][1], rows[3][2]) for k in range(900, 950)]
    rows += [(950, None, 1), (951, [], 1), (952, [0.0] * 64, 1), (953, [float("nan")] * 64, 1), (954, [None] * 64, 1),
             (955, rows[0][1], None), (956, [1.0] * 3, 1), (957, [float("inf")] + [1.0] * 63, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    got = {r.vec_id: r for r in ed.near_duplicates(df, part_rows=part_rows).collect()}
    n, root = links(rows)
    assert len(got) == len(rows)
    found, true = sum(r.n_links for r in got.values()), sum(n)
    assert 0.98 * true <= found <= true
    assert all(got[i].n_links <= k for i, k in enumerate(n))
    assert np.mean([got[i].component_id == r for i, r in enumerate(root)]) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(950, 958))
    assert ed.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    n, root = links(rows)
    assert got == {r[0]: (n[i], rows[root[i]][0]) for i, r in enumerate(rows)}


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    x = ed.unit(rng.standard_normal((4000, 64)))
    y = ed.unit(x + 0.1 * rng.standard_normal((4000, 64)))
    signs, factor, _ = ed.encode(x)
    est, width = ed.estimate(signs, factor, ed.encode(y)[2])
    true = np.einsum("ij,ij->i", x, y)
    assert abs((est - true).mean()) < 0.01
    assert (np.abs(est - true) <= width).mean() > 0.999


@pytest.mark.parametrize("recall", [0.995, 1])
def test_vectors_of_several_lengths(spark, recall):
    """Two lengths in one label, in one batch; with recall 1 all pairs are found."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(240):
        dim = (48, 64, 5)[k % 3]
        base = np.random.default_rng(k % 12).standard_normal(dim)
        rows.append((k, (base + rng.choice([0, 0.1, 0.27]) * rng.standard_normal(dim)).tolist(), int(k % 2)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.near_duplicates(df, recall=recall, part_rows=16).collect()}
    n, root = links(rows)
    if recall == 1:
        assert got == {r[0]: (n[i], rows[root[i]][0]) for i, r in enumerate(rows)}
    else:
        assert 0.98 * sum(n) <= sum(g[0] for g in got.values()) <= sum(n)
