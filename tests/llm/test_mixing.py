import numpy as np

from shelfwise.llm import source_mixing as sm
from tests.llm.brute import WORD, edge_docs, no_docs

D = "/root/testdata/sf0.01"


def test_targets_by_weight_with_a_stop():
    src = [sm.Source("b", 1, 100), sm.Source("a", 1, 10), sm.Source(None, 1, 1000), sm.Source("c", 1, 50)]
    goal = sm.targets(src)
    assert goal["a"] == 20 and abs(sum(goal.values()) - 1.5 * 1160) < 1e-6
    assert all(goal[s.name] <= 2 * s.words for s in src)
    assert sm.targets([sm.Source("x", 3, 0)]) == {"x": 0}
    assert sm.targets([]) == {}


def test_splitting_tree_keeps_quotas():
    quotas = np.array([1000, 0, 1, 37, 500])
    for shards in (1, 2, 7, 64):
        parts = sm.split_quotas(quotas, shards, 5)
        assert (parts.sum(axis=0) == quotas).all() and (parts >= 0).all()
        assert parts.sum(axis=1).max() - parts.sum(axis=1).min() <= shards.bit_length() + 1
    assert (sm.split_quotas(quotas, 7, 5) == sm.split_quotas(quotas, 7, 5)).all()


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = sm.mix_plan(docs, shards=8).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    total = {}
    for r in rows:
        assert r.size == len(WORD.findall(texts[r._id] or ""))
        assert len(r.draws) <= 2 and len({d["pass"] for d in r.draws}) == len(r.draws)
        t = total.setdefault(r.source, [0, r.target, r.source_size, 0, 0])
        t[0] += r.size * len(r.draws)
        t[3] += r.size
        t[4] = max(t[4], r.size)
    for got, target, size, own, largest in total.values():
        assert size == own and abs(got - target) <= largest
    again = {r._id: sorted(map(tuple, r.draws)) for r in sm.mix_plan(docs.repartition(5), shards=8).collect()}
    assert again == {r._id: sorted(map(tuple, r.draws)) for r in rows}


def test_mixed_rows_and_local_shuffle(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    plan = sm.mix_plan(docs, shards=4)
    out = sm.mix(docs, shards=4)
    assert out.columns == [*docs.columns, "_shard", "_place"]
    want = sorted((r._id, d["shard"]) for r in plan.collect() for d in r.draws)
    taken = lambda df: sorted((r.doc_id, r._shard) for r in df.select("doc_id", "_shard").collect())
    assert taken(out) == want
    # rows spread in another way are numbered anew, but the same are taken
    assert taken(sm.mix(docs.repartition(5), shards=4)) == want
    parts = sm.shuffled_shards(out).select("_shard", "_place").rdd.glom().collect()
    for p in parts:
        assert p == sorted(p)


def test_edge_cases(spark):
    rows = sm.mix_plan(edge_docs(spark)).collect()
    assert len(rows) == 11 and all(r.size * len(r.draws) <= 2 * r.size for r in rows)
    assert {r.source for r in rows} == {"a", "b", None}
    assert sm.mix_plan(no_docs(spark)).count() == 0
    blank = edge_docs(spark).where("doc_id in (1, 2, 3)")
    assert all(r.target == 0 and not r.draws for r in sm.mix_plan(blank).collect())
    assert sm.mix(edge_docs(spark)).columns[:-2] == edge_docs(spark).columns


def test_shards_follow_the_tree(spark):
    """Every shard gets the same number of blocks, and of each source its share."""
    docs = spark.range(16_000).selectExpr("id doc_id", "concat('w', id, ' x y z') text", "concat('s', id % 4) source")
    rows = sm.mix_plan(docs, shards=8).collect()
    words = np.zeros((8, 4))
    for r in rows:
        for d in r.draws:
            words[d["shard"], int(r.source[1])] += r.size
    by_shard, by_source = words.sum(axis=1), words.sum(axis=0)
    assert by_shard.max() - by_shard.min() <= 0.06 * by_shard.mean()  # equal by the tree, not by chance
    assert (np.abs(words / by_source - 1 / 8) < 0.08).all()


def test_own_columns_survive(spark, tmp_path):
    names = "_row long, _Shard string, _place double, __row int"
    rows = [(i, f"a b {i}", "s", i, f"x{i}", i / 2, i) for i in range(50)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {names}")
    docs.write.parquet(str(tmp_path / "docs"))
    for d in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        out = sm.shuffled_shards(sm.mix(d, shards=3))
        assert out.columns == [*docs.columns, "__shard", "__place"]
        assert {tuple(r)[: len(names)] for r in out.select(*docs.columns).collect()} <= set(rows)
        got = sorted((r.doc_id, r["__shard"]) for r in out.collect())
        assert got == sorted((r._id, x["shard"]) for r in sm.mix_plan(docs, shards=3).collect() for x in r.draws)
