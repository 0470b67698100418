"""Neighbours, balancing, clustering and propagation against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import balance as B
from shelfwise.operators import clusters as K
from shelfwise.operators import features as E
from shelfwise.operators import graph as G
from shelfwise.operators import neighbors as N
from shelfwise.operators.knn_vote import knn_classify

TILES = {"pivots": 12, "block_rows": 30}


def blobs(seed=0, n=220, copies=80):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, 3)) * 6
    x = centers[rng.integers(0, 8, n)] + rng.normal(size=(n, 3))
    # a third of the rows are copies of one vector
    return np.concatenate([x, np.tile([1.0, 2.0, 3.0], (copies, 1)), [[40.0, 40.0, 40.0]]])


def frame(spark, x, extra=None):
    rows = [(i, [float(v) for v in r], *(extra[i] if extra else ())) for i, r in enumerate(x)]
    ddl = "row_id long, features array<double>" + (", label int" if extra else "")
    return spark.createDataFrame(rows, ddl)


def brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return {(i, int(j), r + 1) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:k])}


@pytest.mark.parametrize("tiles", [{}, TILES])
def test_knn_is_exact_with_copies_and_blocks(spark, tiles):
    x = blobs()
    df = frame(spark, x)
    got = N.knn_join(df, df, 4, exclude_self=True, **tiles).collect()
    assert {(r["left_id"], r["right_id"], r["rank"]) for r in got} == brute(x, 4)


def test_knn_two_tables_and_small_right_side(spark):
    x, y = blobs(1, 40, 5), blobs(2, 3, 0)
    got = N.knn_join(frame(spark, x), frame(spark, y), 6, **TILES).collect()
    assert len(got) == len(x) * len(y)
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    for r in got:
        assert abs(r["distance"] - d[r["left_id"], r["right_id"]]) < 1e-9


def test_cosine_distance(spark):
    x = np.array([[1.0, 0], [2.0, 0], [0, 3.0], [-1.0, 0]])
    df = frame(spark, x)
    got = {(r["left_id"], r["right_id"]): r["distance"] for r in N.knn_join(df, df, 3, "cosine", exclude_self=True).collect()}
    assert abs(got[(0, 1)]) < 1e-12 and abs(got[(0, 2)] - 1) < 1e-12 and abs(got[(0, 3)] - 2) < 1e-12
    with pytest.raises(ValueError):
        N.knn_join(df, df, 1, "manhattan")


@pytest.mark.parametrize("tiles", [{}, TILES])
def test_cosine_of_zero_and_equidistant_rows(spark, tiles):
    x = np.array([[1.0, 0], [0, 1.0], [0, 0], [1, 0.1], [0, 0], [1.0, 0]])
    got = N.knn_join(frame(spark, x), frame(spark, x), 5, "cosine", exclude_self=True, **tiles).collect()
    d = {(r["left_id"], r["right_id"]): r["distance"] for r in got}
    unit = [v / np.linalg.norm(v) if v.any() else v for v in x]
    assert len(d) == 30 and all(abs(v - (1 - unit[a] @ unit[b])) < 1e-9 for (a, b), v in d.items())
    near = min((r for r in got if r["left_id"] == 3), key=lambda r: r["rank"])
    assert near["right_id"] == 0 and near["distance"] < 0.01


def test_hash_reaches_beyond_32_bits(spark):
    from pyspark.sql import functions as F

    from shelfwise.functions.hashing import hash_int, hash_uniform

    r = spark.range(1000).agg(F.max(hash_int("id", 1)), F.min(hash_int("id", 1)), F.max(hash_uniform("id", 1))).first()
    assert r[0] > 2**59 and r[0] < 2**60 and r[1] >= 0 and 0.99 < r[2] < 1


def test_leaderboard_keeps_all_runs(spark):
    from shelfwise.operators.sampling import leaderboard

    df = spark.createDataFrame([(i, (i * 7) % 5) for i in range(300)], "run int, score int").repartition(5)
    got = sorted((r["position"], r["run"]) for r in leaderboard(df, "score", ["run"]).collect())
    want = sorted(range(300), key=lambda i: (-((i * 7) % 5), i))
    assert got == [(k + 1, i) for k, i in enumerate(want)]
    assert leaderboard(df, "score", ["run"], 7).count() == 7


def test_rbf_sums_over_all_rows(spark):
    x, y = blobs(3, 60, 20), blobs(4, 90, 30)
    labels = [(i % 3,) for i in range(len(y))]
    got = N.rbf_class_sums(frame(spark, x), frame(spark, y, labels), 2.0, "label", 3, **TILES).collect()
    w = np.exp(-2.0 * ((x[:, None] - y[None]) ** 2).sum(-1))
    onehot = np.eye(3)[[v[0] for v in labels]]
    want = w @ onehot
    assert len(got) == len(x)
    for r in got:
        np.testing.assert_allclose(r["sums"], want[r["id"]], rtol=1e-9, atol=1e-300)


def test_silhouette_with_singleton_and_copies(spark):
    x = blobs(5, 70, 30)
    lab = [(int(i % 4 if i < len(x) - 1 else 9),) for i in range(len(x))]
    got = {r["id"]: r["silhouette"] for r in K.silhouette_rows(frame(spark, x, lab), "label", **TILES).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    y = np.array([v[0] for v in lab])
    for i in range(len(x)):
        own = y == y[i]
        if own.sum() == 1:
            assert got[i] == 0
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][y == c].mean() for c in set(y) if c != y[i])
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-9


def test_knn_vote_with_zero_distance(spark):
    train = frame(spark, np.array([[0.0], [0.1], [0.2], [5.0]]), [(1,), (0,), (0,), (2,)])
    test = frame(spark, np.array([[0.0], [4.0]]))
    uni = {r["id"]: r["prediction"] for r in knn_classify(train, test, 3).collect()}
    dist = {r["id"]: r["prediction"] for r in knn_classify(train, test, 3, weights="distance").collect()}
    assert uni[0] == 0 and dist[0] == 1 and dist[1] == 2


def test_smote_lies_between_base_and_neighbour(spark):
    x = blobs(6, 120, 0)
    lab = [(0 if i < 90 else 1 if i < 118 else 2 if i < 120 else 3,) for i in range(len(x))]
    df = frame(spark, x, lab)
    rows = B.smote_synthetic(df, "label", k=4, **TILES).collect()
    per = {}
    for r in rows:
        per[r["label"]] = per.get(r["label"], 0) + 1
        a, b = x[r["base"]], x[r["neighbor"]]
        np.testing.assert_allclose(r["features"], a + r["step"] * (b - a), atol=1e-12)
        assert lab[r["base"]] == lab[r["neighbor"]] == (r["label"],)
    assert per == {1: 90 - 28, 2: 88, 3: 89}
    assert all(r["base"] == r["neighbor"] for r in rows if r["label"] == 3)
    balanced = B.oversample(df, "label", k=4).groupBy("label").count().collect()
    assert {r["count"] for r in balanced} == {90}


def test_borderline_bases_are_on_the_border(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 2))
    lab = [(0 if i < 90 else 1,) for i in range(120)]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    y = np.array([v[0] for v in lab])
    other = np.array([(y[np.argsort(d[i])[:10]] != y[i]).sum() for i in range(120)])
    want = {i for i in range(120) if 5 <= other[i] < 10}
    df = frame(spark, x, lab)
    assert {r["row_id"] for r in B.danger_rows(df, "label").collect()} == want
    got = B.borderline_smote_synthetic(df, "label").collect()
    assert len(got) == 60 and {r["base"] for r in got} <= want


def test_class_weights_sum_to_n(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2 + [(None,)], "y int")
    assert df.count() == 9
    total = B.with_class_weight(df.dropna(), "y").agg(F.sum("weight")).first()[0]
    assert abs(total - 8) < 1e-12


def undirected(spark, pairs):
    return spark.createDataFrame([(a, b, w) for a, b, w in pairs] + [(b, a, w) for a, b, w in pairs], "src long, dst long, w double")


def test_components_on_a_chain_and_isolated_node(spark):
    edges = undirected(spark, [(i, i + 1, 1.0) for i in range(20, 60)] + [(3, 1, 1.0)])
    nodes = spark.createDataFrame([(i,) for i in list(range(20, 61)) + [1, 3, 99]], "id long")
    got = {r["id"]: r["component"] for r in G.connected_components(nodes, edges).collect()}
    assert all(got[i] == 20 for i in range(20, 61)) and got[1] == got[3] == 1 and got[99] == 99


def test_propagation_and_spreading_match_matrices(spark):
    pairs = [(0, 1, 1.0), (1, 2, 0.5), (2, 3, 1.0), (4, 5, 1.0)]
    edges = undirected(spark, pairs)
    y = {0: 0, 3: 1}
    nodes = spark.createDataFrame([(i, y.get(i)) for i in range(7)], "id long, label int")
    w = np.zeros((7, 7))
    for a, b, v in pairs:
        w[a, b] = w[b, a] = v
    seed = np.zeros((7, 2))
    for i, c in y.items():
        seed[i, c] = 1
    f = seed.copy()
    for _ in range(6):
        f = (w + np.eye(7)) @ f
        s = f.sum(1, keepdims=True)
        f = np.divide(f, np.where(s == 0, 1, s))
        for i in y:
            f[i] = seed[i]
    got = {r["id"]: r for r in G.label_propagation(nodes, edges, 2, 6, None).collect()}
    for i in range(7):
        np.testing.assert_allclose(got[i]["p"], f[i], atol=1e-12)
    assert got[0]["label"] == 0 and got[4]["label"] is None and got[6]["label"] is None
    d = w.sum(1)
    s_ = np.divide(w, np.sqrt(np.outer(d, d)), out=np.zeros_like(w), where=np.outer(d, d) > 0)
    g = seed.copy()
    for _ in range(5):
        g = 0.3 * s_ @ g + 0.7 * seed
    t = g.sum(1, keepdims=True)
    g = np.divide(g, np.where(t == 0, 1, t))
    spread = {r["id"]: r["p"] for r in G.label_spreading(nodes, edges, 2, 0.3, 5, None).collect()}
    for i in range(7):
        np.testing.assert_allclose(spread[i], g[i], atol=1e-12)


def test_density_separates_blobs_and_noise(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(40, 2)) * 0.2, rng.normal(size=(40, 2)) * 0.2 + 10, [[100.0, 100.0]]])
    out = K.density_clusters(frame(spark, x), 4, 10, eps=1.0).collect()
    lab = {r["id"]: r["cluster"] for r in out}
    assert {lab[i] for i in range(40)} == {0} and {lab[i] for i in range(40, 80)} == {40} and lab[80] == -1
    assert K.cluster_score(spark.createDataFrame(out)).first()["n_labels"] == 3


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5)) * [5, 3, 1, 0.1, 0.1]
    df = frame(spark, x)
    p = E.Pca.fit(df, 0.95)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.95) + 1)
    assert p.basis.shape[1] == k
    z = np.array([r["pca"] for r in p.transform(df).orderBy("row_id").collect()])
    np.testing.assert_allclose(z.var(0, ddof=1), values[:k], rtol=1e-9)
    assert abs(z.mean()) < 1e-9


def test_encoders(spark):
    train = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0), ("b", 9.0, 5.0), (None, None, 5.0)], "c string, x double, k double")
    p = E.numcat_pipeline(train, ["c"], ["x", "k"])
    new = spark.createDataFrame([("z", 3.0, 6.0)], "c string, x double, k double")
    assert p.feature_names() == ["c_a", "c_b", "x", "k"]
    assert list(p.transform_named(new).first()) == [0.0, 0.0, 0.0, 1.0]
    codec = E.LabelCodec.fit(train, "c")
    got = train.select(codec.encode("c").alias("e")).withColumn("d", codec.decode("e")).collect()
    assert [tuple(r) for r in got] == [(0, "a"), (1, "b"), (1, "b"), (None, None)]


def test_nearest_centroid_ties_to_lowest_index(spark):
    got = N.nearest_centroid(frame(spark, np.array([[0.0], [2.0]])), [[1.0], [-1.0], [2.5]]).collect()
    assert [(r["cluster"], r["distance"]) for r in got] == [(0, 1.0), (2, 0.5)]


def test_rbf_sums_with_soft_labels(spark):
    x, y = blobs(7, 20, 0), blobs(8, 30, 10)
    rng = np.random.default_rng(0)
    soft = rng.random((len(y), 2))
    rows = [(i, [float(v) for v in r], [float(s) for s in soft[i]]) for i, r in enumerate(y)]
    train = spark.createDataFrame(rows, "row_id long, features array<double>, p array<double>")
    want = np.exp(-0.5 * ((x[:, None] - y[None]) ** 2).sum(-1)) @ soft
    for r in N.rbf_class_sums(frame(spark, x), train, 0.5, "p", 2, **TILES).collect():
        np.testing.assert_allclose(r["sums"], want[r["id"]], rtol=1e-9, atol=1e-300)


def test_blocks_of_pairs_grow_with_the_table():
    # at ten times the rows a block has more rows, so a row does not travel ten times as often
    slots = 12
    few, many = (N.block_rows_for(float(n) ** 2, 64, slots) for n in (10_000, 100_000))
    assert -(-100_000 // many) <= 1.1 * -(-10_000 // few)
    assert N.block_rows_for(1e12, 64, slots) * 64 * 8 <= N.BLOCK_BYTES
    assert N.block_rows_for(1e12, 4096, slots) * 4096 * 8 <= N.BLOCK_BYTES


def test_blocks_at_size_are_few():
    # 615,000 rows of 64 numbers travel to 13 blocks a side, not 26
    assert -(-615_000 // N.block_rows_for(615_000.0**2, 64, 12)) <= 13


def test_blocks_of_a_vote_are_bounded():
    # a fifth of 615,000 rows asks the others: 29,000 rows a block, 5 by 17 blocks
    rows = N.block_rows_for(0.8 * 0.2 * 615_000.0**2, 64, 12)
    assert rows * 64 * 8 <= 15 << 20 and -(-123_000 // rows) <= 5 and -(-492_000 // rows) <= 17


def test_rows_that_no_pivot_parts_travel_once_per_block(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9000, 32))  # two pivots by default; no cell can be left out
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    seen = N.tile_join(
        df, df.withColumnsRenamed({"row_id": "r"}), lambda a, b: a[["row_id"]].head(1).assign(n=len(a), m=len(b)),
        "row_id long, n long, m long", "row_id", "r", "features", k=3, block_rows=3000,
    )
    pairs = [(r.n, r.m) for r in seen.collect()]
    assert len(pairs) == 9 and sum(n for n, _ in pairs) == 27_000 == sum(m for _, m in pairs)


def test_square_blocks_keep_close_and_far_rows(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 5)) + 1e4
    y = np.concatenate([x[:20], x[:20] + 1e-7, rng.normal(size=(30, 5)) + 1e4])
    monkeypatch.setattr(N, "KERNEL_PAIRS", 400)
    got = np.concatenate([sq for _, sq in N.square_blocks(x, y)])
    want = ((x[:, None] - y[None]) ** 2).sum(2)
    assert np.allclose(got, want, rtol=1e-7, atol=0) and (np.diag(got)[:20] == 0).all()


def test_square_tiles_hold_little_and_make_up_all_pairs(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 5)) + 1e4
    y = np.concatenate([x[:20], x[:20] + 1e-7, rng.normal(size=(2300, 5)) + 1e4])
    got = np.full((len(x), len(y)), np.nan)
    for a, b, sq in N.square_tiles(x, y):
        got[a : a + sq.shape[0], b : b + sq.shape[1]] = sq
    want = ((x[:, None] - y[None]) ** 2).sum(2)
    assert np.allclose(got, want, rtol=1e-7, atol=0) and (np.diag(got)[:20] == 0).all()
    # nearly all pairs are close: their differences are not all gathered at once
    same = np.ones((1500, 64)) + rng.normal(size=(1500, 64)) * 1e-9
    same[0] += 100.0
    tracemalloc.start()
    for _, sq in N.square_blocks(same, same):
        del sq
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_fold_scores_equal_a_vote_fold_by_fold(spark):
    x = blobs(9, 60, 30)
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in r], int(rng.integers(3)), i % 4) for i, r in enumerate(x)]
    rows.append((len(x), rows[0][1], 2, 1))  # a copy in another fold
    folded = spark.createDataFrame(rows, "row_id long, features array<double>, label int, fold int")
    gammas = (0.5, 4.0, 1e6)  # at the last no vote reaches a row: class 0
    got = G.fold_scores(folded, 3, gammas, 4, **TILES)
    v, y, f = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
    d = ((v[:, None] - v[None]) ** 2).sum(-1)
    for g in gammas:
        votes = (np.exp(-g * d) * (f[:, None] != f[None])) @ np.eye(3)[y]
        hit = votes.argmax(1) == y
        assert got[g] == pytest.approx(np.mean([hit[f == i].mean() for i in range(4)]))


def test_top_k_kernel_breaks_ties_by_id():
    import pandas as pd

    x = np.zeros((3, 2))
    y = np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, -1.0], [2.0, 0.0]] * 40)
    ids = np.random.default_rng(7).permutation(len(y))
    left, right = pd.DataFrame({"l": [5, 6, 7], "v": list(x)}), pd.DataFrame({"r": ids, "v": list(y)})
    out = N._top_k_kernel(4, "l", "r", "v")(left, right)
    near = sorted(i for i, v in zip(ids, y, strict=True) if abs(v).sum() == 1)[:4]
    assert list(out["r"]) == near * 3 and list(out["l"]) == [5] * 4 + [6] * 4 + [7] * 4 and (out["d"] == 1).all()
