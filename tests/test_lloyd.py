import numpy as np
import pytest

from shelfwise.operators import lloyd as L


def points(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")


def plain(x, c, max_iter=100, tol=1e-4):
    """One Lloyd run, from centroids c."""
    for _ in range(max_iter):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        moved = np.sqrt(((new - c) ** 2).sum(1)).max()
        c = new
        if moved <= tol:
            break
    return c, ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(1)
    return np.concatenate([rng.normal(m, 0.5, (60, 5)) for m in range(0, 12, 2)])


def test_batched_runs_equal_separate_runs(spark, x, monkeypatch):
    df = points(spark, x)
    held = L.materialize(df.selectExpr("xxhash64(features) h", "features v").repartition(5), "points")
    rng = np.random.default_rng(2)
    tables = [x[rng.choice(len(x), k, replace=False)] for k in (1, 2, 3, 6, 6, 9)]
    monkeypatch.setattr(L, "CELLS", 100)
    got, costs = L.lloyd(held, tables, 100, 1e-4)
    for c, g, cost in zip(tables, got, costs, strict=True):
        want, least = plain(x, c)
        assert np.allclose(g, want) and np.isclose(cost, least)


def test_starts_find_the_groups(spark, x):
    fits = L.kmeans_many(points(spark, x), [6, 2, 3, 6], n_init=5)
    assert [f.k for f in fits] == [6, 2, 3, 6] and [len(f.centers) for f in fits] == [6, 2, 3, 6]
    own = sum(((g - g.mean(0)) ** 2).sum() for g in np.split(x, 6))
    assert fits[0].cost <= own * 1.001 and fits[0].cost == min(fits[0].costs) and len(fits[0].costs) == 5
    assert fits[1].cost > fits[2].cost > fits[0].cost
    again = L.kmeans_many(points(spark, x).repartition(7), [6], n_init=5)[0]
    assert np.isclose(again.cost, fits[0].cost)
    placed = {r.row_id: r.clusters for r in L.assign_many(points(spark, x), fits).collect()}
    assert len(placed) == len(x)
    for i, clusters in placed.items():
        assert [((f.centers - x[i]) ** 2).sum(1).argmin() for f in fits] == list(clusters)


def test_few_rows_copies_and_none(spark):
    df = points(spark, np.array([[1.0, 1.0]] * 50 + [[2.0, 5.0]]))
    fit = L.kmeans_many(df, [4], n_init=3)[0]
    assert len(fit.centers) <= 4 and fit.cost == pytest.approx(0)
    none = spark.createDataFrame([(1, None)], "row_id long, features array<double>")
    assert len(L.kmeans_many(none, [3])[0].centers) == 0


def test_sums_of_many_fits_travel_as_few_rows(spark, x):
    import pandas as pd

    tables = [x[: 1 + i % 7] + i / 100 for i in range(100)]
    out = pd.concat(L._fold(tables)(iter([pd.DataFrame({"h": range(len(x)), "v": list(x)})])))
    assert len(out) <= L.SLABS
    held = L.materialize(points(spark, x).selectExpr("xxhash64(features) h", "features v").repartition(3), "points")
    found = L._pass(held, tables)
    for s, c in enumerate(tables):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        near = d.argmin(1)
        sums, counts, cost = found[s]
        assert list(counts) == [int((near == j).sum()) for j in range(len(c))] and np.isclose(cost, d.min(1).sum())
        assert np.allclose(sums, [x[near == j].sum(0) for j in range(len(c))])


@pytest.mark.parametrize("share", [0.0, 0.8, 1e9])
def test_rounds_only_sum_what_has_changed(spark, x, monkeypatch, share):
    held = L.materialize(points(spark, x).selectExpr("xxhash64(features) h", "features v").repartition(5), "points")
    rng = np.random.default_rng(3)
    tables = [x[rng.choice(len(x), k, replace=False)] for k in (1, 2, 3, 7, 7, 12)]
    whole, changed = [], []
    fold, drift = L._fold, L._drift
    monkeypatch.setattr(L, "_fold", lambda *a, **kw: whole.append(1) or fold(*a, **kw))
    monkeypatch.setattr(L, "_drift", lambda *a, **kw: changed.append(1) or drift(*a, **kw))
    for name, value in (("REFER_CELLS", 0), ("REFER_SHARE", share), ("FOLD_ROWS", 50), ("FOLD_WIDTH", 8), ("TASK_CELLS", 100)):
        monkeypatch.setattr(L, name, value)
    got, costs = L.lloyd(held, tables, 100, 1e-9)
    assert len(whole) == 2 and len(changed) > 3
    for c, g, cost in zip(tables, got, costs, strict=True):
        want, least = plain(x, c, tol=1e-9)
        assert np.allclose(g, want) and np.isclose(cost, least)


def test_single_precision_decides_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    for scale, shift in ((1.0, 0.0), (1e-6, 1e4), (1e25, 0.0), (1e-30, 0.0)):
        x = rng.normal(size=(500, 3)).round(2) * scale + shift
        tables = [x[rng.choice(500, k, replace=False)] for k in (1, 4, 40)]
        tables.append(np.concatenate([tables[1], tables[1][:2] * (1 + 1e-9)]))  # all but ties
        for s, near in L._nearest(tables)(x):
            more = np.hstack([x, np.ones((500, 1))])
            c = tables[s]
            want = (more @ np.hstack([-2.0 * c, (c * c).sum(1)[:, None]]).T).argmin(1)
            if scale == 1.0:
                assert list(near) == list(want)
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            error = 1e-13 * (np.abs(x).max() + np.abs(c).max()) ** 2
            assert (d[np.arange(500), near] <= d.min(1) + error).all()
