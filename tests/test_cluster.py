"""k-means restarts in shared scans against separate fits; eigenmaps against a dense solver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelprism.operators import cluster


def frame(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, v array<double>")


def cost(x, centres):
    return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_restarts_find_what_separate_fits_find(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.4, (60, 3)) for c in rng.normal(0, 5, (6, 3))])
    df = frame(spark, x)
    found = cluster.kmeans_restarts(df, "id", "v", k=6, n_init=5, seed=1)
    separate = min(cluster.fit_kmeans(df, "v", k=6, seed=s, n_init=1).summary.trainingCost for s in range(5))
    best = found.centres[found.best]
    assert found.costs[found.best] <= separate * 1.001
    for centres, c in zip(found.centres, found.costs):
        assert c == pytest.approx(cost(x, centres), rel=1e-6)
    # every restart has settled: its centres are the means of their rows
    at = ((x[:, None, :] - best[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.allclose([x[at == j].mean(axis=0) for j in range(6)], best, atol=1e-3)
    # one scan a step for all restarts together
    assert found.scans <= 1 + 2 * 2 + 1 + found.steps.max() + 1 < found.steps.sum() + 5 * 6
    table = cluster.centres_table(spark, found).collect()
    assert [r.cluster for r in table] == list(range(6))


def test_odd_rows_for_restarts(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [9.0, 9.0]), (4, None), (5, [1.0])], "id long, v array<double>")
    found = cluster.kmeans_restarts(df, "id", "v", k=4, n_init=2)
    best = found.centres[found.best]
    assert sorted(map(tuple, best[~np.isnan(best).any(axis=1)])) == [(0.0, 0.0), (9.0, 9.0)] and found.costs[found.best] == 0
    again = cluster.kmeans_restarts(df.repartition(3), "id", "v", k=4, n_init=2)
    assert np.allclose(np.nan_to_num(found.centres), np.nan_to_num(again.centres))
    with pytest.raises(ValueError):
        cluster.kmeans_restarts(df.limit(0), "id", "v", k=2)


def moons(n, seed=0):
    rng = np.random.default_rng(seed)
    t = rng.uniform(0, np.pi, n)
    first = np.arange(n) < n // 2
    x = np.where(first, np.cos(t), 1 - np.cos(t))
    y = np.where(first, np.sin(t), 0.5 - np.sin(t))
    return np.column_stack((x, y)) + rng.normal(0, 0.04, (n, 2)), first


def split(values, truth):
    """Share of rows on the right side of the best single threshold."""
    order = truth[np.argsort(values)]
    right = np.concatenate(([0], np.cumsum(order))) + (~order).sum() - np.concatenate(([0], np.cumsum(~order)))
    return max(right.max(), len(order) - right.min()) / len(order)


def test_two_moons_that_a_projection_cannot_part(spark):
    x, truth = moons(200)
    df = frame(spark, x)
    got, values, residual = cluster.eigenmaps(df, "id", "v", dims=2, k=10, exact=True, max_rounds=4, steps=7, tol=1e-3)
    rows = {r.id: r.map for r in got.collect()}
    first = np.array([rows[k][0] for k in range(200)])
    assert split(first, truth) > 0.95
    flat, _ = cluster.reduce(df, "v", 1, "r")
    assert split(np.array([r.r[0] for r in flat.orderBy("id").collect()]), truth) < 0.93


def test_eigenmaps_against_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1.0, (25, 4)) for c in (0, 3, 6)])
    df = frame(spark, x)
    edges = cluster.graph_edges(df, "id", "v", k=6, exact=True).collect()
    a = np.zeros((75, 75))
    for e in edges:
        a[e.src, e.dst] = e.w
    assert np.allclose(a, a.T)
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    got, values, residual = cluster.eigenmaps(df, "id", "v", dims=3, k=6, exact=True, tol=1e-5, steps=6, max_rounds=4)
    assert residual < 1e-2 and np.allclose(values, want[:4], atol=1e-3)
    degree = (a > 0).sum(axis=1)
    y = np.array([r.map for r in got.orderBy("id").collect()]) * np.sqrt(degree)[:, None]
    for j in range(3):
        assert np.linalg.norm(a @ y[:, j] - values[j + 1] * y[:, j]) < 2e-2
        assert np.linalg.norm(y[:, j]) == pytest.approx(1, abs=1e-3)


def test_a_product_is_one_exchange_between_blocks(spark):
    """Chebyshev columns of three blocks against the dense matrix; string keys, one row with very many links."""
    rng = np.random.default_rng(8)
    a = np.triu(rng.random((40, 40)) < 0.1, 1)
    a[0, 1:] = True
    a = (a | a.T) * rng.random((40, 40))
    a = (a + a.T) / 2
    t = rng.normal(size=(40, 2))
    edges = spark.createDataFrame([(f"k{i:02}", f"k{j:02}", float(a[i, j])) for i, j in zip(*np.nonzero(a))], "src string, dst string, w double")
    rows = spark.createDataFrame([(f"k{i:02}", [float(v) for v in t[i]]) for i in range(40)], "src string, t array<double>")
    cluster.ensure_checkpoint_dir(spark)
    place, state = cluster.linked(rows, edges, 3)
    for _ in range(3):
        state = state.flatMap(cluster.sent(2)).partitionBy(3, int).mapPartitions(cluster.received(2), preservesPartitioning=True)
    found = dict(state.mapValues(lambda s: s[1]).collect())
    want = [t, a @ t]
    want += [2 * a @ want[1] - want[0]]
    want += [2 * a @ want[2] - want[1]]
    for r in place.collect():
        assert np.allclose(found[r.block][r.pos], np.hstack(want)[int(r.src[1:])])
    assert state.toDebugString().decode().count("PairwiseRDD") == 3
    assert np.allclose(cluster.added(state, lambda s: s[1][1].T @ s[1][1]), np.hstack(want).T @ np.hstack(want))


def test_a_scan_of_kmeans_is_one_stage(spark):
    x = np.random.default_rng(9).normal(size=(60, 3))
    data = frame(spark, x).select("id", "v").repartition(5).selectExpr("v AS _v").persist()
    blocks = cluster.numbers(data, 3)
    centres = {0: x[:2], 4: x[5:8]}
    sc = spark.sparkContext
    sc.setJobGroup("scan", "one scan")
    found = cluster.scan(blocks, 3, centres)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("scan")]
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert sum(len(j.stageIds) for j in jobs) <= 3  # the cached rows, and a tree of sums
    for r, c in centres.items():
        at, d = cluster.nearest(x, c)
        sums, n, cost = found[r]
        assert np.allclose(sums, [x[at == k].sum(axis=0) for k in range(len(c))]) and (n == np.bincount(at, minlength=len(c))).all() and cost == pytest.approx(d.sum())
    data.unpersist()


def test_links_and_columns_stay_where_they_are(spark):
    """Products against the dense matrix; what has no partner in another block is not exchanged."""
    rng = np.random.default_rng(10)
    a = np.triu(rng.random((30, 30)) < 0.3, 1) * rng.random((30, 30))
    a = a + a.T
    t = rng.normal(size=(30, 2))
    edges = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "src int, dst int, w double")
    rows = spark.createDataFrame([(i, [float(v) for v in t[i]]) for i in range(30)], "src int, t array<double>")
    cluster.ensure_checkpoint_dir(spark)
    place, state = cluster.linked(rows, edges, 3)
    state = state.partitionBy(3, int).persist()
    links, columns = (state.mapPartitions(lambda items, n=n: ((b, (n, s[n + 1])) for b, s in items), True) for n in (-1, 0))
    columns, want = [columns], [t, a @ t]
    for n in range(3):
        new, sums = cluster.product(links, columns, 2, 3)
        assert new.getNumPartitions() == 3 and all(len(x) == 2 and x[1].shape[1] == 2 for _, x in sums.collect())
        columns.append(new.persist())
        if n:
            want.append(2 * a @ want[-1] - want[-2])
    found = dict(cluster.side_by_side(columns).mapValues(lambda s: s[1]).collect())
    for r in place.collect():
        assert np.allclose(found[r.block][r.pos], np.hstack(want)[r.src])
    for c in (state, *columns):
        c.unpersist()


@pytest.mark.parametrize("room", [1, 1 << 30])
def test_rounds_in_parts_find_the_same_coordinates(spark, monkeypatch, room):
    monkeypatch.setattr(cluster, "ROUND_BYTES", room)
    x = np.random.default_rng(11).normal(size=(40, 3))
    got, values, _ = cluster.eigenmaps(frame(spark, x), "id", "v", dims=2, k=5, exact=True, steps=3, max_rounds=2, tol=0)
    edges = cluster.graph_edges(frame(spark, x), "id", "v", k=5, exact=True).collect()
    a = np.zeros((40, 40))
    for e in edges:
        a[e.src, e.dst] = e.w
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1][:3], atol=1e-2) and got.count() == 40
