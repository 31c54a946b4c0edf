import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelprism.operators import vectors


def _table(spark, n=60, d=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    rows = [(i, [float(v) for v in x[i]], int(i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, v array<double>, label int"), x


def test_knn_exact_against_brute_force(spark):
    df, x = _table(spark)
    got = vectors.knn(df, "id", "v", k=4, block_rows=7).collect()
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    for r in got:
        order = np.lexsort((np.arange(len(x)), d[r.id]))
        assert order[r.rank - 1] == r.nbr
        assert math.isclose(r.dist, d[r.id, r.nbr], rel_tol=1e-9)
    assert len(got) == 60 * 4


def test_knn_within_partition(spark):
    df, x = _table(spark)
    got = vectors.knn(df, "id", "v", k=3, partition="label", block_rows=5).collect()
    assert all(r.id % 3 == r.nbr % 3 for r in got)
    assert len(got) == 60 * 3


def test_l2_normalise_zero_vector_unchanged(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    got = {r.id: r.v for r in vectors.l2_normalise(df, "v").collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 0.0]


def test_ragged_vectors_rejected(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, v array<double>")
    with pytest.raises(ValueError):
        vectors.to_vector(df, "v")


def test_argmax_ties_lowest(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0, 3.0])], "id long, v array<double>")
    assert vectors.dominant(df, "v").first().dominant == 1


def test_assign_clusters_and_centroids(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, [10.0, 10.0], "b"), (3, [1.0, float("nan")], "a")],
                               "id long, v array<double>, g string")
    centers = spark.createDataFrame([(7, [0.0, 1.0]), (9, [9.0, 9.0])], "cid int, c array<double>")
    got = {r.id: r.cluster for r in vectors.assign_clusters(df.where("id < 3"), "v", centers, "cid", "c").collect()}
    assert got == {1: 7, 2: 9}
    cents = {r.g: r.centroid for r in vectors.centroids(df, "g", "v").collect()}
    assert cents["a"] == pytest.approx([0.5, 0.0])   # NaN ignored


def test_rule_score(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"])], "id long, t array<string>")
    got = {r.id: r.score for r in vectors.rule_score(df, "id", "t", [(["a", "b"], 2.0), (["b"], 0.5)]).collect()}
    assert got == {1: 2.5, 2: 0.5}


def test_knn_skips_null_key_and_null_vector(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (None, [0.1]), (3, None), (4, [5.0])],
                               "id long, v array<double>")
    got = {(r.id, r.nbr) for r in vectors.knn(df, "id", "v", k=1).collect()}
    assert got == {(1, 2), (2, 1), (4, 2)}


@pytest.mark.parametrize("copies", [0, 40])
def test_tiles_find_the_rows_that_differences_find(monkeypatch, copies):
    """Products of large numbers close together round away their distances; equal rows tie; a name may come again."""
    monkeypatch.setattr(vectors, "TILE", (16, 32))
    rng = np.random.default_rng(5)
    y = rng.normal(1000, 1e-6, (150, 4))
    y[100:100 + copies] = y[3]
    names = np.sort(rng.integers(0, 120, len(y)))
    d = vectors.squared(y, y)
    d[names[:, None] == names[None]] = np.inf
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    kept = vectors.first_copies(y, names, 5)
    for places in (np.arange(len(y)), kept):
        a, b, found = vectors.nearest_rows(y, y[places], 5, (names, names[places]))
        assert (places[b].reshape(-1, 5) == want).all() and (a == np.repeat(np.arange(len(y)), 5)).all()
        assert np.array_equal(found, np.take_along_axis(d, want, axis=1).ravel())
    assert len(kept) < len(y) or not copies


def test_exact_search_measures_few_pairs_by_differences(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    measured, of = [], vectors.squared_of
    monkeypatch.setattr(vectors, "squared_of", lambda a, i, b, j: measured.append(len(i)) or of(a, i, b, j))
    _, _, d = vectors.nearest_rows(x, x, 5, (np.arange(3000),) * 2)
    assert len(d) == 15_000 and sum(measured) < 100_000


def test_knn_leaves_out_numbers_that_are_not_finite(spark):
    big = 1e200  # its square is no number, the differences are
    df = spark.createDataFrame([(1, [big, 0.0]), (2, [big, 1.0]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (5, [big, 3.0])], "id long, v array<double>")
    got = {(r.id, r.nbr, r.dist) for r in vectors.knn(df, "id", "v", k=1).collect()}
    assert got == {(1, 2, 1.0), (2, 1, 1.0), (5, 2, 4.0)}


def test_exact_search_exchanges_no_vectors(spark):
    """However many blocks there are, a vector is written once or twice, not once per block."""
    rng = np.random.default_rng(5)
    rows = [(f"k{i:04d}" if i % 300 else "twin", [float(v) for v in rng.normal(0, 1, 16)]) for i in range(1500)] + [(None, [0.0] * 16), ("none", None)]
    df = spark.createDataFrame(rows, "id string, v array<float>").checkpoint()
    files = lambda: {f.getName(): f.length() for n in [spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()] for f in map(n.apply, range(n.size())) if f.getName().startswith("shuffle_")}
    before = files()
    got = vectors.knn(df, "id", "v", k=3, block_rows=150).collect()
    written = sum(n for name, n in files().items() if name not in before)
    assert written < 4 * 1500 * 16 * 4    # ten blocks on both sides were twenty times the vectors, as doubles
    keys, x = [r[0] for r in rows[:1500]], np.array([r[1] for r in rows[:1500]], np.float32).astype(float)
    found = {}
    for r in got:
        found.setdefault(r.id, {})[r["rank"]] = (r.nbr, r.dist)
    for i in range(1, 1500, 97):
        d = sorted((((x[i] - x[j]) ** 2).sum(), keys[j]) for j in range(1500) if keys[j] != keys[i])[:3]
        assert [found[keys[i]][n + 1][0] for n in range(3)] == [k for _, k in d]
        assert np.allclose([found[keys[i]][n + 1][1] for n in range(3)], [v for v, _ in d])
    assert len(got) == 3 * len(set(keys)) and all(r.nbr != r.id for r in got)


def test_exact_search_has_large_blocks_unless_told(spark, monkeypatch):
    seen = []
    real = vectors.packed_blocks
    monkeypatch.setattr(vectors, "packed_blocks", lambda rows, n: seen.append(n) or real(rows, n))
    df = spark.range(3000).select("id", F.array(F.rand(1), F.rand(2)).alias("v"))
    assert vectors.knn(df, "id", "v", k=2).count() == 6000 and seen[0] == 1
