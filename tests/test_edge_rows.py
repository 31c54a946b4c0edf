"""Nulls, ties, names without numbers and large domains."""

import pytest
from pyspark.sql import functions as F

from labelprism.functions.columns import number_in_name
from labelprism.operators import assoc, classify, evaluate, topics, vectors


def test_number_in_name_without_a_number(spark):
    df = spark.createDataFrame([("Topic10",), ("Default",), ("Topic9",), (None,), ("x99999999999999999999",)], "name string")
    got = [r.name for r in topics.numbered_order(df.where("name is not null"), "name").collect()]
    assert got == ["Default", "x99999999999999999999", "Topic9", "Topic10"]
    assert [r[0] for r in df.select(number_in_name("name")).collect()] == [10, 0, 9, 0, 0]


def test_crosstab_has_no_column_of_a_null_row(spark):
    df = spark.createDataFrame([("x", "s1"), (None, "s2"), ("y", "s1"), ("y", None)], "a string, b string")
    assert sorted(map(tuple, assoc.crosstab(df, "a", "b").collect())) == [("x", "s1", 1), ("y", "s1", 1)]
    got = {(r.a, r.b): r.deviation for r in assoc.deviation(df, "a", "b").collect()}
    assert got == {("x", "s1"): pytest.approx(100 - 200 / 3), ("y", "s1"): pytest.approx(100 - 200 / 3)}


def test_grid_of_empty_table_and_reindexed_rows(spark):
    none = spark.createDataFrame([], "a int, b string")
    assert assoc.crosstab(none, "a", "b").collect() == []
    one = spark.createDataFrame([(1, "s")], "a int, b string")
    got = assoc.crosstab(one, "a", "b", domain=spark.range(3).select(F.col("id").cast("int").alias("a")))
    assert sorted(map(tuple, got.collect())) == [(0, "s", 0), (1, "s", 1), (2, "s", 0)]
    assert sorted(map(tuple, assoc.complete_counts(one, "a", "b", ["s", "t"]).collect())) == [(1, "s", 1), (1, "t", 0)]


def test_fifty_thousand_labels(spark):
    df = spark.range(50_000).select(F.concat(F.lit("label"), "id").alias("label"), (F.col("id") % 2).alias("cat"))
    got = assoc.log_odds(df, "cat", "label")
    assert got.count() == 100_000 and got.agg(F.sum("n")).first()[0] == 50_000
    assert evaluate.label_encode(df, "label").agg(F.max("label_id"), F.count_distinct("label_id")).first()[:] == (49_999, 50_000)


def test_folds_keep_rows_without_a_class(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"c{i % 2}") for i in range(30)], "key long, label string")
    got = evaluate.stratified_folds(df, "label", "key", 3)
    assert got.count() == 30
    sizes = {(r.label, r.fold): r["count"] for r in got.groupBy("label", "fold").count().collect()}
    assert all(max(v) - min(v) <= 1 for v in ([n for (x, _), n in sizes.items() if x == c] for c in (None, "c0", "c1")))


def test_slices_follow_the_class_size(spark):
    from labelprism.functions.columns import hash_uniform
    from labelprism.operators.ordinal import uniform_rank_within

    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2900, "big").otherwise("small").alias("c"), hash_uniform("id", 1).alias("u"))
    rows = uniform_rank_within(df, ["c"], "u", "id", "r", slice_rows=100).collect()
    for c in ("big", "small"):
        mine = sorted((r.u, r.id, r.r) for r in rows if r.c == c)
        assert [r for _, _, r in mine] == list(range(len(mine)))


def test_knn_ties_go_to_the_smaller_key(spark):
    rows = [(0, [0.0, 0.0])] + [(k, [1.0, 0.0] if k % 2 else [0.0, 1.0]) for k in range(9, 0, -1)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for block in (3, 1024):
        got = [(r.nbr, r["rank"]) for r in vectors.knn(df, "id", "v", k=2, block_rows=block).where("id = 0").orderBy("rank").collect()]
        assert got == [(1, 1), (2, 2)]


def test_no_validation_row_is_synthetic_or_neighbour(spark):
    rows = [(k, [float(k % 7), float(k)], "a" if k % 5 else "b") for k in range(80)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label string")
    part = classify.training_part(df, "label", "v", "id", seed=3)
    held = {r.id for r in part.where("is_val").collect()}
    assert held and part.where("is_val and copy > 0").count() == 0
    fit = {r.id: r.v for r in part.where("not is_val and copy = 0").collect()}
    assert held.isdisjoint(fit) and len(held) + len(fit) == 80
    labels = {k: label for k, _, label in rows}
    for r in part.where("copy > 0").collect():
        a, p = fit[r.id], r.v
        ends = [v for k, v in fit.items() if labels[k] == labels[r.id]]
        # the point lies on a segment from its base to a row that is fitted on
        assert r.id not in held and any(abs((v[0] - a[0]) * (p[1] - a[1]) - (v[1] - a[1]) * (p[0] - a[0])) < 1e-6 for v in ends if v != a)
    sizes = {r.label: r["count"] for r in part.where("not is_val").groupBy("label").count().collect()}
    assert len(set(sizes.values())) == 1


def test_comparison_reports_unread_tables_and_fails_on_bad_ones(spark, tmp_path):
    rows = [(k, [float(k % 3), float(k % 3 == 1)], f"c{k % 3}") for k in range(60)]
    good = spark.createDataFrame(rows, "id long, v array<double>, label string")
    missing = lambda: spark.read.parquet(str(tmp_path / "none"))
    got = {r.model: r for r in classify.compare_embeddings({"good": good, "missing": missing}, "label", "v", "id", kind="logistic", outer=2).collect()}
    assert got["good"].accuracy_mean > 0.9 and got["good"].failed is None
    assert got["missing"].accuracy_mean is None and "none" in got["missing"].failed
    with pytest.raises(Exception):
        classify.compare_embeddings({"bad": good}, "label", "v", "misspelt", kind="logistic", outer=2)


def test_nested_cv_fits_boosted_trees_inside_and_outside(spark, monkeypatch):
    fits, roles = [], set()
    real = classify.boost.boost_many

    def logged(rows, wanted, *more, **kw):
        fits.extend(wanted)
        roles.update(r.role for r in rows.select("role").distinct().collect())
        return real(rows, wanted, *more, **kw)

    monkeypatch.setattr(classify.boost, "boost_many", logged)
    rows = [(k, [float(k % 2) + (k % 7) / 50, float(k % 5)], f"c{k % 2}") for k in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label string")
    got = classify.nested_cv(df, "label", "v", "id", kind="gbt", outer=2, inner=2, trials=2, oversample=False, space=classify.SEARCH_SPACE | {"n_trees": (1, 2), "max_depth": (2, 2)})
    assert len(fits) == 2 * (2 * 2 + 1) and roles == {classify.boost.TRAIN, classify.boost.STOP, classify.boost.TEST}
    assert got.agg(F.avg("accuracy")).first()[0] > 0.9


def test_alignment_pairs_left_overs_and_names_the_rest(spark):
    rows = [("Topic1", 0, 0.5), ("Topic1", 1, 0.5), ("Topic2", 0, 0.9), ("Topic2", 1, 0.1), ("Topic10", 3, 0.3)]
    df = spark.createDataFrame(rows, "topic_a string, topic_b int, jaccard double")
    fitted, display = spark.createDataFrame([(k,) for k in range(4)], "topic int"), spark.createDataFrame([("Topic10",), ("Topic2",), ("Topic1",)], "name string")
    got = topics.align_topics(df, fitted, display).orderBy("position").collect()
    assert [tuple(r) for r in got] == [(0, "Topic1", 0), (1, "Topic2", 1), (3, "Topic10", 2), (2, "Topic 3 (Unmapped)", 3)]


def test_many_wide_centres_and_queries(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(40, 1024)), rng.normal(size=(1000, 1024))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(40, None), (41, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    centres = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(c)], "cid long, cv array<double>")
    d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(-1)
    got = {r.id: r.cluster for r in vectors.assign_clusters(df, "v", centres, "cid", "cv").collect()}
    assert got == {i: 100 + int(d[i].argmin()) for i in range(40)} | {40: None, 41: None}
    score = (x @ c.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(c, axis=1)[None, :]
    top = vectors.semantic_topk(df, "id", "v", centres, "cid", "cv", k=3).collect()
    assert len(top) == 3000
    assert all(r.id == np.argsort(-score[:, r.cid - 100])[r["rank"] - 1] for r in top)


def test_equal_centres_and_rows_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (4, [0.0, 0.0])], "id long, v array<double>")
    centres = spark.createDataFrame([(8, [1.0, 0.0]), (7, [1.0, 0.0])], "cid long, cv array<double>")
    assert {r.cluster for r in vectors.assign_clusters(df, "v", centres, "cid", "cv").collect()} == {7}
    got = [(r.cid, r.id) for r in vectors.semantic_topk(df.repartition(3), "id", "v", centres, "cid", "cv", k=2).orderBy("cid", "rank").collect()]
    assert got == [(7, 1), (7, 2), (8, 1), (8, 2)]
    none = centres.limit(0)
    assert vectors.semantic_topk(df, "id", "v", none, "cid", "cv").collect() == []
    assert {r.cluster for r in vectors.assign_clusters(df, "v", none, "cid", "cv").collect()} == {None}
