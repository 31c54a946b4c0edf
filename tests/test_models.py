"""Property tests for fitted operators (LDA, PCA, k-means, SMOTE, classifiers)."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import functions as F

from labelprism.operators import classify, cluster, evaluate, topics
from labelprism.sources import tables


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(7)
    rows, i = [], 0
    for lab, n, centre in [("a", 60, 0.0), ("b", 25, 6.0), ("c", 10, -6.0)]:
        for _ in range(n):
            rows.append((i, [float(v) for v in rng.normal(centre, 1.0, size=4)], lab))
            i += 1
    return spark.createDataFrame(rows, "id long, v array<double>, label string")


def test_smote_balances_and_stays_on_segments(spark, planted):
    out = classify.smote(planted, "label", "v", "id", k=3, seed=1).persist()
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {"a": 60, "b": 60, "c": 60}
    rows = planted.collect()
    box = {}
    for r in rows:
        lo, hi = box.get(r.label, (np.full(4, np.inf), np.full(4, -np.inf)))
        box[r.label] = (np.minimum(lo, r.v), np.maximum(hi, r.v))
    for r in out.where("copy > 0").collect():
        # a point between two rows of a class lies inside the class's bounding box
        lo, hi = box[r.label]
        assert np.all(np.array(r.v) >= lo - 1e-9) and np.all(np.array(r.v) <= hi + 1e-9)
    out.unpersist()


def test_kmeans_best_of_restarts(spark, planted):
    m = cluster.fit_kmeans(planted, "v", k=3, seed=3, n_init=3, max_iter=50)
    assert m.summary.trainingCost <= cluster.fit_kmeans(planted, "v", k=3, seed=3, n_init=1, max_iter=50).summary.trainingCost
    assigned = cluster.cluster(planted, "v", m)
    # clusters recover the planted groups
    purity = assigned.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max("count").alias("m")) \
                     .agg(F.sum("m")).first()[0] / planted.count()
    assert purity > 0.95


def test_model_save_and_reload(spark, planted, tmp_path):
    m = cluster.fit_kmeans(planted, "v", k=3, seed=3, n_init=1, max_iter=20)
    path = tables.save_model(m, str(tmp_path / "km"))
    m2 = tables.load_model(KMeansModel, path)
    a = [r.cluster for r in cluster.cluster(planted, "v", m).orderBy("id").collect()]
    b = [r.cluster for r in cluster.cluster(planted, "v", m2).orderBy("id").collect()]
    assert a == b


def test_pca_reduce_shape(spark, planted):
    red, model = cluster.reduce(planted, "v", 2, "r")
    assert len(red.first().r) == 2
    assert sum(model.explainedVariance) <= 1.0 + 1e-9


def test_lda_distributions_sum_to_one(spark):
    rows = [(i, ["apple", "pear", "fruit"] * 3 if i % 2 else ["car", "road", "wheel"] * 3) for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>")
    vocab = spark.createDataFrame([(w,) for w in ["apple", "car", "fruit", "pear", "road", "wheel"]], "term string")
    vecs, words = topics.count_vectors(docs, "tokens", vocab)
    model = topics.fit_topics(vecs, k=2, seed=42, max_iter=20)
    assigned = topics.assign_topics(model, vecs)
    for r in assigned.collect():
        assert abs(sum(r.theta) - 1) < 1e-6
    # the two planted vocabularies land in different dominant topics
    dom = {r.id % 2: r.dominant_topic for r in assigned.collect()}
    assert dom[0] != dom[1]
    tt = topics.model_topic_terms(model, words, spark)
    assert tt.count() == 12


def aligned(spark, pairs, fitted, display, threshold=0.1):
    ov = spark.createDataFrame(pairs, "topic_a string, topic_b int, jaccard double")
    got = topics.align_topics(ov, spark.createDataFrame([(t,) for t in fitted], "topic int"), spark.createDataFrame([(n,) for n in display], "name string"), threshold)
    return [(r.topic, r.name) for r in got.orderBy("position").collect()]


def plain_alignment(pairs, fitted, display, threshold=0.1):
    """Display topic by display topic, each the best that is left."""
    import re
    order = sorted(set(display), key=lambda n: (int((re.findall(r"\d+", n) or [0])[0]), n))
    left, partner = set(fitted), {}
    for name in order:
        best = min(((-j, t) for a, t, j in pairs if a == name and j > threshold and t in left), default=None)
        if best:
            partner[name] = best[1]
            left.discard(best[1])
    single = sorted(left)
    for name in order:
        if name not in partner and single:
            partner[name] = single.pop(0)
    return [(partner[n], n) for n in order if n in partner] + [(t, f"Topic {t + 1} (Unmapped)") for t in single]


def test_align_topics(spark):
    pairs = [("Topic1", 1, 0.5), ("Topic1", 0, 0.5), ("Topic2", 0, 0.05), ("Topic2", 1, 0.9)]
    # Topic1 -> 0 (tie, lowest id), Topic2 -> 1
    assert aligned(spark, pairs, [0, 1, 2], ["Topic2", "Topic1"]) == [(0, "Topic1"), (1, "Topic2"), (2, "Topic 3 (Unmapped)")]
    # a display topic that is turned down goes on to its next choice and may turn down another there
    chain = [("T1", 0, 0.9), ("T2", 0, 0.9), ("T2", 1, 0.4), ("T3", 1, 0.8), ("T3", 2, 0.2), ("T10", 2, 0.9), ("T10", 3, 0.2)]
    assert aligned(spark, chain, range(5), ["T10", "T1", "T2", "T3"]) == [(0, "T1"), (1, "T2"), (2, "T3"), (3, "T10"), (4, "Topic 5 (Unmapped)")]
    # no pair at all; more names than topics
    assert aligned(spark, [], [3, 1], ["B2", "A1", "C3"]) == [(1, "A1"), (3, "B2")]
    assert aligned(spark, [], [], ["A1"]) == []


def test_align_topics_against_serial_choice(spark):
    import random
    rng = random.Random(4)
    for n, m in ((12, 9), (7, 13)):
        display, fitted = [f"Topic{k}" for k in range(n)], list(range(m))
        pairs = [(a, t, rng.choice([0.05, 0.2, 0.3, 0.5, 0.5])) for a in display for t in fitted if rng.random() < 0.6]
        assert aligned(spark, pairs, fitted, display) == plain_alignment(pairs, fitted, display)


def test_nested_cv_planted_signal(spark, planted):
    res = classify.nested_cv(planted, "label", "v", "id", kind="gbt", outer=2, inner=2, trials=2,
                             space={"n_trees": (3, 4), "max_depth": (2, 3), "step_size": (0.1, 0.3),
                                    "subsample": (0.8, 1.0), "colsample": (0.8, 1.0), "min_gain": (0.0, 0.0)})
    rows = res.collect()
    assert len(rows) == 2
    assert all(r.accuracy > 0.8 for r in rows)
    s = evaluate.fold_summary(res, ["accuracy", "macro_f1"]).first()
    assert s.accuracy_std >= 0


def test_topic_analysis_plan_end_to_end(spark):
    from labelprism.plans import topic_analysis
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    res = topic_analysis.run(docs, "doc_id", "text", "lang", k=3, min_df=2, max_iter=5)
    names = res["topic_names"].collect()
    assert sorted(r.topic for r in names) == [0, 1, 2]
    wide = res["label_topic_wide"]
    assert len(wide.columns) == 4 and wide.count() == res["doc_topics"].select("lang").distinct().count()
    shares = [r.share_pct for r in res["topic_share"].collect()]
    assert abs(sum(shares) - 100) < 1e-6
    assert res["topic_report"].where("name IS NULL").count() == 0


def test_topic_sweep_and_best_k(spark):
    from labelprism.operators import coherence, text
    rows = [(i, (["apple", "pear", "fruit", "juice"] if i % 2 else ["car", "road", "wheel", "tyre"]) * 2)
            for i in range(30)]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>")
    sweep = coherence.sweep_topics(text.bag_of_words(docs, "id", "tokens"), docs, "id", "tokens", ks=[2, 3], topn=4, window=110, max_iter=10)
    assert sorted(r.k for r in sweep.collect()) == [2, 3]
    best = coherence.best_k(sweep).first()
    assert best.best_k in (2, 3)


def test_write_table_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    tables.write_table(df, str(tmp_path / "t"))
    back = tables.read_table(spark, str(tmp_path / "t"), schema="id long, s string")
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a"), (2, "b")]


def test_encoders(spark):
    from labelprism.operators import encode
    import numpy as np
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, [])], "id long, t array<string>")
    v = {r.id: r.embedding for r in encode.hashed_tfidf(docs, "id", "t", 16).collect()}
    assert len(v[1]) == 16 and abs(np.linalg.norm(v[1]) - 1) < 1e-5 and not any(v[3])
    texts = spark.createDataFrame([(1, "hello"), (2, None)], "id long, text string")
    out = encode.encode_batches(texts, "text", lambda: (lambda xs: [[float(len(x)), 1.0] for x in xs]), 2, batch=1)
    got = {r.id: list(r.embedding) for r in out.collect()}
    assert got == {1: [5.0, 1.0], 2: [0.0, 1.0]}
    w2v, _ = encode.word2vec_mean(docs, "t", dims=4, min_count=1)
    assert all(len(r.embedding) == 4 for r in w2v.collect())


def test_topic_coordinates_reproduce_euclidean_distances(spark):
    import math
    # three topics at the corners of a unit equilateral triangle
    d = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 1.0)],
                              "topic_a string, topic_b string, jsd double")
    xy = topics.topic_coordinates(d, ["a", "b", "c"]).set_index("topic")
    for p, q in [("a", "b"), ("a", "c"), ("b", "c")]:
        dist = math.dist((xy.x[p], xy.y[p]), (xy.x[q], xy.y[q]))
        assert abs(dist - 1.0) < 1e-9


def test_numbered_order(spark):
    df = spark.createDataFrame([("Topic10",), ("Topic9",), ("Topic1",)], "name string")
    assert [r.name for r in topics.numbered_order(df, "name").collect()] == ["Topic1", "Topic9", "Topic10"]
