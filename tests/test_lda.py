"""LDA in shared passes: parts against plain versions, models against models fitted alone and spark.ml."""

import math
import time

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from labelprism.operators import lda, text, topics
from tests.conftest import SF_SMALL


def test_digamma():
    x = np.array([0.01, 0.5, 1.0, 2.0, 7.3, 250.0])
    step = 1e-5
    want = [(math.lgamma(v + step * v) - math.lgamma(v - step * v)) / (2 * step * v) for v in x]
    assert np.allclose(lda.digamma(x), want, rtol=1e-6)


def test_e_step_against_plain_loops():
    rng = np.random.default_rng(1)
    n_docs, n_terms, k = 7, 12, 3
    pairs = [(d, t, float(rng.integers(1, 5))) for d in range(n_docs) for t in range(n_terms) if rng.random() < 0.5 or t == d]
    doc, term, tf = (np.array(c) for c in zip(*pairs))
    beta = rng.random((n_terms, k))
    gamma, counts = lda.e_step(doc, term, tf, beta, n_docs)
    want, sums = np.zeros((n_docs, k)), np.zeros((n_terms, k))
    for d in range(n_docs):
        mine = [(t, c) for x, t, c in pairs if x == d]
        g = np.full(k, 1 / k + sum(c for _, c in mine) / k)
        for _ in range(lda.INNER):
            theta = np.exp(lda.digamma(g) - lda.digamma(np.array([g.sum()])))
            new = 1 / k + sum(c * theta * beta[t] / (theta @ beta[t]) for t, c in mine)
            moved = np.abs(new - g).mean()
            g = new
            if moved <= lda.CLOSE:
                break
        want[d] = g
        theta = np.exp(lda.digamma(g) - lda.digamma(np.array([g.sum()])))
        for t, c in mine:
            sums[t] += c * theta * beta[t] / (theta @ beta[t])
    assert np.allclose(gamma, want) and np.allclose(counts, sums)


@pytest.fixture(scope="module")
def corpus(spark):
    docs = text.add_word_tokens(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text"), "text").drop("text").checkpoint()
    vocab = text.vocabulary(docs, "doc_id", "tokens", 7, 0.8).checkpoint()
    bow = text.bag_of_words(docs, "doc_id", "tokens").join(vocab.select("term"), "term", "left_semi").checkpoint()
    return docs, vocab, bow


def weights(model):
    return {(r.k, r.topic, r.term): r.weight for r in lda.term_weights(model).collect()}


def test_models_fitted_together_equal_models_fitted_alone(spark):
    """Also with small batches and blocks: how rows are dealt changes nothing."""
    rows = [(d, f"t{(d * 7 + j * j) % 23}", 1 + (d + j) % 3) for d in range(40) for j in range(6)]
    bow = spark.createDataFrame(rows, "id long, term string, tf int").groupBy("id", "term").agg(F.sum("tf").alias("tf"))
    both = weights(lda.fit_many(bow, "id", [2, 3], max_iter=4))
    small = weights(lda.fit_many(bow, "id", [2, 3], max_iter=4, batch_pairs=30, block_terms=5))
    assert both.keys() == small.keys() and len(both) == 23 * 5
    assert all(abs(both[x] - small[x]) < 1e-6 for x in both)
    alone = weights(lda.fit_many(bow, "id", [2], max_iter=4))
    assert all(abs(both[x] - v) < 1e-6 for x, v in alone.items())


def test_likelihood_matches_spark_ml(spark, corpus):
    docs, vocab, bow = corpus
    model = lda.fit_many(bow, "doc_id", [10])
    got = lda.document_topics(model)
    mine = got.agg(F.sum("log_likelihood")).head()[0]
    vectors, words = topics.count_vectors(docs, "tokens", vocab)
    other = topics.fit_topics(vectors, k=10)
    beta = other.topicsMatrix().toArray()
    beta = beta / beta.sum(axis=0)
    rows = other.transform(vectors).select("features", vector_to_array("topicDistribution").alias("theta")).collect()
    theirs = sum(float(r.features.values @ np.log(beta[r.features.indices] @ np.array(r.theta))) for r in rows if len(r.features.indices))
    assert abs(mine / theirs - 1) < 0.03
    assert all(abs(sum(r.theta) - 1) < 1e-9 and len(r.theta) == 10 for r in got.collect())
    assert got.count() == bow.select("doc_id").distinct().count()


def test_planted_topics_odd_rows_and_many_terms(spark):
    left, right = ["apple", "pear", "fruit"], ["car", "road", "wheel"]
    rows = [(str(i), w, 3) for i in range(40) for w in (left if i % 2 else right)] + [(None, "apple", 1), ("x", None, 1), ("y", "zero", 0)]
    bow = spark.createDataFrame(rows, "name string, term string, tf int")
    model = lda.fit_many(bow, "name", [2], max_iter=15)
    assert {x[2] for x in weights(model)} == {*left, *right}
    top = {r.key: int(np.argmax(r.theta)) for r in lda.document_topics(model).collect()}
    assert len(top) == 40 and len({top[str(i)] for i in range(0, 40, 2)}) == 1 and top["0"] != top["1"]
    # a vocabulary of many blocks, of which no task or driver holds the whole
    wide = spark.range(200).select(F.col("id").alias("name"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(299)), lambda j: F.concat(F.lit("t"), (F.col("id") * 300 + j).cast("string")))).alias("term"), F.lit(1).alias("tf"))
    many = lda.fit_many(wide, "name", [2], max_iter=1, block_terms=1000)
    assert many.blocks.count() > 50 and lda.term_weights(many).count() == 120_000


def test_e_step_has_a_bounded_part_in_hand():
    rng = np.random.default_rng(3)
    lengths = np.concatenate((rng.integers(0, 40, 5000), rng.integers(1, 9000, 60), [0, 20_000]))
    got = list(lda.chunks_of(lengths, 20))
    assert sorted(np.concatenate([d for d, _ in got])) == np.flatnonzero(lengths).tolist()
    for docs, longest in got:
        assert longest == lengths[docs].max()
        assert len(docs) == 1 or (len(docs) * longest * 20 <= lda.CHUNK and longest <= 1.125 * lengths[docs].min())
    assert len(got) < 400


def test_fewer_topics_make_larger_batches(spark):
    """A batch is sent each of its terms once: with few topics it may be larger."""
    bow = spark.range(60_000).select((F.col("id") % 3000).alias("id"), F.concat(F.lit("t"), F.floor(F.col("id") / 3000).cast("string")).alias("term"), F.lit(1).alias("tf"))
    few, many = (lda.prepare(bow, "id", ks, 1, pairs, 4096).batches.count() for ks, pairs in (([2], None), ([2], 2000)))
    assert few <= 2 * spark.sparkContext.defaultParallelism < 20 < many


def files_of_shuffles(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    files = env.blockManager().diskBlockManager().getAllFiles()
    every = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in every if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def test_a_fit_leaves_no_files_and_its_documents_stay_where_they_are(spark):
    """The files of a pass go with it, and what a pass exchanges does not grow with the pairs of a term."""
    bow = spark.range(20_000).select((F.col("id") % 500).alias("id"), F.concat(F.lit("t"), F.floor(F.col("id") / 500).cast("string")).alias("term"), F.lit(1).alias("tf")).checkpoint()
    before = files_of_shuffles(spark)
    model = lda.fit_many(bow, "id", [2, 3], max_iter=3)
    for _ in range(50):     # the files of SQL shuffles are removed in the background
        left = sum(n for f, n in files_of_shuffles(spark).items() if f not in before)
        if left > 1000:
            time.sleep(0.2)
    assert left <= 1000     # two counts, of a row each
    corpus = model.corpus
    for kept, others in ((corpus.packed, (corpus.asked,)), (corpus.wanted, (corpus.terms,))):
        assert all(kept.union(o).getNumPartitions() == kept.getNumPartitions() for o in others)
    assert corpus.pass_bytes == 16 * sum(len(r.terms) for r in corpus.batches.collect())


def test_groups_of_models_change_nothing(spark, monkeypatch):
    """Models that would exchange too much together take their passes one group after the other."""
    rows = [(d, f"t{(d * 7 + j * j) % 23}", 1 + (d + j) % 3) for d in range(40) for j in range(6)]
    bow = spark.createDataFrame(rows, "id long, term string, tf int")
    both = weights(lda.fit_many(bow, "id", [2, 3, 4], max_iter=3))
    monkeypatch.setattr(lda, "PASS_BYTES", 1)
    monkeypatch.setattr(lda, "PAIR_BYTES", 0)
    model = lda.fit_many(bow, "id", [2, 3, 4], max_iter=3)
    assert lda.groups_of([2, 3, 4], model.corpus) == [(0, 1), (1, 2), (2, 3)]
    apart = weights(model)
    assert both.keys() == apart.keys() and all(abs(both[x] - apart[x]) < 1e-9 for x in both)


def test_packed_batches_do_not_depend_on_how_their_parts_came():
    import pyarrow as pa
    rows = pa.record_batch([pa.array([0] * 6, pa.int32()), pa.array(["b", "a", "b", "a", "c", "b"]), pa.array(["y", "x", "z", "é", "x", "y"]), pa.array([1, 2, 3, 4, 5, 0.1])], ["batch", "key", "term", "tf"])
    parts = [p.column("part")[0].as_py() for b in (rows.slice(0, 2), rows.slice(2, 3), rows.slice(5)) for p in lda.small_parts([b])]
    one, other = lda.pack(parts), lda.pack(parts[::-1])
    assert one == other and one[1:] == (["a", "b", "c"], ["x", "y", "z", "é"])
    lengths, term, tf = lda.unpack(one[0])
    assert lengths.tolist() == [2, 3, 1] and term.tolist() == [0, 3, 1, 1, 2, 0] and tf.tolist() == [2, 4, 0.1, 1, 3, 5]
