"""Marginals against enumeration, scores on documents that were held out."""

import itertools
import re
import zlib

import numpy as np
import pytest
from odd import TEXTS, empty, odd

from labelprism.llm import queries, toxicity
from tests.conftest import SF_SMALL


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    per_text = np.array([3, 0, 5, 1, 5], np.int64)
    weight, change = rng.normal(size=14), rng.normal(size=(2, 2))
    p, before, after = toxicity.marginals(weight, per_text, change)
    at = 0
    for n in per_text.tolist():
        total, on = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            x = np.exp(sum(weight[at + k] * y for k, y in enumerate(tags)) + sum(change[a, b] for a, b in zip(tags, tags[1:])))
            total += x
            on += x * np.array(tags)
        assert p[at: at + n] == pytest.approx(on / total)
        at += n


def test_document_numbers():
    p = np.array([0.5, 0.5, 0.0, 1.0])
    x = toxicity.of_document(p, np.array([2, 1, 0, 1]))
    assert x[0] == pytest.approx([np.log(0.75 / 0.25), np.log1p(1.0)])
    assert x[1, 1] == x[2, 1] == 0 and x[3, 0] == 12 and x[2, 0] == -12


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    plain = [f"{a}{b}" for a in "bdfgklmn" for b in ("ato", "eri", "ilo", "oma", "une")]
    docs, labels = [], []
    for i in range(400):
        words = list(rng.choice(plain, rng.integers(10, 60)))
        if bad := i % 5 == 0:
            for _ in range(3):
                words.insert(rng.integers(len(words)), rng.choice(["grubby.", "Vexling", "hatemorf" + str(rng.choice(plain))]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_and_spans(labelled):
    docs, labels = labelled
    model = toxicity.fit_toxicity(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = toxicity.toxicity_scores(docs, model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 40 and np.mean([(r.score >= 0.5) == (r.doc_id % 5 == 0) for r in held]) > 0.97
    found = [texts[r.doc_id][s.start: s.end] for r in got for s in r.spans]
    assert found and all(any(w.startswith(("grubby", "Vexling", "hatemorf")) for w in f.split()) for f in found)


def test_odd_rows(spark, labelled):
    model = toxicity.fit_toxicity(*labelled)
    got = toxicity.toxicity_scores(odd(spark), model).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((i for i, _ in TEXTS), key=repr)
    assert all(0 <= r.score < 0.5 for r in got)
    assert toxicity.toxicity_scores(empty(spark), model).collect() == []


def test_labels_that_do_not_help(spark, labelled):
    docs, _ = labelled
    for rows in ([], [(1, 1, 0), (2, 1, 0)], [(1, 1, None), (None, 1, 1), (3, 1, 7)]):
        model = toxicity.fit_toxicity(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert all(r.score < 0.5 for r in toxicity.toxicity_scores(docs, model).limit(5).collect())


def test_op9_on_whole_table(spark):
    """Every document once; the scores are those of the operator's model, of all columns alike."""
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert sorted(got) == sorted(d.doc_id for d in docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def plain_score(text, model):
    """Score and spans of one text: forward and backward sums place by place, in plain numbers."""
    words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    u, change = [(0.0, model.word(w)) for w, _, _ in words], np.asarray(model.change, float)
    n = len(words)
    up, down = np.zeros((n, 2)), np.zeros((n, 2))
    for k in range(n):
        for y in (0, 1):
            up[k, y] = u[k][y] + (np.logaddexp(up[k - 1, 0] + change[0, y], up[k - 1, 1] + change[1, y]) if k else 0)
    for k in range(n - 2, -1, -1):
        for y in (0, 1):
            down[k, y] = np.logaddexp(change[y, 0] + u[k + 1][0] + down[k + 1, 0], change[y, 1] + u[k + 1][1] + down[k + 1, 1])
    p = np.array([1 / (1 + np.exp(up[k, 0] + down[k, 0] - up[k, 1] - down[k, 1])) for k in range(n)])
    x = toxicity.of_document(p, np.array([n]))[0]
    spans, last = [], -2
    for k in np.flatnonzero(p >= 0.5).tolist():
        if last == k - 1:
            spans[-1][1] = words[k][2]
        else:
            spans.append([words[k][1], words[k][2]])
        last = k
    return 1 / (1 + np.exp(-(model.document[0] + x @ model.document[1:]))), int((p >= 0.5).sum()), ",".join(f"{a}:{b}" for a, b in spans)


def test_whole_query_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    texts = {d.doc_id: d.text for d in docs.collect()}
    got = queries.op9_toxicity(spark, SF_SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        score, n, offsets = plain_score(texts[r.doc_id], model)
        assert r.score == pytest.approx(score, abs=1e-6) and (r.n_toxic, r.offsets) == (n, offsets)
