"""The interval-based window counting of c_v against explicit windows."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from labelprism.operators.coherence import coherence_cv, window_counts


def brute(docs, topics, w):
    relevant = {t for ws in topics.values() for t in ws}
    windows = []
    for toks in docs:
        if not relevant & set(toks):
            continue
        n = len(toks)
        if n < w:
            windows.append(set(toks))
        else:
            windows.extend(set(toks[s:s + w]) for s in range(n - w + 1))
    nw = len(windows)
    p = {t: sum(t in s for s in windows) / nw for t in relevant}

    def npmi(a, b):
        if a == b:
            pab = p[a]
        else:
            pab = sum(a in s and b in s for s in windows) / nw
        if p[a] == 0 or p[b] == 0:
            return 0.0
        num = pab + 1e-12
        return math.log(num / (p[a] * p[b])) / -math.log(num)

    out = {}
    for t, ws in topics.items():
        vec = {a: [npmi(a, b) for b in ws] for a in ws}
        tot = [sum(vec[a][j] for a in ws) for j in range(len(ws))]
        cs = []
        for a in ws:
            dot = sum(x * y for x, y in zip(vec[a], tot))
            nn = math.sqrt(sum(x * x for x in vec[a]) * sum(y * y for y in tot))
            cs.append(dot / nn if nn else 0.0)
        out[t] = sum(cs) / len(cs)
    return out, nw


@pytest.mark.parametrize("w", [1, 3, 6])
def test_cv_matches_explicit_windows(spark, w):
    rng = random.Random(w)
    vocab = list("abcdefgh")
    docs = [[rng.choice(vocab) for _ in range(rng.randint(1, 15))] for _ in range(40)]
    docs.append(["zz"])                            # irrelevant document: no windows
    topics = {0: ["a", "b", "c"], 1: ["c", "d", "e", "h"]}
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id long, toks array<string>")
    tw = spark.createDataFrame([(t, x) for t, ws in topics.items() for x in ws], "topic int, term string")
    nwin, _, _ = window_counts(df, "id", "toks", tw, w)
    want, nw = brute(docs, topics, w)
    assert df.sparkSession.range(1).select(nwin).first()[0] == nw
    got = {r.topic: r.coherence for r in coherence_cv(df, "id", "toks", tw, w).collect()}
    for t in topics:
        assert got[t] == pytest.approx(want[t], abs=1e-9)


def test_counts_make_no_row_per_token_and_count_shared_words_once(spark):
    """Topics of the same words, in a table with repeated and null keys and a null text."""
    rng = random.Random(5)
    docs = [[rng.choice(list("abcdefgh")).upper() for _ in range(rng.randint(1, 30))] for _ in range(20)]
    rows = [(i, d) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows + [(None, ["a", "b"]), (99, None)], "id long, toks array<string>")
    many = {t: ["a", "b", "c", "d"] for t in range(40)} | {40: ["d", "e"]}
    tw = spark.createDataFrame([(t, x) for t, ws in many.items() for x in ws], "topic int, term string")
    want, nw = brute([[t.lower() for t in d] for d in docs], many, 4)
    n, words, pairs = window_counts(df, "id", "toks", tw, 4)
    assert spark.range(1).select(n).first()[0] == nw
    plan = pairs._jdf.queryExecution().toString() + words._jdf.queryExecution().toString()
    assert "Generate" not in plan and "posexplode" not in plan
    got = {r.topic: r.coherence for r in coherence_cv(df, "id", "toks", tw, 4).collect()}
    assert all(got[t] == pytest.approx(want[t], abs=1e-9) for t in many)
    # a document that comes twice has its islands once and its windows twice
    n2, words2, _ = window_counts(df.unionByName(df), "id", "toks", tw, 4)
    assert spark.range(1).select(n2).first()[0] == 2 * nw
    assert sorted(words.collect()) == sorted(words2.collect())


def test_many_words_and_long_documents_in_parts(spark, monkeypatch):
    from labelprism.operators import coherence
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(30)]
    docs = [[rng.choice(vocab) for _ in range(200)] for _ in range(6)]
    left, right = (np.array(x) for x in zip(*itertools.combinations(range(30), 2)))
    monkeypatch.setattr(coherence, "CELLS", 30 * 64)
    monkeypatch.setattr(coherence, "ROWS", 7)
    rows = pa.record_batch([pa.array(range(6)), pa.array([200] * 6), pa.array([list(range(200))] * 6, pa.list_(pa.int32())),
                            pa.array([[vocab.index(t) for t in d] for d in docs], pa.list_(pa.int32()))], ["key", "n", "p", "id"])
    (got,) = coherence._sums(30, left, right, 5)(iter([rows]))
    n = {(r["kind"], r["id"]): r["n"] for r in got.to_pylist()}
    windows = [set(d[s:s + 5]) for d in docs for s in range(196)]
    assert n[2, 0] == len(windows)
    assert all(n.get((0, i), 0) == sum(t in w for w in windows) for i, t in enumerate(vocab))
    assert all(n.get((1, i), 0) == sum(vocab[a] in w and vocab[b] in w for w in windows) for i, (a, b) in enumerate(zip(left, right)))


def test_heaviest_terms_of_every_remainder():
    from labelprism.plans.queries import _heaviest_by_remainder
    rng = random.Random(7)
    rows = [(f"t{rng.randint(0, 99)}", rng.randint(-50, 50), rng.randint(1, 3)) for _ in range(3000)]
    batches = [pa.record_batch([pa.array(c) for c in zip(*rows[s:s + 700])], ["term", "doc_id", "tf"]) for s in range(0, 3000, 700)]
    got = [tuple(r.values()) for b in _heaviest_by_remainder(range(2, 6), 4)(iter(batches)) for r in b.to_pylist()]
    want = []
    for k in range(2, 6):
        for t in range(k):
            n: dict = {}
            for term, doc, tf in rows:
                if doc % k == t:
                    n[term] = n.get(term, 0) + tf
            want += [(k, t, term, c) for term, c in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:4]]
    assert got == want
