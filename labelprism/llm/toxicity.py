"""Toxicity by a linear-chain conditional random field.

Labels belong to documents, tags to words.  On a bounded sample of labelled
documents:

1. *signals* are words and word beginnings that toxic documents have far more
   often than clean ones (a likelihood-ratio statistic and an odds ratio);
2. words of toxic documents that carry a signal are the labelled tokens;
3. the field has two states, a weight per signal and weights for the changes of
   state; its likelihood is climbed by damped Newton steps on the diagonal, each
   one a Spark job that sums the documents' forward-backward expectations;
4. a logistic model turns a document's marginals into its score.

The whole table is then tagged: forward-backward marginals of every word, the
document's score from them, and the places of words that are toxic more likely
than not.  Neither labels nor language, source or id take part in a score.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelprism.llm.common import Words, bodies, cut, edges, slices, words_of

__all__ = ["ToxicityModel", "training_row", "fit_toxicity", "toxicity_scores", "marginals"]

#: Labelled documents to learn from, at most: of the toxic and of the clean ones, by a hash of their id.
TOXIC_SAMPLE, CLEAN_SAMPLE = 4000, 12000
#: Lengths of word beginnings.
STEMS = (4, 5, 6, 7, 8)
#: What makes a signal: toxic documents that have it, likelihood-ratio statistic, odds ratio; and how many at most.
LEAST_DOCS, LEAST_G, LEAST_ODDS, MOST_SIGNALS = 4, 24.0, 15.0, 20_000
STEPS, RATE, RIDGE = 12, 0.7, 1.0
#: Words whose weight a Python worker remembers at most.
REMEMBERED = 1 << 19
BARE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def training_row() -> Column:
    """Rows to learn from: crc32 of ``doc_id`` as text, modulo 5, is not 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0


def features(word: str) -> list[str]:
    """The bare word in lower case and its beginnings."""
    bare = BARE.sub("", word).lower()
    return [f"={bare}", *(f"^{bare[:k]}" for k in STEMS if len(bare) >= k)] if bare else []


@dataclass
class ToxicityModel:
    """Weights: of signals, of state 1 as such, of staying and changing (from, to; 0 to 0 is 0), and of the document's score."""

    signals: dict[str, float]
    bias: float
    change: np.ndarray
    document: np.ndarray

    def word(self, word: str) -> float:
        get = self.signals.get
        return self.bias + sum([get(f, 0.0) for f in features(word)])


def marginals(weight: np.ndarray, per_text: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``p`` of state 1 at each place of each text, and the log odds from before and from after it.

    All texts step at once, the long ones alone in the end.
    """
    texts = np.argsort(-per_text, kind="stable")
    starts, length = edges(per_text)[:-1][texts], per_text[texts]
    active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")  # texts longer than each place
    before, after = np.zeros(len(weight)), np.zeros(len(weight))
    (t00, t01), (t10, t11) = change
    odds = np.zeros(len(texts))
    for t, k in enumerate(active):
        at = starts[:k] + t
        if t:
            last = odds[:k]
            before[at] = np.logaddexp(t01, t11 + last) - np.logaddexp(t00, t10 + last)
        odds[:k] = before[at] + weight[at]
    odds[:] = 0
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        more = active[t + 1] if t + 1 < len(active) else 0
        if more:
            nxt = odds[:more]
            after[at[:more]] = np.logaddexp(t10, t11 + nxt) - np.logaddexp(t00, t01 + nxt)
        odds[:k] = after[at] + weight[at]
    return 1 / (1 + np.exp(-np.clip(before + weight + after, -700, 700))), before, after


def of_document(p: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Log odds that any word is toxic, and log of the expected number of toxic words, per text."""
    ends = edges(per_text)
    none = np.diff(np.concatenate((np.zeros(1), np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))))[ends])
    mean = np.diff(np.concatenate((np.zeros(1), np.cumsum(p)))[ends])
    none = np.minimum(none, -1e-6)
    return np.column_stack((np.clip(np.log(-np.expm1(none)) - none, -12, 12), np.log1p(np.maximum(mean, 0))))


def sample_of(docs: DataFrame, labels: DataFrame, toxic: int, clean: int) -> tuple[DataFrame, np.ndarray]:
    """``body, label`` of the sampled documents, and the share of each class that is in it."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic in (0, 1)").where(training_row())
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")))
    count = dict(known.groupBy("label").count().collect())
    order = F.xxhash64("doc_id")
    chosen = known.where("label = 1").orderBy(order, "doc_id").limit(toxic).unionByName(known.where("label = 0").orderBy(order, "doc_id").limit(clean))
    share = np.array([min(1.0, clean / max(count.get(0, 0), 1)), min(1.0, toxic / max(count.get(1, 0), 1))])
    # a bounded number of ids
    return bodies(docs).withColumn("body", F.col("body").cast("string")).join(F.broadcast(chosen), "doc_id").select("body", "label"), share


def find_signals(sample: DataFrame) -> dict[str, int]:
    """Signals and their numbers."""

    def count(batches):
        seen = [Counter(), Counter()]
        for b in slices(batches):
            words = words_of(b.column("body"))
            of_word = [features(w) for w in words.distinct.to_pylist()]
            ends = edges(words.per_text)
            for k, label in enumerate(b.column("label").to_pylist()):
                codes = np.unique(words.codes[ends[k]: ends[k + 1]])
                seen[label].update({f for c in codes.tolist() for f in of_word[c]})
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([seen[0][f] for f in names], pa.int64()), pa.array([seen[1][f] for f in names], pa.int64())], ["f", "clean", "toxic"])

    n = dict(sample.groupBy("label").count().collect())
    if not n.get(0) or not n.get(1):
        return {}
    n0, n1 = float(n[0]), float(n[1])
    a, b = F.col("toxic"), F.col("clean")
    part = lambda x, share: F.when(x > 0, x * F.log(x / ((a + b) * share))).otherwise(0.0)
    odds = ((a + 0.5) / (n1 - a + 0.5)) / ((b + 0.5) / (n0 - b + 0.5))
    g = 2 * (part(a, n1 / (n0 + n1)) + part(b, n0 / (n0 + n1)))
    counts = sample.mapInArrow(count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = counts.where(a >= LEAST_DOCS).withColumns({"odds": odds, "g": g}).where((F.col("odds") >= LEAST_ODDS) & (F.col("g") >= LEAST_G))
    return {r.f: k for k, r in enumerate(found.orderBy(F.desc("g"), "f").limit(MOST_SIGNALS).collect())}


def fit_toxicity(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_SAMPLE, clean: int = CLEAN_SAMPLE) -> ToxicityModel:
    """Fit to at most so many labelled documents of each class; without both classes the model says clean."""
    sc = docs.sparkSession.sparkContext
    sample, share = sample_of(docs, labels, toxic, clean)
    sample = cut(sample)
    number = find_signals(sample)
    if not number:
        return ToxicityModel({}, -20.0, np.zeros((2, 2)), np.array([-10.0, 0.0, 0.0]))
    shared = sc.broadcast(number)

    def tokens(batches):
        """Per document: words, which signals stand where, and its label."""
        for b in slices(batches):
            words = words_of(b.column("body"))
            of_word = [[shared.value[f] for f in features(w) if f in shared.value] for w in words.distinct.to_pylist()]
            ends = edges(words.per_text)
            at, signal = [], []
            for k in range(b.num_rows):
                found = [(t, s) for t, c in enumerate(words.codes[ends[k]: ends[k + 1]].tolist()) for s in of_word[c]]
                at.append([t for t, _ in found])
                signal.append([s for _, s in found])
            yield pa.record_batch([b.column("label"), pa.array(words.per_text.astype(np.int32)), pa.array(at, pa.list_(pa.int32())), pa.array(signal, pa.list_(pa.int32()))],
                                  ["label", "n", "at", "signal"])

    rows = cut(sample.mapInArrow(tokens, "label int, n int, at array<int>, signal array<int>"))
    size = len(number)
    # after the signals: bias, then the changes 0-1, 1-0, 1-1
    w = np.zeros(size + 4)
    w[size] = -3.0

    def read(b):
        per_text = np.asarray(b.column("n")).astype(np.int64)
        start = edges(per_text)
        place = np.repeat(start[:-1], np.diff(np.asarray(b.column("at").offsets))) + np.asarray(b.column("at").flatten())
        return per_text, place, np.asarray(b.column("signal").flatten())

    def weights(model, per_text, place, signal):
        u = np.full(int(per_text.sum()), model[size])
        np.add.at(u, place, model[signal])
        change = np.array([[0.0, model[size + 1]], [model[size + 2], model[size + 3]]])
        return u, change

    for _ in range(STEPS):
        model = sc.broadcast(w)

        def climb(batches, model=model):
            grad, curve = np.zeros(size + 4), np.full(size + 4, 1e-9)
            for b in batches:
                per_text, place, signal = read(b)
                u, change = weights(model.value, per_text, place, signal)
                p, before, after = marginals(u, per_text, change)
                y = np.zeros(len(u))
                y[place[np.repeat(np.asarray(b.column("label")), np.diff(np.asarray(b.column("at").offsets))) == 1]] = 1
                grad[:size] += np.bincount(signal, (y - p)[place], size)
                curve[:size] += np.bincount(signal, (p * (1 - p))[place], size)
                grad[size] += (y - p).sum()
                curve[size] += (p * (1 - p)).sum()
                text = np.repeat(np.arange(len(per_text)), per_text)
                t = np.flatnonzero(np.diff(text) == 0)  # places with another after them in their text
                left, right = before[t] + u[t], u[t + 1] + after[t + 1]
                both = np.stack((np.zeros(len(t)), change[0, 1] + right, change[1, 0] + left, change[1, 1] + left + right))
                both -= np.logaddexp.reduce(both, axis=0)
                seen = np.stack(((1 - y[t]) * y[t + 1], y[t] * (1 - y[t + 1]), y[t] * y[t + 1]))
                share = np.exp(both[1:])
                grad[size + 1:] += (seen - share).sum(axis=1)
                curve[size + 1:] += (share * (1 - share)).sum(axis=1)
            yield pa.record_batch([pa.array(np.arange(size + 4)), pa.array(grad), pa.array(curve)], ["k", "grad", "curve"])

        total = rows.mapInArrow(climb, "k long, grad double, curve double").groupBy("k").agg(F.sum("grad").alias("grad"), F.sum("curve").alias("curve")).toArrow().sort_by("k")
        grad, curve = np.asarray(total["grad"]), np.asarray(total["curve"])
        prior = np.append(np.zeros(size), [-3.0, 0, 0, 0])
        w = w + RATE * np.clip((grad - RIDGE * (w - prior)) / (curve + RIDGE), -2, 2)

    model = sc.broadcast(w)

    def documents(batches):
        for b in batches:
            per_text, place, signal = read(b)
            u, change = weights(model.value, per_text, place, signal)
            x = of_document(marginals(u, per_text, change)[0], per_text)
            yield pa.record_batch([b.column("label"), pa.array(x[:, 0]), pa.array(x[:, 1])], ["label", "any", "mean"])

    # two numbers for each sampled document
    table = rows.mapInArrow(documents, "label int, any double, mean double").toArrow()
    x = np.column_stack((np.ones(table.num_rows), np.asarray(table["any"]), np.asarray(table["mean"])))
    y = np.asarray(table["label"]).astype(float)
    beta = logistic(x, y, 1 / share[y.astype(int)])
    names = {f: float(w[k]) for f, k in number.items()}
    change = np.array([[0.0, w[size + 1]], [w[size + 2], w[size + 3]]])
    return ToxicityModel(names, float(w[size]), change, beta)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights by Newton's method, held near zero."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(beta))
        beta = beta + np.linalg.solve(hessian, x.T @ (weight * (y - p)) - beta)
    return beta


_WEIGHTS: dict[str, dict[str, float]] = {}


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score, n_toxic, spans`` of every row, ``spans`` in characters of the text.

    Words are cut at ASCII white space; neighbouring toxic words make one span.
    Null and empty texts have the score of no words.  Repeated rows get equal
    rows; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    call = uuid.uuid4().hex

    def run(batches):
        model = shared.value
        if call not in _WEIGHTS:
            _WEIGHTS.clear()
            _WEIGHTS[call] = {}
        known = _WEIGHTS[call]
        for b in slices(batches):
            words: Words = words_of(b.column("body"))
            distinct = words.distinct.to_pylist()
            for w in distinct:
                if w not in known:
                    known[w] = model.word(w)
            u = np.array([known[w] for w in distinct], float)[words.codes]
            if len(known) > REMEMBERED:
                known.clear()
            p, _, _ = marginals(u, words.per_text, model.change)
            x = of_document(p, words.per_text)
            score = 1 / (1 + np.exp(-(model.document[0] + x @ model.document[1:])))
            ends = edges(words.per_text)
            toxic = p >= 0.5
            n_toxic = np.diff(edges(toxic)[ends])
            spans = [[] if not n else spans_of(b.column("body")[k].as_py(), toxic[ends[k]: ends[k + 1]]) for k, n in enumerate(n_toxic.tolist())]
            yield pa.record_batch([b.column("doc_id"), pa.array(score), pa.array(n_toxic), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                                  ["doc_id", "score", "n_toxic", "spans"])

    source = bodies(docs).withColumn("body", F.col("body").cast("string"))
    return source.mapInArrow(run, "doc_id long, score double, n_toxic long, spans array<struct<start:long,end:long>>")


def spans_of(text: str, toxic: np.ndarray) -> list[dict]:
    out: list[dict] = []
    last = -2
    for k, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)):
        if toxic[k]:
            if last == k - 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            last = k
    return out
