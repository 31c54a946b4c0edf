"""Lattice scores against enumeration of all segmentations, base scores against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from odd import TEXTS, empty, odd, rows

from labelprism.llm import lattice, queries
from labelprism.llm.common import public_path
from tests.conftest import SF_SMALL


def split(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def ways(word, logp, byte_logp):
    """Log probabilities and pieces of all segmentations."""
    if not word:
        return [(0.0, [])]
    out = []
    for k in range(1, len(word) + 1):
        piece = word[:k]
        if piece in logp:
            first, name = logp[piece], piece
        elif k == 1:
            first, name = len(piece.encode()) * byte_logp, ("bytes", len(piece.encode()))
        else:
            continue
        out += [(first + p, [name, *rest]) for p, rest in ways(word[k:], logp, byte_logp)]
    return out


def test_forward_and_expected_counts_against_enumeration():
    rng = np.random.default_rng(2)
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aab", "é", "▁ab"]
    logp = np.log(rng.dirichlet(np.ones(len(pieces))))
    vocabulary = lattice.Vocabulary(pieces, logp, math.log(1e-3))
    words = ["".join(rng.choice(list("abéz漢"), rng.integers(0, 7))) for _ in range(60)]
    got, counts, want = np.zeros(60), np.zeros(len(pieces) + 1), Counter()
    for places, text in lattice.by_length(words):
        got[places] = vocabulary.forward(text)[:, -1]
        vocabulary.expected(text, places + 1.0, counts)
    for k, w in enumerate(words):
        all_ways = ways("▁" + w, dict(zip(pieces, logp)), math.log(1e-3))
        total = np.logaddexp.reduce([p for p, _ in all_ways])
        assert got[k] == pytest.approx(total)
        for p, names in all_ways:
            for name in names:
                want[name if isinstance(name, str) else "bytes"] += (k + 1) * math.exp(p - total) * (1 if isinstance(name, str) else name[1])
    assert counts == pytest.approx([want[p] for p in [*pieces, "bytes"]])


def base(texts):
    train = Counter(w for i, t in texts if not held(i) for w in [*split(t), None])
    n, kinds = sum(train.values()), len(train)
    out = []
    for i, t in texts:
        words = [*split(t), None]
        out.append((i, held(i), len(words), sum(train[w] > 0 for w in words), n, sum(math.log10((train[w] + 1) / (n + kinds + 1)) for w in words)))
    return out, train


COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def close(got, want):
    got, want = sorted(got, key=lambda r: repr(r[:3])), sorted(want, key=lambda r: repr(r[:3]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)


@pytest.mark.parametrize("hot", [1, lattice.HOT_WORDS])
def test_odd_documents(spark, hot):
    texts = [x for x in TEXTS if x[0] != 9]  # two rows there differ in nothing that sorts them here
    pieces, logp = lattice.sentencepiece_scores(public_path("piece_bpe_32k.model"))
    docs = odd(spark).where("doc_id is null or doc_id <> 9")
    got = rows(lattice.lm_scores(docs, pieces, logp, hot_words=hot), *COLUMNS)
    want, train = base(texts)
    close(got, want)
    assert all(math.isfinite(r[6]) and r[6] < 0 for r in got)


def test_scores_are_the_fitted_lattice(spark):
    """The whole way, against rounds of the recursions over one plain table of words."""
    pieces, logp = lattice.sentencepiece_scores(public_path("piece_bpe_32k.model"))
    texts = [(k, " ".join(f"word{j % 7}x{(j * k) % 5}" for j in range(k))) for k in range(30)]
    got = {r.doc_id: r.score for r in lattice.lm_scores(spark.createDataFrame(texts, "doc_id long, text string"), pieces, logp, rounds=2).collect()}
    _, train = base(texts)
    ends = train.pop(None)
    model = lattice.Vocabulary(pieces, logp, float(logp.min()))
    for _ in range(2):
        counts = np.zeros(len(pieces) + 1)
        for places, text in lattice.by_length(list(train)):
            model.expected(text, np.array(list(train.values()), float)[places], counts)
        full = np.append(counts + lattice.SMOOTHING, ends + lattice.SMOOTHING)
        new = np.log(full / full.sum())
        model, end = lattice.Vocabulary(pieces, new[:-2], new[-2] - math.log(256)), new[-1]
    for k, t in texts:
        want = end
        for w in split(t):
            (_, chars), = lattice.by_length([w])
            want += model.forward(chars)[0, -1]
        assert got[k] == pytest.approx(want / math.log(10))


def segmentations(text, pieces):
    """All ways to cut a text into pieces; a character that is none is spelled by its bytes."""
    if not text:
        yield ()
    for k in range(1, len(text) + 1):
        if text[:k] in pieces or k == 1:
            for rest in segmentations(text[k:], pieces):
                yield (text[:k], *rest)


def test_scores_against_all_segmentations(spark):
    """Two rounds of expected counts and the scores, every segmentation of every word written out."""
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab", "aba", "c"]
    logp = np.log(np.arange(1, 11) / 55)
    texts = [(k, t) for k, t in enumerate(["ab abab", "aba c", "babab ab", "é ab", "", None, "A B c", "abababa", "cab bac abc", "ba"] * 3)]
    got = {r.doc_id: r.score for r in lattice.lm_scores(spark.createDataFrame(texts, "doc_id long, text string"), pieces, logp, rounds=2).collect()}
    train = Counter(w for i, t in texts if not held(i) for w in split(t))
    ends = sum(not held(i) for i, _ in texts)
    p, byte, end = dict(zip(pieces, np.exp(logp))), float(np.exp(logp.min())), None

    def weight(cut):
        return math.prod(p[x] if x in p else byte ** len(x.encode()) for x in cut)

    for _ in range(2):
        expected = Counter()
        for word, n in train.items():
            every = [(cut, weight(cut)) for cut in segmentations("▁" + word, p)]
            total = sum(w for _, w in every)
            for cut, w in every:
                for x in cut:
                    expected[x if x in p else None] += n * w / total * (1 if x in p else len(x.encode()))
        mass = {x: expected[x] + lattice.SMOOTHING for x in [*pieces, None]} | {"end": ends + lattice.SMOOTHING}
        whole = sum(mass.values())
        p, byte, end = {x: mass[x] / whole for x in pieces}, mass[None] / whole / 256, mass["end"] / whole
    for i, t in texts:
        want = math.log10(end) + sum(math.log10(sum(weight(c) for c in segmentations("▁" + w, p))) for w in split(t))
        assert got[i] == pytest.approx(want)


def test_long_words_walk_alike():
    """One long word by itself and the same word in a matrix of words, forwards and in expected counts."""
    pieces, logp = lattice.sentencepiece_scores(public_path("piece_bpe_32k.model"))
    model = lattice.Vocabulary(pieces, logp, float(logp.min()))
    rng = np.random.default_rng(0)
    word = "".join(rng.choice(list("etaoinshr🎉é日0/"), 400))
    (_, chars), = lattice.by_length([word])
    assert model.long_forward(chars[0]) == pytest.approx(model.forward(chars)[0, -1])
    a, b = np.zeros(len(pieces) + 1), np.zeros(len(pieces) + 1)
    model.expected(chars, np.array([3.0]), a)
    model.long_expected(chars[0], 3.0, b)
    assert np.allclose(a, b)


def test_word_of_a_megabyte():
    import base64
    import time

    pieces, logp = lattice.sentencepiece_scores(public_path("piece_bpe_32k.model"))
    model = lattice.Vocabulary(pieces, logp, float(logp.min()))
    word = base64.b64encode(np.random.default_rng(1).bytes(3 << 18)).decode()
    start = time.perf_counter()
    (_, chars), = lattice.by_length([word])
    assert math.isfinite(model.long_forward(chars[0])) and len(word) == 1 << 20
    model.long_expected(chars[0], 1.0, np.zeros(len(pieces) + 1))
    assert time.perf_counter() - start < 60


def test_fit_helps_on_held_out_rows(spark):
    pieces, logp = lattice.sentencepiece_scores(public_path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    mean = [lattice.lm_scores(docs, pieces, logp, rounds=k).where("held_out").agg({"score": "avg"}).head()[0] for k in (0, 1, 2)]
    assert mean[0] < mean[1] < mean[2]


def test_common_long_word_is_hot(spark, monkeypatch):
    """A word of 80 letters in a third of the documents does not go through the join; a table of few bytes changes nothing."""
    pieces, logp = lattice.sentencepiece_scores(public_path("piece_bpe_32k.model"))
    docs = spark.createDataFrame([(k, f"{'=' * 80 if k % 3 == 0 else ''} word{k % 11} other{k}") for k in range(120)], "doc_id long, text string")
    a = rows(lattice.lm_scores(docs, pieces, logp), *COLUMNS)
    monkeypatch.setattr(lattice, "HOT_BYTES", 100)
    b = rows(lattice.lm_scores(docs, pieces, logp), *COLUMNS)
    assert [r[:5] for r in a] == [r[:5] for r in b] and [r[6] for r in a] == pytest.approx([r[6] for r in b])


def test_empty_table(spark):
    pieces, logp = lattice.sentencepiece_scores(public_path("piece_bpe_32k.model"))
    assert lattice.lm_scores(empty(spark), pieces, logp).collect() == []


def test_op6_on_whole_table(spark):
    texts = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = rows(queries.op6_lm_scores(spark, SF_SMALL), *COLUMNS)
    close(got, base(texts)[0])
    assert all(math.isfinite(r[6]) and r[6] < 0 for r in got)
