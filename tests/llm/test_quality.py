"""Counts against brute force; the estimate against a plain version with numpy."""

from collections import Counter

import numpy as np
from odd import TEXTS, empty, odd, rows

from labelprism.llm import quality, queries
from tests.conftest import SF_ORACLE

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(text):
    text = text or ""
    words = text.encode().split()
    three = list(zip(words, words[1:], words[2:]))
    times = Counter(three)
    inside = {k + j for k, w in enumerate(three) if times[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    n = len(words)
    return (n, sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside),
            n < 50 or 100 * len(inside) > 50 * n)


def test_counts_of_odd_documents(spark):
    assert rows(quality.quality_rules(odd(spark)), "doc_id", *COUNTS) == sorted(((i, *brute(t)) for i, t in TEXTS), key=repr)
    assert quality.quality_rules(empty(spark)).collect() == []


def plain_mcd(x):
    """Squared distances of one group's rows."""
    p = x.shape[1]
    floor = np.diag(np.square(quality.FLOORS))

    def distance(centre, cov):
        y = np.linalg.solve(np.linalg.cholesky(cov + floor), (x - centre).T)
        return (y ** 2).sum(axis=0)

    d2 = distance(np.sort(x, axis=0)[(len(x) + 1) // 2 - 1], np.zeros((p, p)))
    for _ in range(quality.STEPS):
        bins = np.floor(np.log(d2 + 1e-9) * quality.BINS)
        before = np.array([(bins < b).sum() for b in bins])
        near = x[bins <= bins[before < quality.SUBSET * len(x)].max()]
        d2 = distance(near.mean(axis=0), np.cov(near.T, bias=True) * quality.SUBSET / quality.CONSISTENCY)
    near = x[d2 <= quality.NEAR]
    return distance(near.mean(axis=0), np.cov(near.T, bias=True))


def test_op7_on_whole_table(spark):
    """All documents against the plain version, group by group."""
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").collect()
    counts = {d.doc_id: brute(d.text) for d in docs}
    lines = {d.doc_id: max(sum(1 for x in (d.text or "").split("\n") if x.split()), 1) for d in docs}
    passed = [d for d in docs if not counts[d.doc_id][-1]]
    size = Counter((d.lang, d.source) for d in passed)
    left = Counter()
    for (lang, source), n in size.items():
        left[lang] += n if n < quality.LEAST else 0
    groups = {}
    for d in passed:
        name = (d.lang, d.source) if size[d.lang, d.source] >= quality.LEAST else (d.lang,) if left[d.lang] >= quality.LEAST else ()
        groups.setdefault(name, []).append(d.doc_id)
    d2 = {}
    for ids in groups.values():
        n, chars, symbols, dup, repeat = (np.array([counts[i][k] for i in ids], float) for k in range(5))
        x = np.column_stack((np.log(n), np.log(chars / n), np.sqrt(symbols / n), dup / [lines[i] for i in ids], repeat / n))
        d2 |= dict(zip(ids, plain_mcd(x)))
    assert len(groups) > 2
    got = queries.op7_quality(spark, SF_ORACLE).collect()
    assert {r.doc_id: tuple(r[c] for c in COUNTS) for r in got} == counts
    assert not [(r, d2[r.doc_id]) for r in got if r.doc_id in d2 and abs(d2[r.doc_id] - quality.CUTOFF) > 0.5 and r.kept != (d2[r.doc_id] <= quality.CUTOFF)]


def test_clean_documents_stay_and_symbol_soup_goes(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_ORACLE}/labels.parquet").collect()}
    got = [r for r in queries.op7_quality(spark, SF_ORACLE).collect() if r.doc_id in labels and not r.base_failed]
    kept = [labels[r.doc_id] for r in got if r.kept]
    gone = [labels[r.doc_id] for r in got if not r.kept]
    assert len(gone) > 10 and sum(gone) == 0 and 1 - np.mean(kept) < 0.02


def test_each_coordinate_alone_rejects(spark):
    """One planted document per coordinate among documents that do not vary."""
    words = [f"w{k:04d}" for k in range(500)]
    lines = words[:100]
    planted = {
        "length": "\n".join(words),
        "word length": "\n".join(f"{w}xx{w[0]}" if k % 2 else f"{w}xx" for k, w in enumerate(lines)),
        "symbols": "\n".join(f"{w[:-1]}#" if k < 7 else w for k, w in enumerate(lines)),
        "repeated lines": "\n".join(lines[:50] + lines[:50:2] + lines[1:50:2]),
        "repeated words": " ".join(lines[:76] + lines[:24]),
    }
    docs = [(k, "\n".join(lines), "en", "s") for k in range(200)] + [(1000 + k, t, "en", "s") for k, t in enumerate(planted.values())]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k].kept for k in range(200))
    assert not any(got[1000 + k].base_failed for k in range(5))
    assert [name for k, name in enumerate(planted) if got[1000 + k].kept] == []
