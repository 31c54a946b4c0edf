"""Benchmark decontamination against brute force."""

import re

import numpy as np
import pytest
from odd import PASSAGE, TEXTS, empty, odd, rows

from labelprism.llm import decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").encode().lower())


def brute(texts, items, window):
    out = []
    windows = {}
    for item, t in items:
        w = split(t)
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k: k + n]), set()).add(item)
    for i, t in texts:
        w = split(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (s := tuple(w[k: k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[s]
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, window=10, **more):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs, benchmark, window, **more)
    return rows(got, "doc_id", "n_words", "n_hit", "items", "contaminated")


def test_odd_documents(spark):
    items = [(1, PASSAGE.upper()), (2, None), (3, ""), (4, "lazy dog"), (5, "ÉCOLE"), (6, "la la la la la la la la la la la"), (1, "one"), (None, "other text")]
    assert run(spark, odd(spark), items) == brute(TEXTS, items, 10)


def test_empty_tables(spark):
    assert run(spark, empty(spark), [(1, PASSAGE)]) == []
    assert run(spark, odd(spark), []) == brute(TEXTS, [], 10)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_of_few_words(spark, seed):
    """Few words, so that prefixes are frequent and candidates fail; small blocks, so that there are several passes."""
    rng = np.random.default_rng(seed)
    alphabet = list("abcd") if seed else list("ab")
    text = lambda n: " ".join(rng.choice(alphabet, n))
    items = [(k, text(rng.integers(0, 14))) for k in range(12)]
    texts = [(k, text(rng.integers(0, 60))) for k in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert run(spark, docs, items, 6, broadcast_bytes=600) == brute(texts, items, 6)
