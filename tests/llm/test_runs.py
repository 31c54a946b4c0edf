"""Periodic runs: convolution against all periods of small sequences, whole query against a plain version."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from odd import empty, odd

from labelprism.llm import queries, runs
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(x, least=24, times=3):
    """``start, length, period`` of all runs, every period tried over the whole sequence."""
    found = {}
    x = np.unique(x, return_inverse=True)[1] if len(x) else np.zeros(0)
    for q in range(1, len(x) // times + 1):
        same = np.concatenate(([0], x[q:] == x[:-q], [0])).astype(int)
        for s, e in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist()):
            if e - s + q >= max(least, times * q):
                found.setdefault((s, e - s + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def got_runs(x, **kw):
    return [(s, e - s, q) for s, e, q in runs.runs_in(np.asarray(x, np.int64), **kw).tolist()]


@pytest.mark.parametrize("kind", range(5))
def test_runs_of_small_sequences(kind):
    rng = np.random.default_rng(kind)
    thue = [0]
    for _ in range(8):
        thue += [1 - v for v in thue]
    for _ in range(25):
        n = int(rng.integers(0, 300))
        tiles = [np.tile(rng.integers(0, 3, int(rng.integers(1, 40))), int(rng.integers(1, 9))) for _ in range(40)]
        x = [rng.integers(0, 2, n), np.concatenate(tiles)[:n], np.zeros(n, int), np.array((thue[: n // 3]) * 3, int), rng.integers(0, 1 + n, n)][kind]
        for least in (24, 6, 3):
            assert got_runs(x, least=least) == plain_runs(list(x), least)
        assert got_runs(x, least=20, times=4) == plain_runs(list(x), 20, 4)


def test_convolution_is_exact():
    rng = np.random.default_rng(1)
    block, window = rng.integers(0, 1 << 20, (16, 3)).astype(np.uint64), rng.integers(0, 1 << 20, (64, 3)).astype(np.uint64)
    for p, root in runs.PRIMES:
        got = runs.squared_differences(block, window, p, root)
        want = [[sum((int(block[k, c]) - int(window[d + k, c])) ** 2 for k in range(16)) % p for c in range(3)] for d in range(49)]
        assert got.tolist() == want


def test_no_run_passes_from_text_to_text(spark):
    docs = spark.createDataFrame([(1, "a b " * 11), (2, "a b " * 12), (3, "a b " * 11), (4, "x " * 23 + "y"), (5, "x " * 24)], "doc_id long, text string")
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.text) for r in runs.periodic_runs(docs).collect()}
    assert got == {1: ([], " ".join("ab" * 11)), 2: ([(0, 24, 2)], "a b"), 3: ([], " ".join("ab" * 11)), 4: ([], "x " * 23 + "y"), 5: ([(0, 24, 1)], "x")}


def test_long_text_of_one_word_and_of_one_long_cycle(spark):
    docs = spark.createDataFrame([(1, "la " * 30_000), (2, " ".join(f"w{k}" for k in range(7_000)) + " " + " ".join(f"w{k}" for k in range(7_000)) + " "
                                                        + " ".join(f"w{k}" for k in range(7_000)))], "doc_id long, text string")
    got = {r.doc_id: ([tuple(x) for x in r.runs], len(r.text.split())) for r in runs.periodic_runs(docs).collect()}
    assert got == {1: ([(0, 30_000, 1)], 1), 2: ([(0, 21_000, 7_000)], 7_000)}


def plain_query(rows):
    out = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found = plain_runs(words)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
                    hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), n))
    return sorted(out, key=repr)


def test_whole_query_against_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op12_periodic_runs(spark, SF_SMALL).collect()), key=repr)
    assert got == plain_query(rows)
    assert sum(r[1] > 0 for r in got) >= 10


def test_odd_rows(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    assert len(rows) == 21
    for frame, want in ((odd(spark), plain_query([(i, t) for i, t in rows])), (empty(spark), [])):
        monkeypatch.setattr(queries, "read", lambda *a, frame=frame: frame)
        assert sorted(map(tuple, queries.op12_periodic_runs(spark, "").collect()), key=repr) == want
