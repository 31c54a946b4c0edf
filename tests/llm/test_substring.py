"""Substring dedup against brute force over all windows."""

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from odd import PASSAGE, TEXTS, empty, odd, rows

from labelprism.llm import queries, substring
from tests.conftest import SF_SMALL


def brute(texts, window):
    """``(doc_id, n_words, kept text)`` of each row; rows with one id and one text are one document."""
    documents = {}
    for i, t in texts:
        documents.setdefault((i is not None, i or 0, t or ""), None)
    ids = {}
    for key in documents:
        ids.setdefault(key[:2], []).append(key[2])
    assert all(len(v) == 1 for v in ids.values()), "ties between texts of one id have no order here"
    seen, kept = set(), {}
    for key in sorted(documents):
        words = key[2].encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            w = tuple(words[k: k + window])
            if w in seen:
                gone[k: k + window] = [True] * window
            seen.add(w)
        kept[key] = len(words), b" ".join(w for w, g in zip(words, gone) if not g).decode()
    return sorted(((i, *kept[i is not None, i or 0, t or ""]) for i, t in texts), key=repr)


def run(spark, texts, window=20, block=substring.BLOCK, parts=3):
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)
    return substring.substring_dedup(df, window, block)


def test_odd_documents(spark):
    texts = [x for x in TEXTS if x[0] not in (9, None)]
    assert rows(run(spark, texts), "doc_id", "n_words", "text") == brute(texts, 20)


def test_extra_columns_nulls_and_empty_table(spark):
    got = substring.substring_dedup(odd(spark), 20)
    assert got.columns == ["doc_id", "id", "tag", "n_words", "n_removed", "text", "factors"]
    assert got.count() == len(TEXTS)
    assert substring.substring_dedup(empty(spark)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_random_copies_and_edits(spark, seed):
    """Few words, so that anchors repeat in many contexts; small blocks, so that places meet across blocks."""
    rng = np.random.default_rng(seed)
    window = int(rng.choice([3, 5, 9, 20]))
    alphabet = [f"w{k}" for k in range(int(rng.choice([2, 4, 40])))]
    base = [list(rng.choice(alphabet, rng.integers(0, 120))) for _ in range(6)]
    texts = []
    for i in range(40):
        words = list(base[rng.integers(len(base))])
        for _ in range(rng.integers(0, 4)):
            if words:
                words[rng.integers(len(words))] = str(rng.choice(alphabet))
        cut = rng.integers(0, len(words) + 1)
        texts.append((i, " ".join(words[cut:] + words[: cut // 2])))
    assert rows(run(spark, texts, window, block=64), "doc_id", "n_words", "text") == brute(texts, window)


def test_factors_point_at_the_source(spark):
    got = {r.doc_id: r for r in run(spark, [(1, f"a b {PASSAGE} c"), (2, f"x {PASSAGE} y z"), (3, "short")]).collect()}
    assert [tuple(f) for f in got[2].factors] == [(1, 60, 1, 2)]
    assert got[2].text == "x y z" and got[2].n_removed == 60 and got[1].n_removed == 0 == got[3].n_removed


def test_op1_on_whole_table(spark):
    texts = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = []
    for i, n, kept in brute(texts, 20):
        want.append((i, n, n - len(kept.split()), hashlib.sha256(kept.encode()).hexdigest()))
    got = rows(queries.op1_substring_dedup(spark, SF_SMALL), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(want, key=repr) and sum(x[2] for x in want) > 0


@pytest.mark.parametrize("known", [1, 50, 1 << 19])
def test_blocks_that_share_a_passage(spark, monkeypatch, known):
    """One passage in a third of 100 blocks; what a task remembers of its blocks changes nothing."""
    monkeypatch.setattr(substring, "index_blocks", functools.partial(substring.index_blocks, most=known))
    rng = np.random.default_rng(9)
    texts = [(int(i), " ".join(rng.choice([f"v{k}" for k in range(400)], 60)) + (f" {PASSAGE} " if i % 3 == 0 else " ") + f"end{i}") for i in rng.permutation(100)]
    assert rows(run(spark, texts, block=64, parts=2), "doc_id", "n_words", "text") == brute(texts, 20)


def test_remembered_stretches_leave_a_task_once():
    """Of the stretches of a passage that every block has, a task sends on the first block's alone."""
    passage = [f"p{k}" for k in range(60)]
    batch = pa.record_batch([pa.array(range(40)), pa.array([0] * 40), pa.array([" ".join([*passage, f"x{k}"]).encode() for k in range(40)])], ["id", "mark", "body"])
    got = pa.Table.from_batches(substring.index_blocks(20, 64)(iter([batch]))).to_pydict()
    sent = [(i, o) for i, o in zip(got["id"], got["o"]) if o >= 0]
    assert sum(i > 0 for i, _ in sent) <= 39 * 2 < sum(o < 0 for o in got["o"]) * 3
    assert {i for i, o in zip(got["id"], got["o"]) if o < 0} == set(range(1, 40))


def test_parse_takes_what_reaches_furthest():
    factors = [0, 10, 1, 100, 4, 20, 2, 50, 6, 8, 3, 0, 30, 5, 1, 7]
    phrases, gone = substring.parse(factors, 40)
    assert [tuple(p.values()) for p in phrases] == [(0, 10, 1, 100), (10, 14, 2, 56), (30, 5, 1, 7)]
    assert gone.tolist() == [k < 24 or 30 <= k < 35 for k in range(40)]


def test_texts_of_one_id_get_marks_of_their_own(spark, monkeypatch):
    """A seed under which two texts of an id have one mark is passed over."""
    real, seeds = substring.F.xxhash64, []

    def weak(*columns):
        seeds.append(len(seeds))
        return real(*columns) if len(seeds) > 2 else real(columns[0])

    docs = spark.createDataFrame([(None, f"text {k}") for k in range(5)] + [(1, "one")], "doc_id long, text string")
    monkeypatch.setattr(substring.F, "xxhash64", weak)
    got = substring.marked_bodies(docs)
    assert len(seeds) == 3 and got.select("id", "mark").distinct().count() == 6
