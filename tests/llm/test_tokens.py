"""BPE encoding and decoding, token files and piece counts against the libraries or brute force."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet  # noqa: F401
import pytest
from odd import TEXTS, empty, odd, rows

from pyspark.sql import functions as F

from labelprism.llm import bpe, queries, token_counts, token_files
from labelprism.llm.common import public_path, shared_folder
from tests.conftest import SF_ORACLE, SF_SMALL

PATH = public_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_numbers_round_trip():
    n = np.array([0, 1, 127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21, 5], np.int64)
    parts = bpe.to_bytes(n, np.array([3, 0, 6]))
    assert [bpe.from_bytes(p).tolist() for p in parts] == [n[:3].tolist(), [], n[3:].tolist()]


def test_words_straight_to_the_model(library):
    """All words of the tables and odd ones: the short way gives what the whole way gives."""
    docs = pa.parquet.read_table(f"{SF_ORACLE}/documents.parquet", columns=["text"])["text"].to_pylist()
    words = {w for t in [*docs, *(t for _, t in TEXTS)] for w in (t or "").lower().split()}
    words |= {"\u00aa\u00ba", "\u00b5m", "e\u0301t\u00e9", "i\u0307", "\u0149a", "stra\u00dfe,", "it's.", "a.b", "a..", ".", "", "\u0250x", "\u00f1!", "x1.", "<|endoftext|>."}
    words = sorted(words)
    assert bpe.word_ids(library, words) == [library.encode(w, add_special_tokens=False).ids for w in words]


@pytest.mark.parametrize("hot", [1, 7, bpe.HOT_WORDS])
def test_bpe_encodes_odd_documents_as_the_library(spark, library, hot):
    got = rows(bpe.bpe_encode(odd(spark), PATH, hot_words=hot), "doc_id", "ids")
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in TEXTS), key=repr)
    assert got == want


def test_bpe_decodes_as_the_library(spark, library):
    df = spark.createDataFrame([(1, [320, 2, 49407, 99999]), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = dict(rows(bpe.bpe_decode(df, PATH), "doc_id", "decoded"))
    assert got == {1: library.decode([320, 2, 49407, 99999], skip_special_tokens=False), 2: "", 3: None}


def test_bpe_empty_table(spark):
    assert bpe.bpe_decode(bpe.bpe_encode(empty(spark), PATH), PATH).collect() == []


def test_op5_on_whole_table(spark, library):
    import hashlib

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = []
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want.append((d.doc_id, len(ids), *sha))
    assert rows(queries.op5_bpe_round_trip(spark, SF_SMALL), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def stream(library, texts):
    """doc_id, start, ids in the order of the files."""
    out, start = [], 0
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode())):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("size", [16, 1 << 22])
def test_token_files_odd_documents(spark, library, size):
    folder = shared_folder(spark, "test-tokens")
    files = token_files.write_token_files(odd(spark).repartition(3), folder, PATH, length=16, file_tokens=size)
    got = rows(token_files.read_token_files(folder, files), "doc_id", "start", "ids")
    assert got == sorted(stream(library, TEXTS), key=repr)
    assert files.count() > (5 if size == 16 else 0)


def test_token_file_gives_sequences_without_copying(spark, tmp_path):
    stream = np.concatenate((np.arange(5), np.arange(6))).astype(np.uint16)
    batch = token_files.sequences(pa.array([1, 2]), np.array([5, 6]), stream, 4, 2)
    with pa.ipc.new_file(str(tmp_path / "x.arrow"), batch.schema) as out:
        out.write_batch(batch)
    with pa.memory_map(str(tmp_path / "x.arrow")) as source:
        before = pa.total_allocated_bytes()
        ids = pa.ipc.open_file(source).get_batch(0).column("ids")
        assert ids[2].as_py() == [3, 4, 5, 0] and ids.flatten().to_numpy(zero_copy_only=True)[4:8].tolist() == [4, 0, 1, 2]
        assert pa.total_allocated_bytes() - before < 64 * 16
    assert batch.column("mask")[2].as_py() == [True, True, True, False]
    assert batch.column("docs").to_pylist()[1] == [{"doc_id": 2, "at": 1, "n": 6}]


def test_sequences_of_written_files_one_by_one(spark, library, monkeypatch):
    folder = shared_folder(spark, "test-tokens")
    docs = spark.createDataFrame([(k, "one two three four five six seven") for k in range(3000)], "doc_id long, text string")
    files = token_files.write_token_files(docs.coalesce(1), folder, PATH, length=16).collect()
    whole = np.concatenate([np.append(library.encode("one two three four five six seven", add_special_tokens=False).ids, 2)] * 3000)
    rows_ = -(-len(whole) // 16)
    assert sum(f.n_tokens for f in files) == len(whole) and rows_ > 3 * token_files.BATCH_ROWS
    first = files[0]
    for k in (0, 255, 256, 700):
        ids, mask = token_files.read_sequence(folder, first.path, k)
        assert ids.to_numpy(zero_copy_only=True).tolist() == whole[first.start + 16 * k: first.start + 16 * k + 16].tolist() and all(mask.to_pylist())


def test_rows_without_id_are_dealt_over_tasks(spark, library):
    """A third of the rows have no id: their ids still make one stream, written by several tasks."""
    texts = [(None if k % 3 == 0 else k, f"text number {k} " * (1 + k % 5)) for k in range(900)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    folder = shared_folder(spark, "test-tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins parts as small as these
    try:
        files = token_files.write_token_files(docs, folder, PATH, length=16, file_tokens=64)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = rows(token_files.read_token_files(folder, files), "doc_id", "start", "ids")
    none = sorted((r[1], r[2]) for r in got if r[0] is None)
    assert len(none) == 300 and [s for s, _ in none] == [0, *np.cumsum([len(i) for _, i in none])[:-1].tolist()]
    assert sorted(i for _, i in none) == sorted([*library.encode(t, add_special_tokens=False).ids, 2] for i, t in texts if i is None)
    starts = sorted(r[1] for r in got)
    parts = {r.part for r in files.where(F.col("start") < none[-1][0]).collect()}
    assert len(parts) > 1 and starts == sorted(set(starts))


def test_common_long_words_are_hot_and_bytes_are_bounded(spark, library, monkeypatch):
    """A word of 80 letters in a third of the documents is encoded once; with few bytes for hot words the result is the same."""
    rule = "=" * 80
    texts = [(k, f"{rule if k % 3 == 0 else ''} {'x' * 5000 if k % 4 == 0 else ''} word{k % 11}") for k in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    counted = bpe._frequent(iter([pa.record_batch([pa.array([t for _, t in texts])], ["body"])]))
    assert rule in [w for b in counted for w in b.column("word").to_pylist()]
    want = sorted((i, library.encode(t, add_special_tokens=False).ids) for i, t in texts)
    assert sorted((r.doc_id, list(r.ids)) for r in bpe.bpe_encode(docs, PATH).collect()) == want
    monkeypatch.setattr(bpe, "HOT_BYTES", 60)
    assert sorted((r.doc_id, list(r.ids)) for r in bpe.bpe_encode(docs, PATH).collect()) == want


def test_rare_words_travel_with_a_short_key(spark):
    """Id and text are told apart by 16 bytes in all, two numbers in every row that is exchanged."""
    texts = [(1, "a b"), (1, "a c"), (2, "a b"), (None, "a b"), (None, None), (3, ""), (3, None), (1, "a b"), (-(1 << 63), "a b"), (12, "3:x"), (123, ":x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    keys = [bytes(r.key) for r in bpe.short_keyed(docs).collect()]
    same = {(i, t or "") for i, t in texts}
    assert {len(k) for k in keys} == {16} and len(set(keys)) == len(same) == len(texts) - 2
    plan = bpe.bpe_encode(docs, PATH, hot_words=1)._jdf.queryExecution().optimizedPlan().toString()
    sent = re.findall(r"(?:coded|gaps|encode_once)\(.*?\).*?, \[([^\]]*)\]", plan)
    assert len(sent) >= 3 and all("key1#" in s and "key2#" in s and "tag#" not in s for s in sent)


def test_token_files_empty_table(spark):
    folder = shared_folder(spark, "test-tokens")
    files = token_files.write_token_files(empty(spark), folder, PATH)
    assert token_files.read_token_files(folder, files).collect() == []


def test_op10_on_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = [(i, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, ids in stream(library, [(d.doc_id, d.text) for d in docs])]
    assert rows(queries.op10_token_files(spark, SF_SMALL), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


def longest_match(word, vocabulary, byte_pieces):
    n, longest = 0, max(map(len, vocabulary))
    while word:
        k = next((k for k in range(min(longest, len(word)), 0, -1) if word[:k] in vocabulary), 0)
        n += 1 if k or not byte_pieces else len(word[0].encode())
        word = word[max(k, 1):]
    return n


def test_automaton_against_longest_match():
    rng = np.random.default_rng(3)
    for _ in range(300):
        vocabulary = {"".join(rng.choice(list("abc"), rng.integers(1, 6))) for _ in range(rng.integers(1, 14))}
        flag = bool(rng.integers(2))
        match = token_counts.LongestMatch(sorted(vocabulary), flag)
        for _ in range(20):
            word = "".join(rng.choice(list("abcdé"), rng.integers(0, 14)))
            assert match.count(word) == longest_match(word, vocabulary, flag)


def test_token_counts_odd_and_empty(spark):
    vocabulary = token_counts.sentencepiece_vocabulary(public_path("piece_bpe_32k.model"))
    known = set(vocabulary)
    split = [(i, (t or "").encode().split()) for i, t in TEXTS]
    memo = {w: longest_match("▁" + w.decode(), known, True) for _, ws in split for w in ws}
    want = sorted(((i, len(ws), sum(memo[w] for w in ws)) for i, ws in split), key=repr)
    assert rows(token_counts.token_counts(odd(spark), vocabulary), "doc_id", "n_words", "n_pieces") == want
    assert token_counts.token_counts(empty(spark), vocabulary).collect() == []


def test_op8_on_whole_table(spark):
    known = set(token_counts.sentencepiece_vocabulary(public_path("piece_bpe_32k.model")))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    split = [(d.doc_id, (d.text or "").encode().split()) for d in docs]
    memo = {w: longest_match("▁" + w.decode(), known, True) for w in {w for _, ws in split for w in ws}}
    want = sorted(((i, len(ws), sum(memo[w] for w in ws)) for i, ws in split), key=repr)
    assert rows(queries.op8_token_counts(spark, SF_SMALL), "doc_id", "n_words", "n_pieces") == want
