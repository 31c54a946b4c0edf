"""The pipeline, stage by stage against brute force and as a whole."""

import hashlib

import corpus_pipeline
from odd import PASSAGE, empty, odd, rows
from test_decontaminate import brute as brute_decontaminate
from test_simhash import brute as brute_components
from test_substring import brute as brute_substring

from labelprism.llm import quality
from labelprism.llm.common import public_path
from tests.conftest import SF_SMALL


def table(spark, path):
    df = spark.read.parquet(path)
    return df, [(r.doc_id, r.text) for r in df.collect()]


def test_stages_on_the_whole_table(spark, tmp_path):
    from tokenizers import Tokenizer

    _, items = [spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")] * 2
    docs, texts = table(spark, f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF_SMALL).write.parquet(f"{tmp_path}/{k}")
        after, left = table(spark, f"{tmp_path}/{k}")
        assert after.columns == columns and len(left) > 50
        results.append((docs, texts, after, left))
        docs, texts = after, left

    before, _, _, left = results[0]
    assert sorted(i for i, _ in left) == sorted(r.doc_id for r in quality.quality_rules(before).where("kept").collect())
    _, was, _, left = results[1]
    assert sorted(i for i, _ in left) == sorted({c for _, _, c in brute_components(was)}) and set(left) <= set(was)
    _, was, after, left = results[2]
    assert sorted(left) == sorted((i, t) for i, _, t in brute_substring(was, 20))
    assert all(r.n_chars == len(r.text) for r in after.collect())
    _, was, _, left = results[3]
    hit = {i for i, *_, bad in brute_decontaminate(was, [(r.item_id, r.text) for r in items.collect()], 10) if bad}
    assert hit and sorted(left) == sorted(x for x in was if x[0] not in hit)

    library = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    want = []
    for i, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)), ids))
    got = rows(corpus_pipeline.run(spark, SF_SMALL), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")
    assert got == sorted(want, key=repr)


def test_odd_and_empty_documents(spark, tmp_path):
    words = " ".join(f"word{k}" for k in range(80))
    more = [(50, f"{words} one {PASSAGE}", None, None, None), (51, f"{PASSAGE} {words} two", None, None, None), (51, f"{PASSAGE} {words} two", None, None, None)]
    extra = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (odd(spark).unionByName(extra, allowMissingColumns=True), empty(spark)):
        docs = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            after = stage(spark, docs, SF_SMALL)
            if k + 1 < len(corpus_pipeline.STAGES):
                assert after.dtypes == docs.dtypes
            path = f"{tmp_path}/{start is docs}-{id(start)}-{k}"
            after.write.parquet(path)
            docs = spark.read.parquet(path)
        left = [r.doc_id for r in docs.collect()]
        assert len(left) == len(set(left)) and (not left or 50 in left)


def test_columns_that_cannot_be_sorted_by(spark):
    """Maps and arrays of them beside the text: one row of each document stays."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "one two three four", {"a": 1}), (1, "one two three four", {"b": 2}), (2, "other words are here", None)], "doc_id long, text string, extra map<string,int>")
    docs = docs.withColumn("more", F.array("extra"))
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 2]
