"""Texts under one id stay apart, however many there are."""

from odd import rows
from pyspark.sql import functions as F

import corpus_pipeline
from labelprism.llm import bpe, queries, substring
from labelprism.llm.common import keys, public_path


def same_hash(spark):
    """Two texts that Spark's 32-bit hash does not tell apart, as it was used for rows without id."""
    text = F.concat_ws(" ", *(F.concat(F.lit(f"zq{k}x"), F.col("id")) for k in range(25)))
    many = spark.range(300_000).select(text.alias("text"))
    pair = many.groupBy(F.hash("text", F.lit(True)).alias("h")).agg(F.sort_array(F.collect_list("text")).alias("t")).where(F.size("t") > 1)
    return pair.orderBy("h").first().t[:2]


def test_texts_without_id_and_equal_hash_stay_apart(spark):
    texts = same_hash(spark)
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert docs.select(*(c.alias(k) for k, c in keys().items())).distinct().count() == 2
    assert rows(corpus_pipeline.repeated_passages(spark, docs, ""), "text") == [(t,) for t in texts]
    assert rows(substring.substring_dedup(docs), "text") == [(t,) for t in texts]
    path = public_path(queries.WORD_BPE)
    alone = [tuple(bpe.bpe_encode(docs.where(F.col("text") == t), path, hot_words=1).first().ids) for t in texts]
    assert sorted(tuple(r.ids) for r in bpe.bpe_encode(docs, path, hot_words=1).collect()) == sorted(alone)
