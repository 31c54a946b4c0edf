"""The corpus pipeline: five operators of ``labelprism.llm``, one after the other.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``docs``.  Rows with one id and one text are copies of one document;
null ids, texts, languages and sources are values like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from labelprism.llm import bpe, decontaminate, quality, simhash, substring
from labelprism.llm.common import keys, only, public_path, read, shared_folder
from labelprism.llm.queries import WORD_BPE, digests


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and are no outlier of their language and source."""
    return only(docs, quality.quality_rules(docs).where("kept"))


def orderable(kind: DataType) -> bool:
    """Whether Spark sorts by columns of this type; maps and variants are sorted by their JSON instead."""
    if isinstance(kind, ArrayType):
        return orderable(kind.elementType)
    if isinstance(kind, StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (MapType, VariantType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints: the one with the smallest id.

    Of its rows, if it has several, the first by the other columns stays.
    """
    first = simhash.one_of_each(simhash.simhash_components(docs, shingle=3, max_bits=3))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    others = [F.col(f"row.`{f.name}`") if orderable(f.dataType) else F.to_json(F.struct(F.col(f"row.`{f.name}`").alias("x")))
              for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    nth = F.row_number().over(Window.partitionBy("id", "tag").orderBy("tag", *others))
    named = docs.select(row, *(c.alias(k) for k, c in keys().items())).join(first, ["id", "tag"], "left_semi")
    return named.withColumn("nth", nth).where("nth = 1").select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that an earlier window of 20 words has.

    ``text`` is what is left, joined by one space, and ``n_chars`` its length;
    repeated rows get the same text.
    """
    found = substring.substring_dedup(docs, window=20).select("id", "tag", F.col("text").alias("left")).dropDuplicates(["id", "tag"])
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    named = docs.select(others, *(c.alias(k) for k, c in keys().items()))
    new = {"text": F.col("left"), "n_chars": F.length("left").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return named.join(found, ["id", "tag"]).select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no 10-word window of a benchmark item."""
    found = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), window=10)
    return only(docs, found.where("contaminated"), "left_anti")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of every document."""
    path = public_path(WORD_BPE)
    return digests(bpe.bpe_decode(bpe.bpe_encode(docs, path), path), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_free),
    ("BPE encoding and decoding", token_ids),
]

#: No SQL: the robust estimate, the fingerprints and the tokenizer are not to be had in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    folder = shared_folder(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
