"""Helpers the operators share: text tables, word split, shared folders, tokenizer loading.

Rows of a document table are told apart by ``(id, tag)``, where ``id`` is
``doc_id`` without nulls and ``tag`` 128 bits of the text's SHA-256, in 22
letters: rows with the same id and the same text are copies of one document and get equal results,
rows with the same id and other texts stay apart.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelprism.session import ensure_checkpoint_dir
from labelprism.sources.tables import table_path

#: ASCII white space (TAB, LF, VT, FF, CR, space): what separates words.
WHITE = r"[\x20\x09-\x0D]+"
#: Bytes of text that a task turns into words at once.
SLICE = 4 << 20
LIBC = ctypes.CDLL(None)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def bodies(docs: DataFrame) -> DataFrame:
    """``doc_id, body`` (UTF-8 bytes, null text as empty); other columns go."""
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"))


def keys() -> dict[str, Column]:
    """``id`` (null ids first) and ``tag`` of a document table's rows."""
    doc_id = F.col("doc_id").cast("long")
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.when(doc_id.isNull(), "0").otherwise("1"), body).cast("binary"), 256)
    # letters, as numpy's fixed-width bytes lose zeros at the end
    return {"id": F.coalesce(doc_id, F.lit(-(1 << 63))), "tag": F.substring(F.base64(F.unhex(F.substring(digest, 1, 32))), 1, 22)}


def keyed_bodies(docs: DataFrame) -> DataFrame:
    """``doc_id, id, tag, body``; other columns go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(k) for k, c in keys().items()),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))


def only(docs: DataFrame, chosen: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose ``(id, tag)`` is in ``chosen`` (or is not, ``left_anti``), with their own columns alone."""
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(k) for k, c in keys().items()))
    return named.join(chosen.select("id", "tag"), ["id", "tag"], how).select("row.*")


def slices(batches: Iterator[pa.RecordBatch], column: str = "body", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of one column, which bounds what a task holds as Python objects."""
    for b in batches:
        length = pc.fill_null(pc.binary_length(b.column(column)), 0)
        part = np.cumsum(np.asarray(length, dtype=np.int64)) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:]):
            if end > start:
                yield b.slice(start, end - start)
    release()


def release() -> None:
    """Give freed memory back to the system: workers stay for the next task, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)


class Words(NamedTuple):
    """The words of some texts: distinct words, each place's code in them, words of each text."""

    distinct: pa.Array
    codes: np.ndarray
    per_text: np.ndarray


def words_of(texts: pa.Array) -> Words:
    """Cut UTF-8 texts (no nulls) at ASCII white space, column by column."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.string()))
    coded = lists.flatten().dictionary_encode()
    codes, per_text = np.asarray(coded.indices), np.diff(np.asarray(lists.offsets)).astype(np.int64)
    empty = pc.index(coded.dictionary, "").as_py()  # what stands beside leading or trailing white space
    if empty >= 0:
        real = codes != empty
        per_text -= np.bincount(np.repeat(np.arange(len(per_text)), per_text)[~real], minlength=len(per_text))
        codes = codes[real]
    return Words(coded.dictionary, codes, per_text)


def add_counts(total: pa.Table | None, words: pa.Array, **counts: np.ndarray) -> pa.Table:
    """A table ``word, ..`` of summed counts with more of them added."""
    new = pa.table({"word": words, **{k: pa.array(n.astype(np.int64)) for k, n in counts.items()}})
    both = pa.concat_tables([total, new]) if total is not None else new
    summed = both.group_by("word", use_threads=False).aggregate([(k, "sum") for k in counts])
    return pa.table({"word": summed["word"], **{k: summed[f"{k}_sum"] for k in counts}})


def place_in(words: pa.Array, table: pa.Array) -> np.ndarray:
    """Where each word stands in ``table``; -1: nowhere."""
    return np.asarray(pc.fill_null(pc.index_in(words, value_set=table), -1))


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def edges(per_text: np.ndarray) -> np.ndarray:
    """Where each text's part of a flat column starts, and the end of the last."""
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(per_text, dtype=np.int64)))


def lower_ascii(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(texts.cast(pa.string()))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_TOKENIZERS: dict[int, object] = {}


def load_tokenizer(text: str):
    """The tokenizer of a JSON text, built once per Python worker, without truncation, padding or threads."""
    key = hash(text)
    if key not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(text)
        tok.no_truncation()
        tok.no_padding()
        _TOKENIZERS[key] = tok
    return _TOKENIZERS[key]


def read_text(path: str) -> str:
    """A vocabulary file, read on the driver and broadcast from there."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def public_path(name: str) -> str:
    """Place of a public tokenizer file, the queries' default for the operators' path parameters."""
    import public_tokenizers

    return public_tokenizers.path(name)
