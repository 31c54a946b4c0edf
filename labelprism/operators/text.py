"""Text features: tokenisers, normalisation, dictionary, bags of words,
document-frequency vocabulary, term presence and length statistics.

Token tables are long ``(key, term[, tf])`` frames: the sparse document-term
matrix of a single-machine library becomes one row per non-zero cell, hash
partitioned by whatever the next aggregate groups on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from labelprism.functions.columns import word_tokens, ws_tokens
from labelprism.operators.ordinal import sorted_ordinal

__all__ = ["add_word_tokens", "add_ws_tokens", "explode_tokens", "normalise_text",
           "dictionary", "bag_of_words", "vocabulary", "count_vectorise",
           "term_presence", "length_stats", "vocabulary_from_bow", "ALNUM_RUN", "ALPHA_ONLY"]

# A candidate token for normalisation is a maximal run of letters and digits;
# it is kept only when it is letters only (so "abc123" is dropped whole, as a
# non-alphabetic token, and "self-driving" yields two words).
ALNUM_RUN = r"[\p{L}\p{N}]+"
ALPHA_ONLY = r"^\p{L}+$"


def add_word_tokens(df: DataFrame, text: str, out: str = "tokens") -> DataFrame:
    """Lower-cased word tokens (≥ 2 word characters) as an array column."""
    return df.withColumn(out, word_tokens(text))


def add_ws_tokens(df: DataFrame, text: str, out: str = "tokens") -> DataFrame:
    """Whitespace tokens, case kept."""
    return df.withColumn(out, ws_tokens(text))


def explode_tokens(df: DataFrame, key: str, tokens: str, term: str = "term",
                   pos: str | None = "pos") -> DataFrame:
    """One row per token: ``(key, pos, term)`` (``pos`` 0-based).

    ``explode_outer`` + a null filter instead of ``explode``: with ``explode``
    the optimizer infers a ``size(tokens) > 0`` filter below the projection
    and evaluates the tokenising regex twice."""
    if pos:
        return (df.select(key, F.posexplode_outer(tokens).alias(pos, term))
                  .where(F.col(term).isNotNull()))
    return df.select(key, F.explode_outer(tokens).alias(term)).where(F.col(term).isNotNull())


BROADCAST_ROWS = 2_000_000   # word-table rows we agree to broadcast


def _bounded_broadcast(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after a bounded count proves the table small."""
    return F.broadcast(table) if table.limit(max_rows + 1).count() <= max_rows else table


def _replaced(stop: set[str], lemma: dict[str, str]):
    """Rows with the token runs of each text of a group, to rows with the words kept, in text order."""
    def one(word: str) -> str | None:
        if not word.isalpha():
            return None
        low = word.lower()
        return None if low in stop else lemma.get(low, word)

    def run(batches):
        for b in batches:
            runs = b.column(b.num_columns - 1)
            texts = pc.list_flatten(runs)
            coded = pc.list_flatten(texts).dictionary_encode()
            words = pa.array([one(w) for w in coded.dictionary.to_pylist()], pa.string())
            got = words.take(coded.indices)
            # words kept before each group: from its texts to their runs to those kept
            kept = np.concatenate(([0], np.cumsum(np.asarray(got.is_valid()))))
            per_text = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(texts)))))
            per_row = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(runs)))))
            out = pa.ListArray.from_arrays(pa.array(kept[per_text[per_row]], pa.int32()), got.drop_null())
            several = np.flatnonzero(np.diff(per_row) > 1)
            if len(several):    # rows with the same key: their words by place, then word
                rows = out.to_pylist()
                for i in several:
                    ends = per_text[per_row[i]:per_row[i + 1] + 1]
                    found = [(k, w.encode()) for s, e in zip(ends[:-1], ends[1:]) for k, w in enumerate(got[s:e].to_pylist()) if w is not None]
                    rows[i] = [w.decode() for _, w in sorted(found)]
                out = pa.array(rows, pa.list_(pa.string()))
            yield pa.record_batch([*b.columns[:-1], out], b.schema.names)
    return run


def normalise_text(df: DataFrame, key: str, text: str, stopwords: DataFrame,
                   lemmas: DataFrame, out: str = "norm_text", keep: list[str] | None = None) -> DataFrame:
    """Keep alphabetic tokens that are not stop/number words, map each to
    its lemma (lookup on the lower-cased form; unknown forms keep their case),
    join them with one space in text order.  ``(key, *keep, out)``; rows whose
    normalised text would be empty produce no output row (the caller's blank
    filter would drop them anyway).

    Plan: texts are grouped by ``key`` (plus the carried ``keep`` columns) —
    whole texts, no shuffle when the input is hash-partitioned by ``key`` — and
    the words of a record batch are looked up once per distinct word, so no row
    per token is made, sorted or shuffled.  Each word table is read with a
    bound first: one beyond ``BROADCAST_ROWS`` rows is joined to the exploded
    tokens instead, so a full lemma dictionary works too.
    """
    keep = keep or []
    stop_table = stopwords.select(F.col("form").alias("_lw")).distinct()
    lemma_table = lemmas.select(F.col("form").alias("_lw"), F.col("lemma").alias("_lemma")).dropDuplicates(["_lw"])
    small = [t.limit(BROADCAST_ROWS + 1).collect() for t in (stop_table, lemma_table)]
    if any(len(rows) > BROADCAST_ROWS for rows in small):
        return _normalise_by_joins(df, key, text, stop_table, lemma_table, out, keep)
    stop = {r[0] for r in small[0]}
    lemma = {r[0]: r[1] for r in small[1] if r[1] is not None}
    grouped = df.where(F.col(text).isNotNull()).groupBy(key, *keep).agg(F.collect_list(text).alias("_t"))
    runs = grouped.select(key, *keep, F.transform("_t", lambda t: F.regexp_extract_all(t, F.lit(ALNUM_RUN), 0)).alias("_w"))
    schema = StructType([*df.select(key, *keep).schema.fields, StructField("_w", ArrayType(StringType()))])
    words = runs.mapInArrow(_replaced(stop, lemma), schema)
    return words.where(F.size("_w") > 0).select(key, *keep, F.array_join("_w", " ").alias(out))


def _normalise_by_joins(df: DataFrame, key: str, text: str, stop_table: DataFrame, lemma_table: DataFrame, out: str, keep: list[str]) -> DataFrame:
    """T01 with word tables of any size: a row per token, joined with both tables."""
    toks = (df.select(key, *keep, F.posexplode_outer(F.regexp_extract_all(F.col(text), F.lit(ALNUM_RUN), 0))
                      .alias("_pos", "_w"))
              .where(F.col("_w").rlike(ALPHA_ONLY))
              .withColumn("_lw", F.lower("_w")))
    kept_rows = (toks.join(_bounded_broadcast(stop_table), "_lw", "left_anti")
                     .join(_bounded_broadcast(lemma_table), "_lw", "left")
                     .withColumn("_lemma", F.coalesce("_lemma", "_w")))
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_lemma")))
    return kept_rows.groupBy(key, *keep).agg(
        F.array_join(F.transform(ordered, lambda s: s["_lemma"]), " ").alias(out))


def bag_of_words(df: DataFrame, key: str, tokens: str, term: str = "term",
                 keep: list[str] | None = None) -> DataFrame:
    """``(key, *keep, term, tf)``; ``keep`` are columns that go with the key.
    Partial aggregation combines repeats map-side."""
    keep = keep or []
    return (df.select(key, *keep, F.explode_outer(tokens).alias(term)).where(F.col(term).isNotNull())
              .groupBy(key, *keep, term).agg(F.count(F.lit(1)).alias("tf")))


def term_presence(df: DataFrame, key: str, tokens: str, term: str = "term",
                  keep: list[str] | None = None) -> DataFrame:
    """One row per (document, distinct term).  ``array_distinct`` works
    inside the row, so no shuffle is needed when ``key`` identifies a row."""
    keep = keep or []
    return (df.select(key, *keep, F.explode_outer(F.array_distinct(tokens)).alias(term))
              .where(F.col(term).isNotNull()))


def vocabulary(df: DataFrame, key: str, tokens: str, min_df: float = 7, max_df: float = 0.8,
               term: str = "term") -> DataFrame:
    """Terms with ``min_df ≤ document frequency ≤ max_df``.

    An int limit is a document count, a float in (0, 1] a fraction of the
    documents (both ends inclusive).  Document frequency counts rows holding
    the term at least once.  The document total is a scalar subquery.
    """
    pres = term_presence(df, key, tokens, term)
    dfreq = pres.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    n_docs = df.agg(F.count(F.lit(1)).cast("double")).scalar()

    def bound(v):
        return F.lit(float(v)) * n_docs if isinstance(v, float) else F.lit(float(v))

    return dfreq.where((F.col("df") >= bound(min_df)) & (F.col("df") <= bound(max_df)))


def vocabulary_from_bow(bow: DataFrame, n_docs, min_df: float = 7, max_df: float = 0.8,
                        term: str = "term") -> DataFrame:
    """T06 from an existing bag of words (one row per document and term), so
    the text is tokenised once for both; ``n_docs`` is the document total
    (a number or a scalar column — documents without tokens count too)."""
    n = n_docs if not isinstance(n_docs, (int, float)) else F.lit(float(n_docs))

    def bound(v):
        return F.lit(float(v)) * n if isinstance(v, float) else F.lit(float(v))

    dfreq = bow.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    return dfreq.where((F.col("df") >= bound(min_df)) & (F.col("df") <= bound(max_df)))


def count_vectorise(bow: DataFrame, vocab: DataFrame, term: str = "term") -> DataFrame:
    """The bag of words restricted to the vocabulary (left-semi join)."""
    return bow.join(vocab.select(term), term, "left_semi")


def dictionary(terms: DataFrame, term: str = "term", out: str = "term_id") -> DataFrame:
    """Distinct term → dense id in code-point order, numbered without a
    single-task window (see :func:`labelprism.operators.ordinal.sorted_ordinal`)."""
    return sorted_ordinal(terms.select(term).where(F.col(term).isNotNull()).distinct(), [term], out)


def length_stats(df: DataFrame, tokens: str, group: list[str] | None = None) -> DataFrame:
    """Documents, total and mean words (optionally per group)."""
    n = F.size(tokens)
    aggs = [F.count(F.lit(1)).alias("n_docs"), F.sum(n).cast("long").alias("total_words"),
            F.avg(n.cast("double")).alias("mean_words")]
    return df.groupBy(*(group or [])).agg(*aggs)
