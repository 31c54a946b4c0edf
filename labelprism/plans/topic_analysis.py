"""Entry 1 — topic analysis of a labelled sentence table, as one lazy plan.

read → drop null rows → normalise (T01) → drop blank → word tokens (T03) →
vocabulary (T06) → bag of words (T07) → LDA (M01) → dominant topic (M02) →
label × topic log odds (A06); and from the same token table: label × term
presence log odds (A07) → top keywords per label (W02).  The token table is
persisted once and shared by every branch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelprism.functions.columns import argmax
from labelprism.functions.lexicon import lemma_table, stopword_table
from labelprism.operators import assoc, clean, lda, text, topics
from labelprism.session import ensure_checkpoint_dir, settled, written


def prepare_tokens(docs: DataFrame, key: str, text_col: str, label: str,
                   stopwords: DataFrame | None = None, lemmas: DataFrame | None = None) -> DataFrame:
    """``(key, label, norm_text, tokens)`` after the topic pipeline's null,
    normalisation and blank rules."""
    spark = docs.sparkSession
    base = clean.drop_null_rows(docs.select(key, text_col, label), [text_col, label])
    norm = text.normalise_text(base, key, text_col, stopwords or stopword_table(spark),
                               lemmas or lemma_table(spark), keep=[label])
    return text.add_word_tokens(clean.drop_blank(norm, "norm_text"), "norm_text")


def run(docs: DataFrame, key: str = "doc_id", text_col: str = "Sentence", label: str = "Label",
        k: int = 10, min_df: float = 7, max_df: float = 0.8, seed: int = 42, max_iter: int = 10,
        top_words: int = 30, keywords: int = 100, report: bool = True) -> dict:
    """Fit and report; returns a dict of DataFrames (lazy except the model).
    ``report=False`` skips the topic naming and report."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    toks = prepare_tokens(docs, key, text_col, label).persist()
    vocab = text.vocabulary(toks, key, "tokens", min_df, max_df)
    # in columns, a term's number for the term: a fraction of the size that the rows have in a checkpoint
    bow = written(text.bag_of_words(toks, key, "tokens").join(vocab.select("term"), "term", "left_semi").select(key, "term", "tf"))
    model = lda.fit_many(bow, key, [k], seed, max_iter)
    tt = settled(lda.term_weights(model).select("topic", "term", "weight"))
    # a document without a word of the vocabulary has no share of any topic
    theta = settled(lda.document_topics(model).select(F.col("key").alias(key), "theta"))
    assigned = (toks.select(key, label).join(theta, key, "left")
                .withColumn("theta", F.coalesce("theta", F.array_repeat(F.lit(0.0), k))).withColumn("dominant_topic", argmax("theta")))
    doc_len = bow.groupBy(key).agg(F.sum("tf").alias("n"))
    shares = topics.topic_share(topics.doc_topics_long(assigned, key), doc_len, key)
    counts = topics.topic_term_counts(tt, shares)
    scores_tt = topics.topic_term_scores(counts)
    label_topic = assoc.log_odds(assigned, label, "dominant_topic", list(range(k)))
    if not report:
        return {"tokens": toks, "vocabulary": vocab, "model": model, "topic_terms": tt,
                "doc_topics": assigned.select(key, label, "theta", "dominant_topic"),
                "label_topic_log_odds": label_topic}
    # Name fitted topics after the report's size-ordered topics
    fitted_top = topics.top_terms(tt, top_words)
    shown = topics.display_topics(scores_tt, shares, top_words).withColumnRenamed("display", "topic")
    overlap = topics.topic_overlap(shown, fitted_top, b_values=list(range(k)))
    fitted = spark.range(k).select(F.col("id").cast("int").alias("topic"))
    names_df = topics.align_topics(overlap, fitted, fitted.select(F.concat(F.lit("Topic"), (F.col("topic") + 1).cast("string")).alias("name")))
    names = names_df.orderBy("position").collect()   # a row per topic: the columns of the wide table
    return {
        "topic_names": names_df,
        "topic_report": topics.topic_report(fitted_top, names_df.select("topic", "name")),
        "label_topic_wide": topics.pivot_named(label_topic, label, "dominant_topic", "log_odds",
                                               names={r["topic"]: r["name"] for r in names},
                                               order=[r["topic"] for r in names]),
        "tokens": toks,
        "vocabulary": vocab,
        "model": model,
        "doc_topics": assigned.select(key, label, "theta", "dominant_topic"),
        "topic_terms": tt,
        "top_terms": topics.top_terms(tt, top_words),
        "topic_share": shares,
        "topic_term_counts": counts,
        "topic_term_scores": scores_tt,
        "relevant_terms": topics.relevant_terms(scores_tt),
        "salient_terms": topics.salient_terms(counts, shares),
        "label_topic_log_odds": label_topic,
        "term_log_odds": (scores := assoc.term_log_odds(toks, key, label, "tokens")),
        "label_keywords": assoc.label_keywords(scores, label, keywords),
    }
