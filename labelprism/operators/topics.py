"""Topic models and the statistics of a topic report.

Fitting uses ``pyspark.ml.clustering.LDA`` on count vectors built from an
explicit vocabulary.  Everything after the fit works on three long tables:

* ``topic_terms``  ``(topic, term, weight)`` — unnormalised topic-term
  pseudo-counts (what a variational LDA calls lambda);
* ``doc_topics``   ``(doc, topic, theta)`` — document-topic shares;
* ``doc_len``      ``(doc, n)`` — tokens per document inside the vocabulary.

so any topic model (or a fixed one, as the oracle tests use) can feed them.
Topic-level tables have one row per topic (small); term-level ones one row
per (topic, term) and are aggregated with joins and group-bys, never on the
driver.  Only the k × k distance table is collected (A21).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA, LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelprism.functions.columns import argmax, number_in_name
from labelprism.operators.assoc import complete_counts
from labelprism.operators.domain import small_domain
from labelprism.operators.ordinal import sorted_ordinal
from labelprism.session import ensure_checkpoint_dir

__all__ = ["count_vectors", "fit_topics", "assign_topics", "model_topic_terms", "top_terms",
           "topic_report", "topic_share", "topic_term_counts", "token_shares", "topic_term_scores",
           "relevant_terms", "salient_terms", "topic_distance", "topic_coordinates",
           "topic_overlap", "align_topics", "pivot_named", "display_topics", "doc_topics_long",
           "numbered_order"]

MAX_VOCAB = 1 << 22   # spark.ml LDA keeps a k × V matrix on the driver anyway


# ------------------------------------------------------------------ fit / assign
def count_vectors(docs: DataFrame, tokens: str, vocab: DataFrame, term: str = "term",
                  out: str = "features") -> tuple[DataFrame, list[str]]:
    """T07 at the model boundary: token arrays → sparse count vectors over the
    given (already df-filtered) vocabulary, in code-point order.

    The vocabulary list goes to the driver because the LDA model will hold a
    k × V matrix there anyway; its size is checked first."""
    rows = vocab.select(term).limit(MAX_VOCAB + 1).collect()    # one bounded pass
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"vocabulary larger than {MAX_VOCAB} terms; raise min_df")
    # code-point order (Python's str order equals Spark's UTF-8 binary order)
    words = sorted(r[0] for r in rows)
    cv = CountVectorizerModel.from_vocabulary(words, inputCol=tokens, outputCol=out)
    return cv.transform(docs), words


def fit_topics(vectors: DataFrame, k: int = 10, seed: int = 42, max_iter: int = 10,
               features: str = "features") -> LocalLDAModel:
    """Variational LDA over full batches (``subsamplingRate=1``), symmetric
    priors 1/k for documents and topics, ``max_iter`` passes."""
    lda = LDA(k=k, seed=seed, maxIter=max_iter, optimizer="online", subsamplingRate=1.0,
              learningOffset=10.0, learningDecay=0.7, optimizeDocConcentration=False,
              docConcentration=[1.0 / k], topicConcentration=1.0 / k, featuresCol=features)
    return lda.fit(vectors)


def assign_topics(model, vectors: DataFrame, out: str = "dominant_topic") -> DataFrame:
    """M02 + W03: topic distribution per document and its arg-max."""
    t = model.transform(vectors).withColumn("theta", vector_to_array("topicDistribution"))
    return t.withColumn(out, argmax("theta"))


def model_topic_terms(model, vocab: list[str], spark) -> DataFrame:
    """Long ``(topic, term, weight)`` from a fitted local model (k × V on the driver)."""
    lam = model.topicsMatrix().toArray()            # V × k
    v, k = lam.shape
    pdf = pd.DataFrame({"topic": np.repeat(np.arange(k, dtype=np.int32), v),
                        "term": np.tile(np.asarray(vocab, dtype=object), k),
                        "weight": lam.T.reshape(-1)})
    return spark.createDataFrame(pdf)


def doc_topics_long(assigned: DataFrame, key: str, theta: str = "theta") -> DataFrame:
    """``(key, topic, theta)`` from an array column of topic shares."""
    return assigned.select(key, F.posexplode(theta).alias("topic", "theta"))


# ------------------------------------------------------------------ ranking
def top_terms(topic_terms: DataFrame, n: int = 30, topic: str = "topic", term: str = "term",
              weight: str = "weight") -> DataFrame:
    """The ``n`` heaviest terms per topic, ties by term (partial window limit)."""
    w = Window.partitionBy(topic).orderBy(F.col(weight).desc(), F.col(term).asc())
    return topic_terms.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def topic_report(top: DataFrame, names: DataFrame | None = None, topic: str = "topic") -> DataFrame:
    """Report lines ``'  <rank>. <word> (<weight, 3 places>)'`` per topic,
    with the topic's display name (default ``'Topic <id+1>'`` for int ids)."""
    lines = top.withColumn("line", F.format_string("  %d. %s (%.3f)", F.col("rank"), F.col("term"),
                                                   F.col("weight").cast("double")))
    if names is not None:
        lines = lines.join(F.broadcast(names), topic, "left")
    else:
        lines = lines.withColumn("name", F.lit(None).cast("string"))
    default = F.format_string("Topic %s", F.col(topic).cast("string"))
    if dict(top.dtypes)[topic] in ("int", "bigint"):
        default = F.format_string("Topic %d", F.col(topic) + 1)
    return lines.withColumn("name", F.coalesce("name", default))


# ------------------------------------------------------------------ report statistics
def topic_share(doc_topics: DataFrame, doc_len: DataFrame, key: str, topic: str = "topic") -> DataFrame:
    """``(topic, topic_freq, proportion, share_pct, topic_order)``:
    expected tokens per topic Σ θ·n, its share, and the display order (largest
    first, ties by id).  One join on the document key, then a topic-sized table."""
    tf = (doc_topics.join(doc_len, key)
                    .groupBy(topic).agg(F.sum(F.col("theta") * F.col("n")).alias("topic_freq")))
    total = tf.agg(F.sum("topic_freq")).scalar()
    whole = Window.partitionBy()  # one row per topic
    return (tf.withColumn("proportion", F.col("topic_freq") / total)
              .withColumn("share_pct", F.col("proportion") * F.lit(100.0))
              .withColumn("topic_order",
                          F.row_number().over(whole.orderBy(F.col("topic_freq").desc(), F.col(topic)))))


def topic_term_counts(topic_terms: DataFrame, shares: DataFrame, topic: str = "topic",
                      term: str = "term") -> DataFrame:
    """``(topic, term, phi, freq, total, n_all)``: phi = weight / topic
    weight, freq = phi · topic_freq (expected count of the term in the topic),
    total = Σ over topics of freq, n_all = Σ of all expected counts (the
    corpus size, carried as a column so later steps need no extra pass).
    Topic sums are a topic-sized broadcast; the term total is a window over
    the term's topics (at most k rows per group)."""
    wsum = topic_terms.groupBy(topic).agg(F.sum("weight").alias("_wsum"))
    tf = shares.select(topic, "topic_freq", F.sum("topic_freq").over(Window.partitionBy()).alias("n_all"))
    ph = (topic_terms.join(F.broadcast(wsum.join(tf, topic)), topic)
                     .withColumn("phi", F.col("weight") / F.col("_wsum"))
                     .withColumn("freq", F.col("phi") * F.col("topic_freq")))
    total = F.sum("freq").over(Window.partitionBy(term))
    return ph.withColumn("total", total).select(topic, term, "phi", "freq", "total", "n_all")


def token_shares(counts: DataFrame, topic: str = "topic", term: str = "term") -> DataFrame:
    """Share of a term's expected occurrences in each topic, from the
    rounded (half to even) expected count; cells under ½ are dropped."""
    return (counts.where(F.col("freq") >= 0.5)
                  .select(topic, term, (F.bround("freq", 0) / F.col("total")).alias("share")))


def topic_term_scores(counts: DataFrame, topic: str = "topic", term: str = "term") -> DataFrame:
    """logprob = ln φ, loglift = ln(φ / p(term)) with p(term) = total / N."""
    return counts.select(topic, term, F.ln("phi").alias("logprob"),
                         F.ln(F.col("phi") / (F.col("total") / F.col("n_all"))).alias("loglift"))


def relevant_terms(scores: DataFrame, r: int = 30, step: float = 0.01, topic: str = "topic",
                   term: str = "term") -> DataFrame:
    """Every (topic, term) in the top ``r`` by relevance
    λ·logprob + (1−λ)·loglift for some λ on the grid 0, step, …, 1.

    Exact pruning first: the r best terms by logprob and the r best by
    loglift (two per-topic top-k) form a seed set S; for each λ the r-th best
    relevance inside S, t(λ), is a lower bound of the true r-th best, so a
    term can only qualify if its relevance reaches t(λ) for some λ.  That test
    is one higher-order ``exists`` per term (narrow); only the few survivors
    are expanded over the grid and ranked."""
    n = int(round(1 / step))
    lam_vals = [i / n for i in range(n + 1)]
    lams = F.array(*[F.lit(v) for v in lam_vals])

    def rel(lam):
        return lam * F.col("logprob") + (F.lit(1.0) - lam) * F.col("loglift")

    def top_by(col):
        w = Window.partitionBy(topic).orderBy(F.col(col).desc(), F.col(term).asc())
        return scores.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= r).drop("_k")

    seed = top_by("logprob").unionByName(top_by("loglift")).dropDuplicates([topic, term])
    ex = seed.select(topic, F.posexplode(lams).alias("_li", "lam"), rel(F.col("lam")).alias("_rel"))
    wr = Window.partitionBy(topic, "_li").orderBy(F.col("_rel").desc())
    thr = (ex.withColumn("_k", F.row_number().over(wr)).where(F.col("_k") == r)
             .groupBy(topic).agg(F.array_sort(F.collect_list(F.struct("_li", "_rel"))).alias("_t"))
             .select(topic, F.transform("_t", lambda x: x["_rel"] - F.lit(1e-9)).alias("_thr")))
    cand = scores.join(F.broadcast(thr), topic, "left")
    keep = F.col("_thr").isNull() | F.exists(
        F.arrays_zip(lams.alias("l"), F.col("_thr").alias("t")),
        lambda z: rel(z["l"]) >= z["t"])
    cand = cand.where(keep).select(topic, term, "logprob", "loglift")
    full = cand.select(topic, term, F.explode(lams).alias("lam"), rel(F.col("lam")).alias("_rel"))
    w = Window.partitionBy(topic, "lam").orderBy(F.round("_rel", 9).desc(), F.col(term).asc())
    return (full.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= r)
                .select(topic, term).distinct())


def salient_terms(counts: DataFrame, shares: DataFrame, r: int = 30, topic: str = "topic",
                  term: str = "term") -> DataFrame:
    """saliency(w) = p(w) · Σ_t p(t|w) ln(p(t|w) / p(t)); the ``r`` most
    salient terms with their rank (ties by term)."""
    p_t = shares.select(topic, F.col("proportion").alias("_pt"))
    ptw = F.col("freq") / F.col("total")
    part = F.when(ptw > 0, ptw * F.ln(ptw / F.col("_pt"))).otherwise(F.lit(0.0))
    sal = (counts.join(F.broadcast(p_t), topic)
                 .groupBy(term).agg(F.first("total").alias("_tot"), F.first("n_all").alias("_n"),
                                    F.sum(part).alias("_dist"))
                 .withColumn("saliency", F.col("_tot") / F.col("_n") * F.col("_dist")))
    # global top-r: a distributed partial top-k (TakeOrderedAndProject), then
    # ranks over the r survivors only
    top = sal.select(term, "saliency").orderBy(F.round("saliency", 9).desc(), F.col(term).asc()).limit(r)
    w = Window.orderBy(F.round("saliency", 9).desc(), F.col(term).asc())
    return top.withColumn("rank", F.row_number().over(w))


def topic_distance(topic_terms: DataFrame, topic: str = "topic", term: str = "term",
                   topics: list | None = None) -> DataFrame:
    """Jensen–Shannon divergence (natural log) between the term
    distributions of every pair of topics, ``(topic_a, topic_b, jsd)``, a < b.

    No pair of rows is formed: the term table is pivoted to one column per
    topic (a small, bounded domain) and each pair's sum is one aggregate
    column of a single pass over the terms."""
    topics = topics if topics is not None else small_domain(topic_terms, topic)
    wsum = topic_terms.groupBy(topic).agg(F.sum("weight").alias("_ws"))
    phi = topic_terms.join(F.broadcast(wsum), topic).withColumn("_p", F.col("weight") / F.col("_ws"))
    wide = phi.groupBy(term).agg(*[F.sum(F.when(F.col(topic) == F.lit(t), F.col("_p"))).alias(f"_p{i}")
                                   for i, t in enumerate(topics)])

    def kl_part(p, m):
        return F.when(p > 0, p * F.ln(p / m)).otherwise(F.lit(0.0))

    aggs, pairs = [], []
    for i in range(len(topics)):
        for j in range(i + 1, len(topics)):
            p = F.coalesce(F.col(f"_p{i}"), F.lit(0.0))
            q = F.coalesce(F.col(f"_p{j}"), F.lit(0.0))
            m = (p + q) / 2
            aggs.append(F.sum(0.5 * kl_part(p, m) + 0.5 * kl_part(q, m)).alias(f"_j{len(pairs)}"))
            pairs.append((topics[i], topics[j]))
    if not pairs:
        raise ValueError("need at least two topics")
    row = wide.agg(*aggs)
    stacked = F.explode(F.array(*[F.struct(F.lit(a).alias("topic_a"), F.lit(b).alias("topic_b"),
                                           F.col(f"_j{n}").alias("jsd")) for n, (a, b) in enumerate(pairs)]))
    return row.select(stacked.alias("_s")).select("_s.*")


def topic_coordinates(distances: DataFrame, topics: list) -> pd.DataFrame:
    """A21 positions: classical (Torgerson) scaling of the k × k divergence
    table to two coordinates.  k ≤ a few dozen, so the eigen-step runs on the
    driver on the collected k × k table; the sign of each axis is arbitrary."""
    idx = {t: i for i, t in enumerate(topics)}
    k = len(topics)
    d = np.zeros((k, k))
    for r in distances.collect():
        i, j = idx[r["topic_a"]], idx[r["topic_b"]]
        d[i, j] = d[j, i] = r["jsd"]
    centre = np.eye(k) - np.full((k, k), 1.0 / k)
    gram = -0.5 * centre @ (d ** 2) @ centre
    vals, vecs = np.linalg.eigh(gram)
    top = np.argsort(vals)[::-1][:2]
    vals = np.clip(vals[top], 0, None)
    coords = vecs[:, top] * np.sqrt(vals)
    return pd.DataFrame({"topic": topics, "x": coords[:, 0], "y": coords[:, 1]})


def display_topics(scores: DataFrame, shares: DataFrame, n: int = 30, topic: str = "topic",
                   term: str = "term", prefix: str = "Topic") -> DataFrame:
    """Topics as a report shows them — named ``<prefix><size order>`` —
    with their ``n`` best words by logprob: ``(display, term, rank)``."""
    named = scores.join(F.broadcast(shares.select(topic, "topic_order")), topic)
    w = Window.partitionBy("display").orderBy(F.col("logprob").desc(), F.col(term).asc())
    return (named.withColumn("display", F.concat(F.lit(prefix), F.col("topic_order").cast("string")))
                 .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
                 .select("display", term, "rank"))


# ------------------------------------------------------------------ overlap and alignment
def topic_overlap(top_a: DataFrame, top_b: DataFrame, topic_a: str = "topic_a",
                  topic_b: str = "topic_b", term: str = "term",
                  b_values: list | None = None) -> DataFrame:
    """Jaccard of the word sets of every topic of A with every topic
    of B (0 when both are empty): an equi-join on the word counts the
    intersections; the complete pair grid comes from the small topic domains."""
    a = top_a.select(F.col("topic").alias(topic_a), term).distinct()
    b = top_b.select(F.col("topic").alias(topic_b), term).distinct()
    size_a = a.groupBy(topic_a).agg(F.count(F.lit(1)).alias("_na"))
    size_b = b.groupBy(topic_b).agg(F.count(F.lit(1)).alias("_nb"))
    hits = a.join(b, term)
    inter = complete_counts(hits, topic_a, topic_b, b_values, row_domain=size_a.select(topic_a), n="inter", col_domain=size_b)
    out = (inter.join(size_a, topic_a).join(size_b, topic_b)
                .withColumn("union", F.col("_na") + F.col("_nb") - F.col("inter")))
    return out.select(topic_a, topic_b, "inter", F.col("union").alias("n_union"),
                      F.coalesce(F.try_divide(F.col("inter").cast("double"), F.col("union")),
                                 F.lit(0.0)).alias("jaccard"))


def align_topics(overlap: DataFrame, fitted: DataFrame, display: DataFrame, threshold: float = 0.1) -> DataFrame:
    """``(topic, name, position)``, fitted topics by the names of display topics.

    ``overlap`` has ``topic_a`` (display name), ``topic_b`` (fitted id) and
    ``jaccard``; ``fitted`` has ``topic``, ``display`` has ``name``.  Pairs above
    ``threshold`` are settled in rounds: every display topic proposes to the most
    similar fitted topic that has not turned it down (ties: lowest id), and a
    fitted topic keeps the first of its proposers in the display order (by the
    number in the name) and turns the others down for good.  When nobody is turned
    down, display and fitted topics without a partner are paired in order; fitted
    topics beyond that are called ``'Topic <id+1> (Unmapped)'`` and stand last,
    display topics beyond that are left out.  Everything is a table of topics; the
    driver learns only whether a round turned anybody down.
    """
    ensure_checkpoint_dir(overlap.sparkSession)
    names = display.select("name").where("name is not null").distinct().withColumn("_n", number_in_name("name"))
    order = sorted_ordinal(names, ["_n", "name"], "place").select("name", "place")
    topics_ = fitted.select("topic").where("topic is not null").distinct()
    pairs = (overlap.where(F.col("jaccard") > threshold).join(order, F.col("topic_a") == F.col("name"))
             .join(topics_, F.col("topic_b") == F.col("topic"), "left_semi").groupBy("place", F.col("topic_b").alias("topic")).agg(F.max("jaccard").alias("jaccard")).checkpoint(eager=True))
    while True:
        nth = F.row_number().over(Window.partitionBy("place").orderBy(F.col("jaccard").desc(), "topic"))
        proposed = pairs.withColumn("nth", nth).where("nth = 1").select("place", "topic")
        kept = proposed.groupBy("topic").agg(F.min("place").alias("kept"))
        turned_down = proposed.join(kept, "topic").where("place <> kept").select("place", "topic").checkpoint(eager=True)
        if turned_down.isEmpty():
            break
        pairs = pairs.join(turned_down, ["place", "topic"], "left_anti").checkpoint(eager=True)
    partners = proposed.checkpoint(eager=True)
    open_places = sorted_ordinal(order.join(partners, "place", "left_anti").select("place"), ["place"], "k")
    single = sorted_ordinal(topics_.join(partners, "topic", "left_anti"), ["topic"], "k")
    zipped = single.join(open_places, "k", "left").select("topic", "place")
    named = partners.select("topic", "place").unionByName(zipped).join(order, "place", "left")
    unmapped = F.concat(F.lit("Topic "), (F.col("topic") + 1).cast("string"), F.lit(" (Unmapped)"))
    rows = named.select("topic", F.coalesce("name", unmapped).alias("name"), F.col("place").isNull().alias("_last"), F.coalesce("place", F.lit(0)).alias("_place"))
    return sorted_ordinal(rows, ["_last", "_place", "topic"], "position").select("topic", "name", "position")


def pivot_named(long: DataFrame, row: str, col: str, value: str, names: dict | None = None,
                order: list | None = None) -> DataFrame:
    """Wide table, one column per ``col`` value, renamed by ``names``
    and ordered by ``order`` (default: by the number inside the name).  The
    pivot values are given explicitly, so no extra pass discovers them."""
    values = order if order is not None else small_domain(long, col)
    if order is None:
        values = sorted(values, key=lambda v: (_first_number(str(v)), str(v)))
    names = names or {}
    wide = long.groupBy(row).pivot(col, values).agg(F.first(value))
    return wide.select(row, *[F.col(f"`{v}`").alias(str(names.get(v, v))) for v in values])


def _first_number(s: str) -> int:
    """The first run of digits in a name (``Topic10`` → 10; none → 0), the
    same rule as the column expression ``number_in_name``."""
    m = re.search(r"\d+", s)
    return int(m.group()) if m else 0


def numbered_order(df: DataFrame, name: str) -> DataFrame:
    """Sort by the number inside a name (``Topic10`` after ``Topic9``)."""
    return df.orderBy(number_in_name(name), F.col(name))
