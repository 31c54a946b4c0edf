"""Registered queries: one per operator of SURVEY §2 that has an observable
result on the driver tables, each paired (where plain SQL can say the same
thing) with an oracle SQL string over the same tables.

Conventions shared by both sides so results compare exactly:
* every computed column is aliased identically;
* doubles are rounded to 6 places, counts are BIGINT, ranks are BIGINT;
* every ranking breaks ties by a key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelprism.functions.columns import WORD_PATTERN, number_in_name, rnd
from labelprism.operators import assoc, text
from labelprism.session import ensure_checkpoint_dir, shuffles_removed
from labelprism.sources import tables
from labelprism.sources.tables import read_table, table_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load(spark: SparkSession, sf: str, name: str, cols: list[str] | None = None) -> DataFrame:
    return read_table(spark, table_path(sf, name), columns=cols)


# DuckDB spelling of the word pattern (RE2 takes the same classes)
_WORD_SQL = WORD_PATTERN.replace("'", "''")

_DOC_TERMS_SQL = f"""
docs AS (SELECT doc_id, lang AS label,
                regexp_extract_all(lower(text), '{_WORD_SQL}', 1) AS toks
         FROM documents WHERE lang IS NOT NULL),
pres AS (SELECT DISTINCT doc_id, label, unnest(toks) AS term FROM docs)"""

_TERM_LOG_ODDS_SQL = f"""
WITH {_DOC_TERMS_SQL},
lab AS (SELECT label, count(*) AS nl FROM docs GROUP BY label),
tot AS (SELECT sum(nl)::BIGINT AS n FROM lab),
tdf AS (SELECT term, count(*) AS df FROM pres GROUP BY term),
cell AS (SELECT label, term, count(*) AS a FROM pres GROUP BY label, term),
grid AS (SELECT l.label, t.term, coalesce(c.a, 0)::BIGINT AS a, t.df, l.nl
         FROM lab l CROSS JOIN tdf t
         LEFT JOIN cell c ON c.label = l.label AND c.term = t.term),
sc AS (SELECT label, term, a, df,
              ln(((a + 0.5::DOUBLE) / ((nl - a) + 0.5::DOUBLE))
                 / (((df - a) + 0.5::DOUBLE) / (((SELECT n FROM tot) - nl - (df - a)) + 0.5::DOUBLE))) AS score
       FROM grid)"""


# ---------------------------------------------------------------- flagship
def _doc_tokens(spark, sf):
    docs = load(spark, sf, "documents", ["doc_id", "text", "lang"]).withColumnRenamed("lang", "label")
    return text.add_word_tokens(tables.spread(docs, "doc_id"), "text").drop("text")


@register("label_keywords", _TERM_LOG_ODDS_SQL + """
SELECT label, term, round(score, 6) AS score, rank FROM (
  SELECT label, term, score,
         row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, term ASC) AS rank
  FROM sc WHERE score > 0) WHERE rank <= 100""")
def q_label_keywords(spark, sf):
    """W02 over A07/T08/T03: top 100 terms per language by presence log odds."""
    scores = assoc.term_log_odds(_doc_tokens(spark, sf), "doc_id", "label", "tokens")
    top = assoc.label_keywords(scores, "label", 100)
    return top.select("label", "term", rnd("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@register("term_log_odds", _TERM_LOG_ODDS_SQL + """
SELECT label, term, a, df, round(score, 6) AS score FROM sc""")
def q_term_log_odds(spark, sf):
    """The complete label × term presence log-odds table."""
    s = assoc.term_log_odds(_doc_tokens(spark, sf), "doc_id", "label", "tokens")
    return s.select("label", "term", "a", "df", rnd("score").alias("score"))


# ------------------------------------------------------------------ sources
from labelprism.functions.columns import WS_CLASS  # noqa: E402
from labelprism.functions.lexicon import LEMMA_PAIRS, NUMBER_WORDS, STOP_WORDS, lemma_table, stopword_table  # noqa: E402
from labelprism.operators import clean, evaluate, vectors  # noqa: E402
from labelprism.sources import tables  # noqa: E402

_WS_SQL = WS_CLASS


@register("read_documents", "SELECT doc_id, lang, source, n_chars FROM documents")
def q_read_documents(spark, sf):
    """Typed scan with a pruned column list."""
    return read_table(spark, table_path(sf, "documents"),
                      schema="doc_id long, text string, lang string, source string, n_chars long",
                      columns=["doc_id", "lang", "source", "n_chars"])


@register("union_splits", """
SELECT doc_id, NULL::BIGINT AS item_id, text AS Sentence, lang AS Label, source FROM documents WHERE lang = 'en'
UNION ALL
SELECT doc_id, NULL::BIGINT, text, lang, source FROM documents WHERE lang IS DISTINCT FROM 'en'
UNION ALL
SELECT NULL::BIGINT, item_id, text, NULL, NULL FROM benchmark""")
def q_union_splits(spark, sf):
    """Union splits with differing columns, then canonical names."""
    docs = load(spark, sf, "documents", ["doc_id", "text", "lang", "source"])
    en = docs.where(F.col("lang") == "en")
    rest = docs.where(~F.col("lang").eqNullSafe("en"))
    bench = load(spark, sf, "benchmark", ["item_id", "text"])
    u = tables.rename(tables.union_splits([en, rest, bench]), {"text": "Sentence", "lang": "Label", "labels": "Label"})
    return u.select("doc_id", "item_id", "Sentence", "Label", "source")


@register("debug_head", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 5")
def q_debug_head(spark, sf):
    """Preview the first 5 rows by key (top-k)."""
    return tables.debug_head(load(spark, sf, "documents", ["doc_id", "lang", "source"]), 5, "doc_id")


@register("profile_embeddings", """
SELECT count(*) AS n_rows, 3::BIGINT AS n_columns, count(DISTINCT label) AS n_classes,
       min(len(embedding))::BIGINT AS min_width, max(len(embedding))::BIGINT AS max_width
FROM embeddings""")
def q_profile_embeddings(spark, sf):
    """Rows, columns, classes, vector width in one aggregate."""
    return tables.profile(load(spark, sf, "embeddings"), label="label", vector="embedding")


# ------------------------------------------------------------------ cleaning
@register("drop_null_rows", """
SELECT d.doc_id, d.lang, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE d.text IS NOT NULL AND l.quality IS NOT NULL""")
def q_drop_null_rows(spark, sf):
    """Rows null in the text or the (joined) label are dropped."""
    docs = load(spark, sf, "documents", ["doc_id", "text", "lang"])
    labs = load(spark, sf, "labels")
    joined = docs.join(labs, "doc_id", "left")
    return clean.drop_null_rows(joined, ["text", "quality"]).select("doc_id", "lang", "quality", "toxic")


@register("cleaning_report_empty", """
SELECT role, count(*) AS rows_in,
       count(*) FILTER (WHERE length(coalesce(text, '')) = 0) AS rows_removed,
       count(*) FILTER (WHERE length(coalesce(text, '')) > 0) AS rows_kept
FROM conversations GROUP BY role""")
def q_cleaning_report_empty(spark, sf):
    """Fill null text, drop empty, audit per role."""
    conv = load(spark, sf, "conversations", ["role", "text"])
    return clean.cleaning_report(conv, "text", "empty", ["role"])


@register("cleaning_report_blank", f"""
SELECT lang, count(*) AS rows_in,
       count(*) FILTER (WHERE NOT coalesce(regexp_matches(text, '[^{_WS_SQL[1:-1]}]'), false)) AS rows_removed,
       count(*) FILTER (WHERE coalesce(regexp_matches(text, '[^{_WS_SQL[1:-1]}]'), false)) AS rows_kept
FROM documents GROUP BY lang""")
def q_cleaning_report_blank(spark, sf):
    """Drop null or whitespace-only text, audit per language."""
    docs = load(spark, sf, "documents", ["lang", "text"])
    return clean.cleaning_report(docs, "text", "blank", ["lang"])


# ------------------------------------------------------------------ text
@register("tokens_ws", f"""
WITH t AS (SELECT conv_id, turn,
                  list_filter(regexp_split_to_array(text, '{_WS_SQL}+'), lambda x: x <> '') AS toks
           FROM conversations)
SELECT conv_id, turn, unnest(generate_series(0, len(toks) - 1)) AS pos, unnest(toks) AS token FROM t""")
def q_tokens_ws(spark, sf):
    """Whitespace tokens with their position, case kept."""
    conv = text.add_ws_tokens(load(spark, sf, "conversations", ["conv_id", "turn", "text"]), "text")
    return conv.select("conv_id", "turn", F.posexplode("tokens").alias("pos", "token")) \
               .withColumn("pos", F.col("pos").cast("long"))


_WORDS_SQL = f"regexp_extract_all(lower(text), '{_WORD_SQL}', 1)"


@register("bag_of_words", f"""
SELECT doc_id, term, count(*) AS tf
FROM (SELECT doc_id, unnest({_WORDS_SQL}) AS term FROM documents) GROUP BY doc_id, term""")
def q_bag_of_words(spark, sf):
    """Word tokens → (doc, term, tf)."""
    return text.bag_of_words(_doc_tokens(spark, sf), "doc_id", "tokens")


@register("dictionary", f"""
SELECT term, (row_number() OVER (ORDER BY term) - 1)::BIGINT AS term_id
FROM (SELECT DISTINCT unnest({_WORDS_SQL}) AS term FROM documents)""")
def q_dictionary(spark, sf):
    """Corpus dictionary, dense ids in code-point order."""
    toks = text.explode_tokens(_doc_tokens(spark, sf), "doc_id", "tokens", pos=None)
    return text.dictionary(toks)


_VOCAB_SQL = f"""
pres AS (SELECT DISTINCT doc_id, unnest({_WORDS_SQL}) AS term FROM documents),
vocab AS (SELECT term, count(*) AS df FROM pres GROUP BY term
          HAVING count(*) >= 7 AND count(*) <= 0.8 * (SELECT count(*) FROM documents))"""


@register("vocabulary", f"WITH {_VOCAB_SQL} SELECT term, df FROM vocab")
def q_vocabulary(spark, sf):
    """Terms in at least 7 documents and at most 80 % of them."""
    return text.vocabulary(_doc_tokens(spark, sf), "doc_id", "tokens", 7, 0.8)


@register("count_vectorise", f"""
WITH {_VOCAB_SQL},
bow AS (SELECT doc_id, term, count(*) AS tf
        FROM (SELECT doc_id, unnest({_WORDS_SQL}) AS term FROM documents) GROUP BY doc_id, term)
SELECT doc_id, term, tf FROM bow WHERE term IN (SELECT term FROM vocab)""")
def q_count_vectorise(spark, sf):
    """Bag of words restricted to the df-limited vocabulary."""
    docs = _doc_tokens(spark, sf)
    return text.count_vectorise(text.bag_of_words(docs, "doc_id", "tokens"),
                                text.vocabulary(docs, "doc_id", "tokens", 7, 0.8))


@register("term_presence", f"SELECT DISTINCT doc_id, unnest({_WORDS_SQL}) AS term FROM documents")
def q_term_presence(spark, sf):
    """(document, term) presence, whole vocabulary."""
    return text.term_presence(_doc_tokens(spark, sf), "doc_id", "tokens")


@register("length_stats", f"""
WITH t AS (SELECT lang, len(list_filter(regexp_split_to_array(text, '{_WS_SQL}+'), lambda x: x <> '')) AS n
           FROM documents)
SELECT lang, count(*) AS n_docs, sum(n)::BIGINT AS total_words, round(avg(n::DOUBLE), 6) AS mean_words
FROM t GROUP BY lang""")
def q_length_stats(spark, sf):
    """Words per document (whitespace tokens): count and mean per language."""
    docs = text.add_ws_tokens(load(spark, sf, "documents", ["lang", "text"]), "text")
    s = text.length_stats(docs, "tokens", ["lang"])
    return s.withColumn("mean_words", rnd("mean_words"))


def _values(rows):
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


_STOP_ALL = sorted(set(STOP_WORDS) | set(NUMBER_WORDS))


@register("normalise_text", f"""
WITH stop(form) AS (VALUES {_values([(w,) for w in _STOP_ALL])}),
lem(form, lemma) AS (VALUES {_values(LEMMA_PAIRS)}),
r AS (SELECT doc_id, regexp_extract_all(text, '{text.ALNUM_RUN}') AS r FROM documents),
toks AS (SELECT doc_id, unnest(generate_series(1, len(r))) AS pos, unnest(r) AS w FROM r),
f AS (SELECT doc_id, pos, w, lower(w) AS lw FROM toks WHERE regexp_full_match(w, '\\p{{L}}+'))
SELECT doc_id, string_agg(coalesce(lem.lemma, f.w), ' ' ORDER BY pos) AS norm_text
FROM f LEFT JOIN lem ON lem.form = f.lw
WHERE f.lw NOT IN (SELECT form FROM stop)
GROUP BY doc_id""")
def q_normalise_text(spark, sf):
    """Alphabetic, non-stop, non-number tokens reduced to lemmas."""
    docs = tables.spread(load(spark, sf, "documents", ["doc_id", "text"]), "doc_id")
    return text.normalise_text(docs, "doc_id", "text", stopword_table(spark), lemma_table(spark))


# ------------------------------------------------------------------ associations
@register("label_distribution", """
SELECT lang AS label, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct
FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def q_label_distribution(spark, sf):
    """Label counts and shares."""
    docs = load(spark, sf, "documents", ["lang"]).withColumnRenamed("lang", "label")
    return assoc.label_distribution(docs, "label").withColumn("pct", rnd("pct"))


@register("crosstab", """
WITH b AS (SELECT * FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
SELECT l.lang, s.source, count(b.doc_id) AS n
FROM (SELECT DISTINCT lang FROM b) l CROSS JOIN (SELECT DISTINCT source FROM b) s
LEFT JOIN b ON b.lang = l.lang AND b.source = s.source
GROUP BY l.lang, s.source""")
def q_crosstab(spark, sf):
    """Complete language × source count grid, zero cells included."""
    return assoc.crosstab(load(spark, sf, "documents", ["lang", "source"]), "lang", "source")


@register("deviation", """
WITH b AS (SELECT * FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
g AS (SELECT s.source, l.lang, count(b.doc_id) AS n
      FROM (SELECT DISTINCT source FROM b) s CROSS JOIN (SELECT DISTINCT lang FROM b) l
      LEFT JOIN b ON b.source = s.source AND b.lang = l.lang GROUP BY s.source, l.lang),
gl AS (SELECT lang, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS global_pct
       FROM documents WHERE lang IS NOT NULL GROUP BY lang),
r AS (SELECT g.*, coalesce(n * 100.0::DOUBLE / nullif(sum(n) OVER (PARTITION BY source), 0), 0.0) AS row_pct FROM g)
SELECT r.source, r.lang, r.n, round(r.row_pct, 6) AS row_pct, round(coalesce(gl.global_pct, 0.0), 6) AS global_pct,
       round(r.row_pct - coalesce(gl.global_pct, 0.0), 6) AS deviation
FROM r LEFT JOIN gl ON gl.lang = r.lang""")
def q_deviation(spark, sf):
    """Row % of each language per source and its deviation from the global %."""
    d = assoc.deviation(load(spark, sf, "documents", ["source", "lang"]), "source", "lang")
    return d.select("source", "lang", "n", rnd("row_pct").alias("row_pct"),
                    rnd("global_pct").alias("global_pct"), rnd("deviation").alias("deviation"))


_LOG_ODDS_SQL = """
WITH b AS (SELECT * FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
g AS (SELECT l.lang, s.source, count(b.doc_id) AS n
      FROM (SELECT DISTINCT lang FROM b) l CROSS JOIN (SELECT DISTINCT source FROM b) s
      LEFT JOIN b ON b.lang = l.lang AND b.source = s.source GROUP BY l.lang, s.source),
t AS (SELECT lang, source, n AS a,
             sum(n) OVER (PARTITION BY lang) - n AS b_,
             sum(n) OVER (PARTITION BY source) - n AS c_,
             sum(n) OVER () AS tot FROM g),
lo AS (SELECT lang, source, a AS n,
              ln(((a + 0.5::DOUBLE) / (b_ + 0.5::DOUBLE)) / ((c_ + 0.5::DOUBLE) / ((tot - a - b_ - c_) + 0.5::DOUBLE))) AS log_odds
       FROM t)"""


@register("log_odds", _LOG_ODDS_SQL + " SELECT lang, source, n, round(log_odds, 6) AS log_odds FROM lo")
def q_log_odds(spark, sf):
    """Log odds of language × source with the +½ correction."""
    lo = assoc.log_odds(load(spark, sf, "documents", ["lang", "source"]), "lang", "source")
    return lo.select("lang", "source", "n", rnd("log_odds").alias("log_odds"))


@register("max_abs", _LOG_ODDS_SQL + " SELECT round(max(abs(log_odds)), 6) AS max_abs FROM lo")
def q_max_abs(spark, sf):
    """A10: symmetric scale of the log-odds table."""
    lo = assoc.log_odds(load(spark, sf, "documents", ["lang", "source"]), "lang", "source")
    return assoc.max_abs(lo, "log_odds").withColumn("max_abs", rnd("max_abs"))


@register("label_cluster_counts", """
SELECT lang, source, count(*) AS n,
       CASE grouping_id(lang, source) WHEN 0 THEN 'label_cluster' WHEN 1 THEN 'label' ELSE 'cluster' END AS level
FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source))""")
def q_label_cluster_counts(spark, sf):
    """Counts by (label, group), label, group in one grouping-sets pass."""
    return assoc.label_cluster_counts(load(spark, sf, "documents", ["lang", "source"]), "lang", "source")


# ------------------------------------------------------------------ vectors
_EMB_SQL = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def _emb(spark, sf):
    return load(spark, sf, "embeddings", ["vec_id", "embedding", "label"])


@register("l2_normalise", f"""
WITH {_EMB_SQL},
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM e)
SELECT vec_id, unnest(generate_series(0, len(v) - 1)) AS pos,
       unnest(list_transform(v, lambda x: round(CASE WHEN nrm > 0 THEN x / nrm ELSE x END, 6))) AS value
FROM n""")
def q_l2_normalise(spark, sf):
    """Unit-length vectors, shown element by element."""
    n = vectors.l2_normalise(_emb(spark, sf), "embedding", "unit")
    return n.select("vec_id", F.posexplode("unit").alias("pos", "value")) \
            .select("vec_id", F.col("pos").cast("long").alias("pos"), rnd("value").alias("value"))


_CENTROID_SQL = f"""
{_EMB_SQL},
x AS (SELECT label, unnest(generate_series(0, len(v) - 1)) AS dim, unnest(v) AS val FROM e),
c AS (SELECT label, dim, avg(CASE WHEN isnan(val) THEN NULL ELSE val END) AS mean FROM x GROUP BY label, dim)"""


@register("label_centroids", f"WITH {_CENTROID_SQL} SELECT label, dim, round(mean, 6) AS mean FROM c")
def q_label_centroids(spark, sf):
    """Mean embedding per label (missing values ignored), long form."""
    c = vectors.centroids_long(_emb(spark, sf), "label", "embedding")
    return c.select("label", F.col("dim").cast("long").alias("dim"), rnd("mean").alias("mean"))


@register("semantic_topk", f"""
WITH {_CENTROID_SQL},
q AS (SELECT label AS qid, list(mean ORDER BY dim) AS q FROM c GROUP BY label),
qn AS (SELECT qid, q, sqrt(list_sum(list_transform(q, lambda z: z * z))) AS qnorm FROM q),
en AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda z: z * z))) AS vnorm FROM e),
s AS (SELECT qn.qid AS label, en.vec_id,
             CASE WHEN vnorm > 0 THEN list_inner_product(en.v, qn.q) / (qnorm * vnorm) ELSE 0.0 END AS score
      FROM qn CROSS JOIN en)
SELECT label, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10""")
def q_semantic_topk(spark, sf):
    """The 10 rows most similar (cosine) to each label's mean vector."""
    emb = _emb(spark, sf)
    cents = vectors.centroids(emb, "label", "embedding")
    top = vectors.semantic_topk(emb, "vec_id", "embedding", cents, "label", "centroid", k=10)
    return top.select("label", "vec_id", rnd("score").alias("score"), F.col("rank").cast("long").alias("rank"))


# --- fixed values: keyword rules of the rule-score query (terms, points) ---
RULES = [(["the"], 1.0), (["and", "of"], 2.0), (["tion", "ing"], 3.0), (["en", "la", "le"], 1.5),
         (["der", "und"], 2.5), (["que"], 0.5)]


@register("rule_score", f"""
WITH t AS (SELECT doc_id, {_WORDS_SQL} AS toks FROM documents)
SELECT doc_id, (0.0::DOUBLE {''.join(
    " + CASE WHEN " + " AND ".join(f"list_contains(toks, '{w}')" for w in ws) + f" THEN {p}::DOUBLE ELSE 0.0::DOUBLE END"
    for ws, p in RULES)}) AS score FROM t""")
def q_rule_score(spark, sf):
    """Points per matched keyword rule (all terms of a rule present)."""
    return vectors.rule_score(_doc_tokens(spark, sf), "doc_id", "tokens", RULES)


@register("knn", f"""
WITH {_EMB_SQL},
p AS (SELECT a.vec_id, b.vec_id AS nbr,
             list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist
      FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT vec_id, nbr, round(dist, 6) AS dist, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nbr) AS rank FROM p) WHERE rank <= 5""")
def q_knn(spark, sf):
    """Exact 5 nearest neighbours of every vector (blocked self-join)."""
    nn = vectors.knn(_emb(spark, sf), "vec_id", "embedding", k=5)
    return nn.select("vec_id", "nbr", rnd("dist").alias("dist"), F.col("rank").cast("long").alias("rank"))


@register("dominant_dim", f"""
SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS dominant FROM embeddings""")
def q_dominant_dim(spark, sf):
    """Arg-max index per vector, ties to the lowest index."""
    d = vectors.dominant(_emb(spark, sf), "embedding")
    return d.select("vec_id", F.col("dominant").cast("long").alias("dominant"))


_CENTERS_SQL = f"""
{_EMB_SQL},
c AS (SELECT vec_id AS cid, label AS clabel, v AS cv FROM e ORDER BY vec_id LIMIT 10),
d AS (SELECT e.vec_id, e.label, c.cid, c.clabel,
             row_number() OVER (PARTITION BY e.vec_id ORDER BY
               list_sum(list_transform(list_zip(e.v, c.cv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.cid) AS rn
      FROM e CROSS JOIN c),
preds AS (SELECT vec_id, label, cid AS cluster, clabel AS prediction FROM d WHERE rn = 1)"""


def _fixed_centers(emb):
    # fixed model input: the 10 rows with the lowest ids are the centres
    return tables.debug_head(emb, 10, "vec_id")


@register("assign_clusters", f"WITH {_CENTERS_SQL} SELECT vec_id, cluster FROM preds")
def q_assign_clusters(spark, sf):
    """Nearest of fixed centres (squared Euclidean), ties to the lowest id."""
    emb = _emb(spark, sf)
    a = vectors.assign_clusters(emb, "embedding", _fixed_centers(emb), "vec_id", "embedding")
    return a.select("vec_id", "cluster")


@register("cluster_label_crosstab", f"""
WITH {_CENTERS_SQL},
dom AS (SELECT cid AS cluster FROM c),
labs AS (SELECT DISTINCT label FROM preds)
SELECT dom.cluster, labs.label, count(preds.vec_id) AS n
FROM dom CROSS JOIN labs LEFT JOIN preds ON preds.cluster = dom.cluster AND preds.label = labs.label
GROUP BY dom.cluster, labs.label""")
def q_cluster_label_crosstab(spark, sf):
    """Cluster × label counts re-indexed to every cluster id (empty clusters kept)."""
    emb = _emb(spark, sf)
    centers = _fixed_centers(emb)
    a = vectors.assign_clusters(emb, "embedding", centers, "vec_id", "embedding")
    return assoc.crosstab(a, "cluster", "label", domain=centers.select(F.col("vec_id").alias("cluster")))


# ------------------------------------------------------------------ evaluation
@register("label_encode", """
WITH m AS (SELECT source, (row_number() OVER (ORDER BY source) - 1)::INTEGER AS label_id
           FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))
SELECT d.doc_id, d.source, m.label_id FROM documents d LEFT JOIN m ON m.source = d.source""")
def q_label_encode(spark, sf):
    """String label → dense class id, classes sorted."""
    return evaluate.label_encode(load(spark, sf, "documents", ["doc_id", "source"]), "source") \
                   .select("doc_id", "source", "label_id")


_HASH_SQL = "('0x' || substr(md5('42:' || vec_id::VARCHAR), 1, 8))::BIGINT"
_FOLDS_SQL = f"""
folds AS (SELECT vec_id, ((row_number() OVER (PARTITION BY label ORDER BY {_HASH_SQL}, vec_id) - 1) % 3)::INTEGER AS fold
          FROM embeddings)"""


@register("stratified_folds", f"""
WITH {_FOLDS_SQL} SELECT f.vec_id, e.label, f.fold FROM folds f JOIN embeddings e USING (vec_id)""")
def q_stratified_folds(spark, sf):
    """Stratified 3-fold assignment by hashed order within each class."""
    return evaluate.stratified_folds(_emb(spark, sf), "label", "vec_id", 3, 42).select("vec_id", "label", "fold")


@register("holdout", f"""
SELECT vec_id, ({_HASH_SQL} / 4294967296.0::DOUBLE) < 0.2::DOUBLE AS is_test FROM embeddings""")
def q_holdout(spark, sf):
    """20 % hold-out flag from the hashed key (not stratified)."""
    return evaluate.holdout(_emb(spark, sf), "vec_id", 0.2, 42).select("vec_id", "is_test")


_FOLD_METRICS_SQL = f"""
WITH {_CENTERS_SQL}, {_FOLDS_SQL},
p AS (SELECT f.fold, preds.label, preds.prediction FROM preds JOIN folds f USING (vec_id)),
acc AS (SELECT fold, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END::DOUBLE) AS accuracy FROM p GROUP BY fold),
cls AS (SELECT fold, label AS c FROM p UNION SELECT fold, prediction AS c FROM p),
tp AS (SELECT fold, label AS c, count(*) AS tp FROM p WHERE label = prediction GROUP BY fold, label),
nt AS (SELECT fold, label AS c, count(*) AS nt FROM p GROUP BY fold, label),
np AS (SELECT fold, prediction AS c, count(*) AS np FROM p GROUP BY fold, prediction),
f AS (SELECT cls.fold, 2.0::DOUBLE * coalesce(tp.tp, 0) / (coalesce(nt.nt, 0) + coalesce(np.np, 0)) AS f1
      FROM cls LEFT JOIN tp ON tp.fold = cls.fold AND tp.c = cls.c
      LEFT JOIN nt ON nt.fold = cls.fold AND nt.c = cls.c
      LEFT JOIN np ON np.fold = cls.fold AND np.c = cls.c),
m AS (SELECT acc.fold, acc.accuracy, (SELECT avg(f1) FROM f WHERE f.fold = acc.fold) AS macro_f1 FROM acc)"""


def _fold_metrics(spark, sf):
    emb = _emb(spark, sf)
    centers = _fixed_centers(emb).select(F.col("vec_id").alias("cid"), F.col("embedding").alias("cv"),
                                         F.col("label").alias("clabel"))
    a = vectors.assign_clusters(emb, "embedding", centers, "cid", "cv", out="cluster")
    cl = centers.select(F.col("cid").alias("cluster"), F.col("clabel").alias("prediction"))
    preds = a.join(F.broadcast(cl), "cluster")
    folds = evaluate.stratified_folds(emb.select("vec_id", "label"), "label", "vec_id", 3, 42).select("vec_id", "fold")
    p = preds.join(folds, "vec_id")
    return evaluate.accuracy(p, "label", "prediction", ["fold"]).join(
        evaluate.macro_f1(p, "label", "prediction", ["fold"]), "fold")


@register("fold_metrics", _FOLD_METRICS_SQL + """
SELECT fold, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM m""")
def q_fold_metrics(spark, sf):
    """Accuracy and macro F1 per fold of a fixed nearest-centre classifier."""
    m = _fold_metrics(spark, sf)
    return m.select("fold", rnd("accuracy").alias("accuracy"), rnd("macro_f1").alias("macro_f1"))


@register("fold_summary", _FOLD_METRICS_SQL + """
SELECT round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_std,
       round(avg(macro_f1), 6) AS macro_f1_mean, round(stddev_pop(macro_f1), 6) AS macro_f1_std FROM m""")
def q_fold_summary(spark, sf):
    """Mean and population std of the per-fold scores."""
    s = evaluate.fold_summary(_fold_metrics(spark, sf), ["accuracy", "macro_f1"])
    return s.select(*[rnd(c).alias(c) for c in s.columns])


@register("baselines", """
WITH c AS (SELECT lang, count(*)::DOUBLE AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang),
s AS (SELECT sum(n) AS tot, count(*)::DOUBLE AS k, max(n) AS mx FROM c)
SELECT k::BIGINT AS n_classes, round(mx / tot, 6) AS majority_accuracy,
       round((2 * (mx / tot) / (1 + mx / tot)) / k, 6) AS majority_macro_f1,
       round(1.0::DOUBLE / k, 6) AS random_accuracy,
       round((SELECT sum(2 * (n / tot) / (k * (n / tot) + 1)) FROM c) / k, 6) AS random_macro_f1
FROM s""")
def q_baselines(spark, sf):
    """Majority-class and uniform-random accuracy / macro F1."""
    b = evaluate.baselines(load(spark, sf, "documents", ["lang"]), "lang")
    return b.select("n_classes", *[rnd(c).alias(c) for c in b.columns if c != "n_classes"])


# ------------------------------------------------------------------ topic report (fixed model)
# Fixed model input for the topic-report operators: each language is a topic;
# its term weights are the term's occurrences in that language's documents
# (vocabulary terms only) plus a 0.1 prior; each document belongs wholly to its
# language's topic.  The operators themselves take any (topic, term, weight),
# (doc, topic, theta) and (doc, n) tables, e.g. those of a fitted LDA.
from labelprism.operators import topics  # noqa: E402
from labelprism.operators.domain import small_domain as tables_small_domain  # noqa: E402

PRIOR = 0.1


_FIXED: dict[tuple, str] = {}


def _files(spark, sf, name) -> tuple:
    """Names, sizes and times of a table's files: what a copy of it is good for."""
    out = []
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for f in sorted(load(spark, sf, name).inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f))
        state = path.getFileSystem(conf).getFileStatus(path)
        out.append((f, state.getLen(), state.getModificationTime()))
    return tuple(out)


def _fixed_bow(spark, sf):
    """``(doc_id, label, source, term, tf)`` inside the vocabulary: what the fixed
    models are made of.  Written to the shared folder once per application and
    state of the table's files, and read by every query of the topic report."""
    key = (spark.sparkContext.applicationId, sf, _files(spark, sf, "documents"))
    if key not in _FIXED:
        docs = load(spark, sf, "documents", ["doc_id", "text", "lang", "source"]).withColumnRenamed("lang", "label")
        # always dealt by document: the texts are exchanged, not a row per document and term
        parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
        docs = text.add_word_tokens(docs.repartition(parts, "doc_id"), "text").drop("text")
        full = text.bag_of_words(docs, "doc_id", "tokens", keep=["label", "source"])
        n_docs = load(spark, sf, "documents", ["doc_id"]).agg(F.count(F.lit(1)).cast("double")).scalar()
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/topic-report-{uuid.uuid4().hex}"
        # the terms are few beside the pairs: they go to the pairs, as long as they fit
        vocab = text.vocabulary_from_bow(full, n_docs, 7, 0.8).select("term").checkpoint(eager=True)
        with shuffles_removed(spark):
            text.count_vectorise(full, text._bounded_broadcast(vocab)).write.parquet(folder)
        _FIXED[key] = folder
    return spark.read.parquet(_FIXED[key])


def _group_topic_terms(spark, sf, group, col):
    """Term weights of each group; every value of the documents' ``col`` is a topic."""
    occ = _fixed_bow(spark, sf).where(F.col(group).isNotNull()).select(F.col(group).alias("topic"), "term", "tf")
    every = load(spark, sf, "documents", [col]).where(F.col(col).isNotNull()).select(F.col(col).alias("topic")).distinct()
    grid = assoc.complete_counts(occ, "term", "topic", n="n", weight="tf", col_domain=every)
    return grid.select("topic", "term", (F.col("n") + F.lit(PRIOR)).alias("weight"))


def _topic_domain(spark, sf, col):
    # the topics of the fixed model: every value of the grouping column
    return tables_small_domain(load(spark, sf, "documents", [col]), col)


def _lang_model(spark, sf):
    bow = _fixed_bow(spark, sf)
    docs = load(spark, sf, "documents", ["doc_id", "lang"])
    dt = docs.where(F.col("lang").isNotNull()).select("doc_id", F.col("lang").alias("topic"), F.lit(1.0).alias("theta"))
    return _group_topic_terms(spark, sf, "label", "lang"), dt, bow.groupBy("doc_id").agg(F.sum("tf").alias("n"))


_TOPIC_BASE_SQL = f"""
WITH {_VOCAB_SQL},
bow AS (SELECT doc_id, term, tf FROM (
          SELECT doc_id, term, count(*) AS tf
          FROM (SELECT doc_id, unnest({_WORDS_SQL}) AS term FROM documents) GROUP BY doc_id, term)
        WHERE term IN (SELECT term FROM vocab)),
dl AS (SELECT doc_id, lang AS topic FROM documents WHERE lang IS NOT NULL),
occ AS (SELECT dl.topic, bow.term, sum(bow.tf) AS n FROM bow JOIN dl USING (doc_id) GROUP BY dl.topic, bow.term),
tt AS (SELECT t.topic, v.term, coalesce(o.n, 0) + {PRIOR}::DOUBLE AS weight
       FROM (SELECT DISTINCT topic FROM dl) t CROSS JOIN (SELECT DISTINCT term FROM occ) v
       LEFT JOIN occ o ON o.topic = t.topic AND o.term = v.term),
dlen AS (SELECT doc_id, sum(tf) AS n FROM bow GROUP BY doc_id),
tf0 AS (SELECT dl.topic, sum(1.0::DOUBLE * dlen.n) AS topic_freq FROM dl JOIN dlen USING (doc_id) GROUP BY dl.topic),
ts AS (SELECT topic, topic_freq, topic_freq / sum(topic_freq) OVER () AS proportion,
              row_number() OVER (ORDER BY topic_freq DESC, topic) AS topic_order FROM tf0),
ws AS (SELECT topic, sum(weight) AS wsum FROM tt GROUP BY topic),
ph AS (SELECT tt.topic, tt.term, tt.weight / ws.wsum AS phi, tt.weight / ws.wsum * ts.topic_freq AS freq
       FROM tt JOIN ws USING (topic) JOIN ts USING (topic)),
tot AS (SELECT term, sum(freq) AS total FROM ph GROUP BY term),
cnt AS (SELECT ph.topic, ph.term, ph.phi, ph.freq, tot.total FROM ph JOIN tot USING (term)),
nall AS (SELECT sum(freq) AS n_all FROM cnt),
sc AS (SELECT topic, term, ln(phi) AS logprob, ln(phi / (total / (SELECT n_all FROM nall))) AS loglift FROM cnt),
top30 AS (SELECT * FROM (SELECT topic, term, weight,
                                row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM tt)
          WHERE rank <= 30)"""


@register("top_terms", _TOPIC_BASE_SQL + " SELECT topic, term, round(weight, 6) AS weight, rank FROM top30")
def q_top_terms(spark, sf):
    """30 heaviest terms per topic."""
    tt, _, _ = _lang_model(spark, sf)
    t = topics.top_terms(tt, 30)
    return t.select("topic", "term", rnd("weight").alias("weight"), F.col("rank").cast("long").alias("rank"))


@register("topic_report", _TOPIC_BASE_SQL + """
SELECT topic, 'Topic ' || topic AS name, rank, printf('  %d. %s (%.3f)', rank, term, weight) AS line FROM top30""")
def q_topic_report(spark, sf):
    """Ranked topic words as report lines (weight to 3 places)."""
    tt, _, _ = _lang_model(spark, sf)
    r = topics.topic_report(topics.top_terms(tt, 30))
    return r.select("topic", "name", F.col("rank").cast("long").alias("rank"), "line")


def _shares(spark, sf):
    tt, dt, dl = _lang_model(spark, sf)
    return tt, topics.topic_share(dt, dl, "doc_id")


@register("topic_share", _TOPIC_BASE_SQL + """
SELECT topic, round(topic_freq, 6) AS topic_freq, round(proportion, 6) AS proportion,
       round(proportion * 100.0::DOUBLE, 6) AS share_pct, topic_order FROM ts""")
def q_topic_share(spark, sf):
    """Topic share of corpus tokens and the size order of topics."""
    _, s = _shares(spark, sf)
    return s.select("topic", rnd("topic_freq").alias("topic_freq"), rnd("proportion").alias("proportion"),
                    rnd("share_pct").alias("share_pct"), F.col("topic_order").cast("long").alias("topic_order"))


def _counts(spark, sf):
    tt, s = _shares(spark, sf)
    return topics.topic_term_counts(tt, s), s


@register("topic_term_counts", _TOPIC_BASE_SQL + """
SELECT topic, term, round(phi, 6) AS phi, round(freq, 6) AS freq, round(total, 6) AS total FROM cnt""")
def q_topic_term_counts(spark, sf):
    """Expected term count per topic and term totals."""
    c, _ = _counts(spark, sf)
    return c.select("topic", "term", *[rnd(x).alias(x) for x in ("phi", "freq", "total")])


@register("token_shares", _TOPIC_BASE_SQL + """
SELECT topic, term, round(round_even(freq, 0) / total, 6) AS share FROM cnt WHERE freq >= 0.5""")
def q_token_shares(spark, sf):
    """Per-term topic shares from rounded expected counts."""
    c, _ = _counts(spark, sf)
    return topics.token_shares(c).withColumn("share", rnd("share"))


@register("topic_term_scores", _TOPIC_BASE_SQL + """
SELECT topic, term, round(logprob, 6) AS logprob, round(loglift, 6) AS loglift FROM sc""")
def q_topic_term_scores(spark, sf):
    """Log probability and log lift per (topic, term)."""
    c, _ = _counts(spark, sf)
    s = topics.topic_term_scores(c)
    return s.select("topic", "term", rnd("logprob").alias("logprob"), rnd("loglift").alias("loglift"))


@register("relevant_terms", _TOPIC_BASE_SQL + """,
lam AS (SELECT i::DOUBLE / 100::DOUBLE AS lam FROM range(0, 101) r(i)),
rel AS (SELECT topic, term, lam,
               row_number() OVER (PARTITION BY topic, lam
                                  ORDER BY round(lam * logprob + (1.0::DOUBLE - lam) * loglift, 9) DESC, term) AS rk
        FROM sc CROSS JOIN lam)
SELECT DISTINCT topic, term FROM rel WHERE rk <= 30""")
def q_relevant_terms(spark, sf):
    """Terms in the top 30 by relevance for some λ on a 0.01 grid."""
    c, _ = _counts(spark, sf)
    return topics.relevant_terms(topics.topic_term_scores(c), 30, 0.01)


@register("salient_terms", _TOPIC_BASE_SQL + """,
sal AS (SELECT cnt.term, max(cnt.total) / (SELECT n_all FROM nall)
                 * sum(CASE WHEN cnt.freq / cnt.total > 0
                            THEN cnt.freq / cnt.total * ln((cnt.freq / cnt.total) / ts.proportion) ELSE 0.0 END) AS saliency
        FROM cnt JOIN ts USING (topic) GROUP BY cnt.term)
SELECT term, round(saliency, 6) AS saliency, rank FROM (
  SELECT term, saliency, row_number() OVER (ORDER BY round(saliency, 9) DESC, term) AS rank FROM sal)
WHERE rank <= 30""")
def q_salient_terms(spark, sf):
    """The 30 most salient terms overall."""
    c, s = _counts(spark, sf)
    t = topics.salient_terms(c, s, 30)
    return t.select("term", rnd("saliency").alias("saliency"), F.col("rank").cast("long").alias("rank"))


@register("topic_distance", _TOPIC_BASE_SQL + """,
p AS (SELECT tt.topic, tt.term, tt.weight / ws.wsum AS p FROM tt JOIN ws USING (topic)),
pr AS (SELECT a.topic AS topic_a, b.topic AS topic_b, a.p AS pa, b.p AS pb
       FROM p a JOIN p b ON a.term = b.term AND a.topic < b.topic)
SELECT topic_a, topic_b,
       round(sum(0.5 * CASE WHEN pa > 0 THEN pa * ln(pa / ((pa + pb) / 2)) ELSE 0.0 END
               + 0.5 * CASE WHEN pb > 0 THEN pb * ln(pb / ((pa + pb) / 2)) ELSE 0.0 END), 6) AS jsd
FROM pr GROUP BY topic_a, topic_b""")
def q_topic_distance(spark, sf):
    """Jensen–Shannon divergence between every pair of topics."""
    tt, _, _ = _lang_model(spark, sf)
    return topics.topic_distance(tt, topics=_topic_domain(spark, sf, "lang")).withColumn("jsd", rnd("jsd"))


@register("topic_overlap", _TOPIC_BASE_SQL + """,
ds AS (SELECT doc_id, source AS topic FROM documents WHERE source IS NOT NULL),
occ_s AS (SELECT ds.topic, bow.term, sum(bow.tf) AS n FROM bow JOIN ds USING (doc_id) GROUP BY ds.topic, bow.term),
tt_s AS (SELECT t.topic, v.term, coalesce(o.n, 0) + 0.1::DOUBLE AS weight
         FROM (SELECT DISTINCT topic FROM ds) t CROSS JOIN (SELECT DISTINCT term FROM occ_s) v
         LEFT JOIN occ_s o ON o.topic = t.topic AND o.term = v.term),
top_s AS (SELECT * FROM (SELECT topic, term,
                                row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM tt_s)
          WHERE rank <= 30),
A AS (SELECT topic AS topic_a, term FROM top30), B AS (SELECT topic AS topic_b, term FROM top_s),
sa AS (SELECT topic_a, count(*) AS na FROM A GROUP BY topic_a),
sb AS (SELECT topic_b, count(*) AS nb FROM B GROUP BY topic_b),
hits AS (SELECT topic_a, topic_b, count(*) AS inter FROM A JOIN B USING (term) GROUP BY topic_a, topic_b)
SELECT sa.topic_a, sb.topic_b, coalesce(h.inter, 0) AS inter, na + nb - coalesce(h.inter, 0) AS n_union,
       round(coalesce(h.inter, 0) / (na + nb - coalesce(h.inter, 0))::DOUBLE, 6) AS jaccard
FROM sa CROSS JOIN sb LEFT JOIN hits h ON h.topic_a = sa.topic_a AND h.topic_b = sb.topic_b""")
def q_topic_overlap(spark, sf):
    """Jaccard overlap of the top-30 word lists of two topic models
    (language topics vs source topics)."""
    top_a = topics.top_terms(_group_topic_terms(spark, sf, "label", "lang"), 30)
    top_b = topics.top_terms(_group_topic_terms(spark, sf, "source", "source"), 30)
    return topics.topic_overlap(top_a, top_b).withColumn("jaccard", rnd("jaccard"))


_ALIGN_SQL = _TOPIC_BASE_SQL.replace("WITH", "WITH RECURSIVE", 1) + """,
ds AS (SELECT doc_id, source AS topic FROM documents WHERE source IS NOT NULL),
occ_s AS (SELECT ds.topic, bow.term, sum(bow.tf) AS n FROM bow JOIN ds USING (doc_id) GROUP BY ds.topic, bow.term),
top_s AS (SELECT * FROM (SELECT t.topic, v.term, row_number() OVER (PARTITION BY t.topic ORDER BY coalesce(o.n, 0) DESC, v.term) AS rank
                         FROM (SELECT DISTINCT topic FROM ds) t CROSS JOIN (SELECT DISTINCT term FROM occ_s) v
                         LEFT JOIN occ_s o ON o.topic = t.topic AND o.term = v.term) WHERE rank <= 30),
A AS (SELECT ts.topic_order AS o, top30.term FROM top30 JOIN ts USING (topic)),
B AS (SELECT regexp_extract(topic, '[0-9]+')::INTEGER AS t, term FROM top_s),
ok AS (SELECT * FROM (SELECT o, t, count(*) / (60.0::DOUBLE - count(*)) AS j FROM A JOIN B USING (term) GROUP BY o, t) WHERE j > 0.1),
m(o, used, t) AS (SELECT 0::BIGINT, []::INTEGER[], NULL::INTEGER
  UNION ALL SELECT o, CASE WHEN t IS NULL THEN used ELSE list_append(used, t) END, t
  FROM (SELECT m.o + 1 AS o, m.used, ok.t, row_number() OVER (ORDER BY j DESC NULLS LAST, ok.t) AS r
        FROM m LEFT JOIN ok ON ok.o = m.o + 1 AND NOT list_contains(m.used, ok.t) WHERE m.o < (SELECT count(*) FROM ts)) WHERE r = 1),
hole AS (SELECT o, row_number() OVER (ORDER BY o) AS k FROM m WHERE o > 0 AND t IS NULL),
free AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM B) WHERE t NOT IN (SELECT t FROM m WHERE t IS NOT NULL)),
every AS (SELECT t, o FROM m WHERE t IS NOT NULL UNION ALL SELECT free.t, hole.o FROM free LEFT JOIN hole USING (k))
SELECT t AS topic, CASE WHEN o IS NULL THEN 'Topic ' || (t + 1) || ' (Unmapped)' ELSE 'Topic' || o END AS name,
       row_number() OVER (ORDER BY o NULLS LAST, t) - 1 AS position FROM every"""


@register("topic_alignment", _ALIGN_SQL)
def q_topic_alignment(spark, sf):
    """The source topics named after the language topics of the report
    (by size), by the overlap of their 30 heaviest words."""
    tt, shares = _shares(spark, sf)
    shown = topics.top_terms(tt, 30).join(shares.select("topic", "topic_order"), "topic")
    shown = shown.select(F.concat(F.lit("Topic"), F.col("topic_order").cast("string")).alias("topic"), "term")
    other = topics.top_terms(_group_topic_terms(spark, sf, "source", "source"), 30)
    other = other.select(number_in_name("topic").cast("int").alias("topic"), "term").checkpoint(eager=True)
    overlap = topics.topic_overlap(shown, other)
    got = topics.align_topics(overlap, other.select("topic"), shown.select(F.col("topic").alias("name")))
    return got.select("topic", "name", F.col("position").cast("long").alias("position"))


# a wide table needs its columns by name: the sources of the test tables
_SOURCES = [f"src{k}" for k in range(20)]


@register("pivot_named", _LOG_ODDS_SQL + """,
r AS (SELECT lang, source, round(log_odds, 6) AS log_odds FROM lo)
SELECT lang, """ + ", ".join(f"max(CASE WHEN source = '{x}' THEN log_odds END) AS {x}" for x in _SOURCES) + """
FROM r GROUP BY lang""")
def q_pivot_named(spark, sf):
    """Language × source log odds as a wide table, columns in
    numeric order of the source name."""
    lo = assoc.log_odds(load(spark, sf, "documents", ["lang", "source"]), "lang", "source")
    return topics.pivot_named(lo.withColumn("log_odds", rnd("log_odds")), "lang", "source", "log_odds")


# ------------------------------------------------------------------ encoders
from labelprism.operators import classify, cluster, coherence, encode  # noqa: E402


@register("hashed_tfidf", f"""
WITH t AS (SELECT doc_id, unnest({_WORDS_SQL}) AS term FROM documents),
tf AS (SELECT doc_id, (('0x' || substr(md5(term), 1, 8))::BIGINT % 256)::INTEGER AS bucket, count(*) AS tf
       FROM t GROUP BY 1, 2),
dfb AS (SELECT bucket, count(*) AS df FROM tf GROUP BY bucket),
w AS (SELECT tf.doc_id, tf.bucket,
             tf.tf * ln(((SELECT count(*)::DOUBLE FROM documents) + 1) / (dfb.df + 1)) AS w
      FROM tf JOIN dfb USING (bucket)),
nr AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY doc_id)
SELECT doc_id, bucket, round(CASE WHEN nrm > 0 THEN w / nrm ELSE 0.0 END, 6) AS value FROM w JOIN nr USING (doc_id)""")
def q_hashed_tfidf(spark, sf):
    """Hashed TF-IDF document vectors (non-zero cells), unit length."""
    v = encode.hashed_tfidf_long(_doc_tokens(spark, sf), "doc_id", "tokens", 256)
    return v.withColumn("value", rnd("value"))


@register("embed_documents", f"""
WITH d AS (SELECT doc_id, text FROM documents WHERE length(coalesce(text, '')) > 0),
t AS (SELECT doc_id, unnest({_WORDS_SQL}) AS term FROM d),
tf AS (SELECT doc_id, (('0x' || substr(md5(term), 1, 8))::BIGINT % 64)::INTEGER AS bucket, count(*) AS tf FROM t GROUP BY 1, 2),
dfb AS (SELECT bucket, count(*) AS df FROM tf GROUP BY bucket),
w AS (SELECT tf.doc_id, tf.bucket, tf.tf * ln(((SELECT count(*)::DOUBLE FROM d) + 1) / (dfb.df + 1)) AS w FROM tf JOIN dfb USING (bucket)),
nr AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY doc_id),
grid AS (SELECT doc_id, unnest(range(64))::INTEGER AS pos FROM d)
SELECT grid.doc_id, grid.pos, round(coalesce(CASE WHEN nrm > 0 THEN w.w / nrm END, 0.0)::FLOAT::DOUBLE, 5) AS value
FROM grid LEFT JOIN w ON w.doc_id = grid.doc_id AND w.bucket = grid.pos LEFT JOIN nr ON nr.doc_id = grid.doc_id""")
def q_embed_documents(spark, sf):
    """Null texts filled, empty ones dropped, one dense vector per document, element by element."""
    from labelprism.plans import embedding_eval
    docs = tables.spread(load(spark, sf, "documents", ["doc_id", "text"]), "doc_id")
    v = embedding_eval.embed(docs, "doc_id", "text", dims=64)
    return v.select("doc_id", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.round(F.col("value").cast("double"), 5))


@register("knn_approximate", """
SELECT count(*) FILTER (WHERE vec_id % 100 = 0) AS n_rows, 5 * count(*) FILTER (WHERE vec_id % 100 = 0) AS n_links, 5 * count(*) AS n_found, true AS recalled FROM embeddings""")
def q_knn_approximate(spark, sf):
    """Five approximate neighbours of every vector; of every hundredth one, at least 0.9 of the exact ones."""
    from labelprism.operators import neighbours, vectors
    e = _emb(spark, sf)
    found = neighbours.knn_approximate(e, "vec_id", "embedding", k=5).checkpoint(eager=True)
    exact = vectors.knn(e.withColumn("asked", F.col("vec_id") % 100 == 0), "vec_id", "embedding", k=5, query_flag="asked")
    n_found = found.count()
    return neighbours.knn_recall(found, exact, "vec_id").select("n_rows", "n_links", F.lit(n_found).cast("long").alias("n_found"), (F.col("recall") >= 0.9).alias("recalled"))


# ------------------------------------------------------------------ oversampling
@register("smote", f"""
WITH {_EMB_SQL},
sz AS (SELECT label, count(*) AS nc FROM e GROUP BY label),
mx AS (SELECT max(nc) AS nmax FROM sz),
r AS (SELECT e.vec_id, e.label, e.v, sz.nc,
             row_number() OVER (PARTITION BY e.label ORDER BY {_HASH_SQL}, e.vec_id) - 1 AS r
      FROM e JOIN sz USING (label)),
c AS (SELECT *, ((SELECT nmax FROM mx) - nc) // nc
                + CASE WHEN r < ((SELECT nmax FROM mx) - nc) % nc THEN 1 ELSE 0 END AS copies FROM r),
cp AS (SELECT vec_id, label, v, nc, unnest(generate_series(1, copies)) AS copy FROM c WHERE copies > 0),
nn AS (SELECT * FROM (
         SELECT a.vec_id, b.vec_id AS nbr, b.v AS nv,
                row_number() OVER (PARTITION BY a.vec_id ORDER BY
                  list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.vec_id) AS rank
         FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE rank <= 5),
pk AS (SELECT cp.*,
              (('0x' || substr(md5('43:' || vec_id::VARCHAR || ':' || copy::VARCHAR), 1, 8))::BIGINT
                 % greatest(least(5, nc - 1), 1)) + 1 AS pick,
              ('0x' || substr(md5('44:' || vec_id::VARCHAR || ':' || copy::VARCHAR), 1, 8))::BIGINT
                 / 4294967296.0::DOUBLE AS gap
       FROM cp),
s AS (SELECT pk.vec_id, pk.label, pk.copy,
             CASE WHEN nn.nv IS NULL THEN pk.v
                  ELSE list_transform(list_zip(pk.v, nn.nv), lambda z: z[1] + pk.gap * (z[2] - z[1])) END AS nv
      FROM pk LEFT JOIN nn ON nn.vec_id = pk.vec_id AND nn.rank = pk.pick)
SELECT vec_id, label, copy, unnest(generate_series(0, len(nv) - 1)) AS pos,
       unnest(list_transform(nv, lambda x: round(x, 6))) AS value FROM s""")
def q_smote(spark, sf):
    """Synthetic minority rows (every class raised to the majority size),
    element by element."""
    s = classify.smote(_emb(spark, sf), "label", "embedding", "vec_id", k=5, seed=42)
    syn = s.where(F.col("copy") > 0)
    return syn.select("vec_id", "label", "copy", F.posexplode("embedding").alias("pos", "value")) \
              .select("vec_id", "label", "copy", F.col("pos").cast("long").alias("pos"), rnd("value").alias("value"))


# ------------------------------------------------------------------ fitted models (property checks)
def _cv_sql(window: int = 110) -> str:
    """c_v of the topics of ``tw`` (topic, term): intervals of window starts merged into islands,
    joint counts from overlapping islands, all pairs of a topic's words in one table."""
    return f"""
wd AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_WS_SQL}+'), lambda x: x <> '') AS w FROM documents),
tk AS (SELECT doc_id, len(w) AS n, unnest(range(len(w))) AS p, lower(unnest(w)) AS term FROM wd),
rel AS (SELECT * FROM tk WHERE term IN (SELECT term FROM tw)),
nw AS (SELECT sum(greatest(1, n - {window - 1}))::DOUBLE AS n FROM (SELECT DISTINCT doc_id, n FROM rel)),
iv AS (SELECT doc_id, term, greatest(0, p - {window - 1}) AS lo, least(p, greatest(0, n - {window})) AS hi, p FROM rel),
st AS (SELECT *, CASE WHEN lo <= lag(hi) OVER (PARTITION BY doc_id, term ORDER BY p) + 1 THEN 0 ELSE 1 END AS new FROM iv),
gr AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, term ORDER BY p) AS g FROM st),
isl AS (SELECT doc_id, term, min(lo) AS lo, max(hi) AS hi FROM gr GROUP BY doc_id, term, g),
pw AS (SELECT term, sum(hi - lo + 1) / (SELECT n FROM nw) AS p FROM isl GROUP BY term),
it AS (SELECT isl.*, topic FROM isl JOIN tw USING (term)),
pj AS (SELECT a.topic, a.term AS a, b.term AS b, sum(least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1) / (SELECT n FROM nw) AS p
       FROM it a JOIN it b ON a.topic = b.topic AND a.doc_id = b.doc_id AND a.term <> b.term AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY ALL),
npmi AS (SELECT x.topic, x.term AS a, y.term AS b,
                CASE WHEN coalesce(px.p, 0) > 0 AND coalesce(py.p, 0) > 0
                     THEN ln((CASE WHEN x.term = y.term THEN px.p ELSE coalesce(pj.p, 0) END + 1e-12::DOUBLE) / (px.p * py.p))
                          / -ln(CASE WHEN x.term = y.term THEN px.p ELSE coalesce(pj.p, 0) END + 1e-12::DOUBLE) ELSE 0.0 END AS v
         FROM tw x JOIN tw y ON x.topic = y.topic LEFT JOIN pw px ON px.term = x.term LEFT JOIN pw py ON py.term = y.term
         LEFT JOIN pj ON pj.topic = x.topic AND pj.a = x.term AND pj.b = y.term),
cvt AS (SELECT topic, b, sum(v) AS s FROM npmi GROUP BY topic, b),
tn AS (SELECT topic, sqrt(sum(s * s)) AS norm FROM cvt GROUP BY topic),
cs AS (SELECT topic, a, CASE WHEN sqrt(sum(v * v)) > 0 AND any_value(norm) > 0 THEN sum(v * s) / (sqrt(sum(v * v)) * any_value(norm)) ELSE 0.0 END AS c
       FROM npmi JOIN cvt USING (topic, b) JOIN tn USING (topic) GROUP BY topic, a),
cv AS (SELECT topic, avg(c) AS coherence FROM cs GROUP BY topic)"""


@register("coherence_cv", _TOPIC_BASE_SQL + ",\ntw AS (SELECT DISTINCT topic, lower(term) AS term FROM top30)," + _cv_sql() + """
SELECT topic, round(coherence, 6) AS coherence FROM cv""")
def q_coherence_cv(spark, sf):
    """c_v coherence of the language topics' top-30 words over the
    whitespace tokens of every document (110-token windows)."""
    tt, _, _ = _lang_model(spark, sf)
    words = topics.top_terms(tt, 30).select("topic", "term")
    docs = text.add_ws_tokens(tables.spread(load(spark, sf, "documents", ["doc_id", "text"]), "doc_id"), "text")
    return coherence.coherence_cv(docs, "doc_id", "tokens", words, 110).withColumn("coherence", rnd("coherence"))


_KS = range(2, 21)

# models of every topic count that need no fit: topic t of model k is the documents with doc_id mod k = t,
# its words are the ten most frequent ones
_FIXED_SWEEP_SQL = f"""
WITH {_VOCAB_SQL},
occ AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS_SQL}) AS term FROM documents) WHERE term IN (SELECT term FROM vocab) GROUP BY doc_id, term),
ks AS (SELECT unnest(range({_KS.start}, {_KS.stop})) AS k),
wt AS (SELECT k, doc_id % k AS t, term, sum(tf) AS n FROM occ CROSS JOIN ks GROUP BY ALL),
tw AS (SELECT k || '/' || t AS topic, term FROM wt QUALIFY row_number() OVER (PARTITION BY k, t ORDER BY n DESC, term) <= 10),""" + _cv_sql() + """,
score AS (SELECT split_part(topic, '/', 1)::INTEGER AS k, avg(coherence) AS coherence FROM cv GROUP BY 1)"""


def _heaviest_by_remainder(ks: range, most: int):
    """Rows ``term, doc_id, tf`` with all rows of a term in one task, to the ``most`` heaviest
    terms of every topic (documents with ``doc_id mod k`` = topic) of every k among them."""
    first = np.cumsum([0, *ks])

    def run(batches):
        number: dict[str, int] = {}
        total = np.zeros((64, first[-1]), np.int64)
        for b in batches:
            coded = b.column("term").dictionary_encode()
            ids = np.array([number.setdefault(t, len(number)) for t in coded.dictionary.to_pylist()], np.int64)
            if len(number) > len(total):
                total = np.concatenate((total, np.zeros((max(len(total), len(number) - len(total)), total.shape[1]), np.int64)))
            row, doc, tf = ids[np.asarray(coded.indices)], np.asarray(b.column("doc_id")), np.asarray(b.column("tf"))
            for k, at in zip(ks, first):
                np.add.at(total.reshape(-1), row * total.shape[1] + at + np.mod(doc, k), tf)
        terms = list(number)
        rank = np.empty(len(terms), np.int64)
        rank[sorted(range(len(terms)), key=lambda i: terms[i].encode())] = np.arange(len(terms))
        for k, at in zip(ks, first):
            for topic in range(k):
                n = total[:len(terms), at + topic]
                best = [i for i in np.lexsort((rank, -n))[:most] if n[i]]
                yield pa.record_batch([pa.array([k] * len(best), pa.int32()), pa.array([topic] * len(best), pa.int64()),
                                       pa.array([terms[i] for i in best], pa.string()), pa.array(n[best], pa.int64())], ["k", "topic", "term", "n"])
    return run


def _fixed_sweep(spark, sf):
    # the bag of words is exchanged once, by term, for the models of every k
    bow = _fixed_bow(spark, sf).where("doc_id is not null").select("term", "doc_id", "tf")
    weights = bow.repartition("term").mapInArrow(_heaviest_by_remainder(_KS, 10), "k int, topic long, term string, n long")
    nth = F.row_number().over(Window.partitionBy("k", "topic").orderBy(F.col("n").desc(), "term"))
    words = weights.withColumn("rank", nth).where("rank <= 10").select("k", "topic", "term").checkpoint(eager=True)
    docs = text.add_ws_tokens(tables.spread(load(spark, sf, "documents", ["doc_id", "text"]), "doc_id"), "text")
    return coherence.model_coherence(docs, "doc_id", "tokens", words, 110)


@register("topic_count_scores", _FIXED_SWEEP_SQL + " SELECT k, round(coherence, 6) AS coherence FROM score")
def q_topic_count_scores(spark, sf):
    """M04's scores: the c_v of a model of every topic count 2 to 20, all counted in one pass over the windows."""
    return _fixed_sweep(spark, sf).withColumn("coherence", rnd("coherence"))


@register("best_topic_count", _FIXED_SWEEP_SQL + """
SELECT k AS best_k, round(coherence, 6) AS coherence FROM score ORDER BY score.coherence DESC, k LIMIT 1""")
def q_best_topic_count(spark, sf):
    """The topic count with the highest coherence of these models."""
    return coherence.best_k(_fixed_sweep(spark, sf)).withColumn("coherence", rnd("coherence"))


@register("topic_sweep")
def q_topic_sweep(spark, sf):
    """LDA of every topic count 2 to 20, fitted in shared passes, with its c_v (30 words a topic)."""
    bow = _fixed_bow(spark, sf).select("doc_id", "term", "tf")
    docs = text.add_ws_tokens(tables.spread(load(spark, sf, "documents", ["doc_id", "text"]), "doc_id"), "text")
    return coherence.sweep_topics(bow, docs, "doc_id", "tokens", _KS)


@register("lda_topics")
def q_lda_topics(spark, sf):
    """Fit LDA (k=10) on normalised English-default text, name
    its topics, and report the label × dominant-topic log odds."""
    from labelprism.plans import topic_analysis
    docs = load(spark, sf, "documents", ["doc_id", "text", "lang"])
    res = topic_analysis.run(tables.spread(docs, "doc_id"), "doc_id", "text", "lang", k=10)
    names = res["topic_names"].select(F.col("topic").alias("dominant_topic"), "name", "position")
    return res["label_topic_log_odds"].join(names, "dominant_topic").withColumn("log_odds", rnd("log_odds"))


@register("cluster_profile")
def q_cluster_profile(spark, sf):
    """PCA-10 + k-means (10 restarts) on unit vectors;
    cluster × label deviation table."""
    from labelprism.plans import cluster_profile
    res = cluster_profile.run(_emb(spark, sf), "vec_id", "embedding", "label", k=10)
    d = res["deviation"]
    return d.select("cluster", "label", "n", rnd("row_pct").alias("row_pct"), rnd("deviation").alias("deviation"))


@register("cluster_map")
def q_cluster_map(spark, sf):
    """Non-linear 10-D coordinates, their clusters, and each label's centroid and rows on the 2-D map."""
    from labelprism.plans import cluster_profile
    res = cluster_profile.run(_emb(spark, sf), "vec_id", "embedding", "label", k=10, nonlinear=True)
    n = res["table"].groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("n_clusters"))
    return res["centroids"].join(n, "label").select("label", rnd("centroid_x").alias("centroid_x"), rnd("centroid_y").alias("centroid_y"), "n", "n_clusters")


@register("training_part", """
WITH e AS (SELECT vec_id, label, ('0x' || substr(md5('49:' || vec_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2 AS is_val FROM embeddings),
fit AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS n,
               row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(md5('42:' || vec_id::VARCHAR), 1, 8))::BIGINT, vec_id) - 1 AS r
        FROM e WHERE NOT is_val),
need AS (SELECT *, (SELECT max(n) FROM fit) - n AS m FROM fit),
made AS (SELECT vec_id, label, unnest(range(1, m // n + CASE WHEN r < m % n THEN 1 ELSE 0 END + 1)) AS copy FROM need)
SELECT vec_id, label, 0::BIGINT AS copy, is_val FROM e UNION ALL SELECT vec_id, label, copy, false FROM made""")
def q_training_part(spark, sf):
    """The rows a model is fitted on, row by row: 20 % held out first, the rest oversampled."""
    part = classify.training_part(_emb(spark, sf), "label", "embedding", "vec_id", seed=42)
    return part.select("vec_id", "label", "copy", "is_val")


@register("classifier_eval")
def q_classifier_eval(spark, sf):
    """Nested CV of boosted trees on two embedding tables, the given
    vectors and hashed TF-IDF of the documents: 3 outer folds, each tuned by 10
    draws from ``SEARCH_SPACE`` over 2 inner folds; hold-out and SMOTE in
    training parts only.  That is 126 fits of 100 to 300 trees a class."""
    from labelprism.plans import embedding_eval
    docs = load(spark, sf, "documents", ["doc_id", "text", "lang"])
    coded = embedding_eval.embed(tables.spread(docs, "doc_id"), "doc_id", "text")
    made = coded.select(F.col("doc_id").alias("vec_id"), "embedding", F.col("lang").alias("label"))
    return embedding_eval.run({"vectors": _emb(spark, sf), "hashed_tfidf": made}, "label", "embedding", "vec_id",
                              kind="gbt", outer=3, inner=2, trials=10)


# ------------------------------------------------------------------ keywords over lemmatised text
_NORM_SQL = f"""
stop(form) AS (VALUES {_values([(w,) for w in _STOP_ALL])}),
lem(form, lemma) AS (VALUES {_values(LEMMA_PAIRS)}),
base AS (SELECT doc_id, text, lang FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
r AS (SELECT doc_id, regexp_extract_all(text, '{text.ALNUM_RUN}') AS r FROM base),
toks AS (SELECT doc_id, unnest(generate_series(1, len(r))) AS pos, unnest(r) AS w FROM r),
f AS (SELECT doc_id, pos, w, lower(w) AS lw FROM toks WHERE regexp_full_match(w, '\\p{{L}}+')),
norm AS (SELECT f.doc_id, string_agg(coalesce(lem.lemma, f.w), ' ' ORDER BY pos) AS norm_text
         FROM f LEFT JOIN lem ON lem.form = f.lw WHERE f.lw NOT IN (SELECT form FROM stop) GROUP BY f.doc_id)"""

_LEMMA_ODDS_SQL = f"""
WITH {_NORM_SQL},
docs AS (SELECT b.doc_id, b.lang AS label, regexp_extract_all(lower(n.norm_text), '{_WORD_SQL}', 1) AS toks
         FROM norm n JOIN base b USING (doc_id)
         WHERE regexp_matches(n.norm_text, '[^{_WS_SQL[1:-1]}]')),
pres AS (SELECT DISTINCT doc_id, label, unnest(toks) AS term FROM docs),
lab AS (SELECT label, count(*) AS nl FROM docs GROUP BY label),
tot AS (SELECT sum(nl)::BIGINT AS n FROM lab),
tdf AS (SELECT term, count(*) AS df FROM pres GROUP BY term),
cell AS (SELECT label, term, count(*) AS a FROM pres GROUP BY label, term),
grid AS (SELECT l.label, t.term, coalesce(c.a, 0)::BIGINT AS a, t.df, l.nl
         FROM lab l CROSS JOIN tdf t
         LEFT JOIN cell c ON c.label = l.label AND c.term = t.term),
sc AS (SELECT label, term, a, df,
              ln(((a + 0.5::DOUBLE) / ((nl - a) + 0.5::DOUBLE))
                 / (((df - a) + 0.5::DOUBLE) / (((SELECT n FROM tot) - nl - (df - a)) + 0.5::DOUBLE))) AS score
       FROM grid)"""


@register("lemma_keywords", _LEMMA_ODDS_SQL + """
SELECT label, term, round(score, 6) AS score, rank FROM (
  SELECT label, term, score,
         row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, term ASC) AS rank
  FROM sc WHERE score > 0) WHERE rank <= 100""")
def q_lemma_keywords(spark, sf):
    """The topic workflow's keyword path — drop null
    rows, lemmatise, drop blank results, word-tokenise, presence log odds per
    language, top 100 positive terms per language."""
    from labelprism.plans import topic_analysis
    docs = tables.spread(load(spark, sf, "documents", ["doc_id", "text", "lang"]), "doc_id")
    toks = topic_analysis.prepare_tokens(docs, "doc_id", "text", "lang")
    scores = assoc.term_log_odds(toks, "doc_id", "lang", "tokens")
    top = assoc.label_keywords(scores, "lang", 100)
    return top.select(F.col("lang").alias("label"), "term", rnd("score").alias("score"),
                      F.col("rank").cast("long").alias("rank"))


@register("display_topics", _TOPIC_BASE_SQL + """
SELECT display, term, rank FROM (
  SELECT 'Topic' || ts.topic_order::VARCHAR AS display, sc.term,
         row_number() OVER (PARTITION BY ts.topic_order ORDER BY sc.logprob DESC, sc.term) AS rank
  FROM sc JOIN ts USING (topic)) WHERE rank <= 30""")
def q_display_topics(spark, sf):
    """Topics named by size order with their 30 best words by logprob."""
    c, s = _counts(spark, sf)
    d = topics.display_topics(topics.topic_term_scores(c), s, 30)
    return d.select("display", "term", F.col("rank").cast("long").alias("rank"))
