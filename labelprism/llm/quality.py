"""Quality rules and robust multivariate outliers, in DataFrame operations only.

Every document gets a few counts.  Documents that pass the plain rules become
vectors of transformed statistics; per language and source, the centre and
scatter of the majority are estimated by minimum covariance determinant, and
documents far from that majority are rejected, by the distance its covariance
sets: d2 = (x - centre)' covariance^-1 (x - centre).

The estimate starts from the coordinates' medians and takes concentration steps:
mean and covariance of the ``SUBSET`` share of documents that lie nearest, again
and again, which never raises the determinant.  Nearest is decided by a
histogram of the log distance, so that no group is sorted or gathered.  A last
step reweights: mean and covariance of all documents within the 97.5 % quantile.
The covariance gets a fixed variance added on its diagonal (``FLOORS``), as a
majority that does not vary at all in a coordinate is the rule here; with it a
coordinate counts from a real difference on, not from the smallest one.

Groups of fewer than ``LEAST`` documents join their language's remainder, and a
remainder as small joins one group of all.  Only group tables pass from step to
step, and their rows are counts, means and triangles of covariances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelprism.llm.common import WHITE, cut, keys

__all__ = ["document_counts", "mcd_distances", "quality_rules"]

SYMBOLS = r"[^#*$%&|<>]+"
#: Variation per coordinate that is never held against a document: log words, log word length,
#: root of symbols per word, share of repeated lines, share of words in repeated three-word windows.
#: In a group that does not vary, each rejects alone from sqrt(CUTOFF) = 4.53 times its value on: 3.1 times the
#: length, 1.25 times the word length, 0.051 symbols per word, 45 % repeated lines, 41 % repeated words (50 % fail before).
FLOORS = (0.25, 0.05, 0.05, 0.1, 0.09)
#: 99.9 % quantile of chi-square with five degrees of freedom; the 97.5 % quantile; 75 % quantile for consistency.
CUTOFF, NEAR, MIDDLE = 20.52, 12.83, 6.63
SUBSET, STEPS, LEAST = 0.75, 5, 100
#: Bins of the histogram to a natural log unit of the squared distance.
BINS = 64
P = len(FLOORS)


def document_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, id, tag, lang, source`` and the counts of every row; null and empty texts have no words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(k) for k, c in keys().items()), F.col("lang").cast("string").alias("lang"),
                      F.col("source").cast("string").alias("source"), text.alias("t"))
    got = got.select("doc_id", "id", "tag", "lang", "source", F.array_remove(F.split("t", WHITE), "").alias("words"),
                     F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
                     F.length(F.regexp_replace("t", SYMBOLS, "")).cast("long").alias("n_symbols"))
    rest = F.size("words")
    three = F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(rest - 1, F.lit(0))).alias("b"), F.slice("words", 3, F.greatest(rest - 2, F.lit(0))).alias("c"))
    got = got.select("doc_id", "id", "tag", "lang", "source", "n_symbols", F.size("words").alias("n"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
                     F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                     F.transform(three, lambda x: F.xxhash64(x.a, x.b, x.c)).alias("hashes"))
    # the last two have no full window
    got = got.withColumn("hashes", F.slice("hashes", 1, F.greatest(F.col("n") - 2, F.lit(0))))
    got = got.withColumn("repeated", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), repeated_words(F.col("hashes"))).otherwise(0))
    return got.select("doc_id", "id", "tag", "lang", "source", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                      F.col("repeated").cast("long").alias("n_repeat_words"), "n_lines")


def repeated_words(hashes: Column) -> Column:
    """Words inside the windows (of three, one starting at each place) whose hash is there twice or more."""
    sorted_ = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    n = F.size(hashes)
    none = F.array(F.lit(None).cast("struct<h:bigint,k:int>"))
    sides = F.arrays_zip(sorted_.alias("x"), F.concat(none, F.slice(sorted_, 1, n - 1)).alias("before"), F.slice(sorted_, 2, n - 1).alias("after"))
    twice = F.filter(sides, lambda s: F.coalesce(s.x.h == s.before.h, F.lit(False)) | F.coalesce(s.x.h == s.after.h, F.lit(False)))
    starts = F.sort_array(F.transform(twice, lambda s: s.x.k))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
    return F.aggregate(starts, start, lambda a, k: F.struct(k.alias("last"), (a.total + F.least(k - a.last, F.lit(3))).alias("total")), lambda a: a.total)


def triangle() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i + 1)]


def with_distance(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with ``d2``, the squared distance to its group's centre in its covariance."""
    out = rows.join(groups, "grp")
    for i in range(P):  # forward substitution with the Cholesky factor
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0"))
    return out.select(*rows.columns, d2.alias("d2"))


def factored(groups: DataFrame) -> DataFrame:
    """``grp, m*, l**`` from ``grp, m*, c**``: the Cholesky factor of the covariance with the floors added."""
    out = groups
    for i, j in triangle():
        value = F.col(f"c{i}{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
        for k in range(j):
            value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(value) if i == j else value / F.col(f"l{j}{j}"))
    return out.select("grp", *(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i, j in triangle()))


def moments(rows: DataFrame, factor: float) -> DataFrame:
    """Mean and covariance, times ``factor``, of each group."""
    n = F.count(F.lit(1))
    mean = [F.avg(f"x{i}").alias(f"m{i}") for i in range(P)]
    product = [F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in triangle()]
    got = rows.groupBy("grp").agg(n.alias("n"), *mean, *product)
    cov = [((F.col(f"p{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * factor).alias(f"c{i}{j}") for i, j in triangle()]
    positive = [F.greatest(c, F.lit(0.0)).alias(f"c{i}{j}") if i == j else c for c, (i, j) in zip(cov, triangle())]
    return got.select("grp", *(f"m{i}" for i in range(P)), *positive)


def mcd_distances(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``lang, source, x0 ..``) and ``d2``, its distance from its group's robust centre."""
    own = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    rest = Window.partitionBy("lang")
    own = own.withColumn("left", F.sum(F.when(F.col("n") < LEAST, F.col("n")).otherwise(0)).over(rest))
    # a group's name: its language and source, its language's remainder, or all remainders
    name = (F.when(F.col("n") >= LEAST, F.struct(F.lit(0).alias("k"), F.col("lang").alias("lang"), F.col("source").alias("source")))
            .when(F.col("left") >= LEAST, F.struct(F.lit(1).alias("k"), F.col("lang").alias("lang"), F.lit(None).cast("string").alias("source")))
            .otherwise(F.struct(F.lit(2).alias("k"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))))
    own = own.select("lang", "source", F.to_json(name, {"ignoreNullFields": "false"}).alias("grp"))
    here, there = rows.alias("r"), own.alias("o")
    named = here.join(there, F.col("r.lang").eqNullSafe(F.col("o.lang")) & F.col("r.source").eqNullSafe(F.col("o.source")))
    named = cut(named.select("r.*", "o.grp"))

    start = named.groupBy("grp").agg(*(F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"m{i}") for i in range(P)))
    zero = [F.lit(0.0).alias(f"c{i}{j}") for i, j in triangle()]
    groups = factored(start.select("*", *zero))
    # what the nearest share of a normal distribution lacks in variance
    factor = SUBSET / CONSISTENCY
    for _ in range(STEPS):
        near = with_distance(named, groups).withColumn("bin", F.floor(F.log(F.col("d2") + 1e-9) * BINS))
        bins = near.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("grp").orderBy("bin")
        bins = bins.withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("grp")))
        last = bins.where(F.col("before") < F.col("all") * SUBSET).groupBy("grp").agg(F.max("bin").alias("last"))
        groups = cut(factored(moments(near.join(last, "grp").where("bin <= last"), factor)))
    groups = cut(factored(moments(with_distance(named, groups).where(F.col("d2") <= NEAR), 1.0)))
    return with_distance(named, groups)


#: Share of the variance that the nearest 75 % of a five-dimensional normal distribution keep, times 0.75:
#: the chi-square distribution function with seven degrees of freedom at MIDDLE.
CONSISTENCY = 0.532


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Counts, ``base_failed``, ``d2`` and ``kept`` of every row.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated
    three-word windows.  ``kept``: not so, and within ``cutoff`` of the group's
    majority.  Null ``lang`` and ``source`` are values of their own; null and
    empty texts fail the plain rules; repeated rows count and are judged each;
    other columns are ignored; an empty table gives an empty result.
    """
    counts = document_counts(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = cut(counts.withColumn("base_failed", failed))
    n = F.col("n_words").cast("double")
    vector = [F.log(n), F.log(F.col("word_chars") / n), F.sqrt(F.col("n_symbols") / n), F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), F.col("n_repeat_words") / n]
    passed = mcd_distances(counts.where("not base_failed").select("*", *(v.alias(f"x{i}") for i, v in enumerate(vector))))
    names = counts.columns
    judged = passed.select(*names, "d2", (F.col("d2") <= cutoff).alias("kept"))
    return counts.where("base_failed").select(*names, F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept")).unionByName(judged)
