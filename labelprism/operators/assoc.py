"""Association statistics between a label and a category or a term.

Pairs are counted once, in long form, with partial counts in the map tasks.
Totals follow from those counts, and the zero cells of a complete grid are added
last: each row value looks up which column values it lacks.  Row domains may have
any size.  The column domain, if its values are not given, is gathered by one
task into one array and passes through the driver as a scalar: it has to fit
into one row (2 GB) and the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["label_distribution", "crosstab", "complete_cells", "complete_counts", "row_percent", "deviation",
           "log_odds", "term_log_odds", "label_keywords", "label_cluster_counts", "max_abs",
           "odds_score"]

HALF = 0.5  # Haldane–Anscombe correction added to all four cells


def odds_score(a: Column, b: Column, c: Column, d: Column) -> Column:
    """ln of the corrected odds ratio ((a+½)/(b+½)) / ((c+½)/(d+½)), in double."""
    h = F.lit(HALF)
    return F.ln(((a + h) / (b + h)) / ((c + h) / (d + h)))


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, pct)`` over non-null labels; pct of the labelled rows."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.col("n") * F.lit(100.0) / total)


def complete_cells(cells: DataFrame, row: str, col: str, col_values: list | None = None,
                   row_domain: DataFrame | None = None, n: str = "n",
                   col_domain: DataFrame | None = None) -> DataFrame:
    """Counted ``(row, col, n)`` cells and a zero for every other cell of the grid.

    Columns are the given values, else those of ``col_domain`` (one column named
    ``col``), else those of the cells.  A row looks up
    which columns it has and gets a zero for each of the others; the counted
    cells themselves pass through as they are.  What ``cells`` is counted from
    is read once.
    """
    kind = cells.schema[col].dataType
    if col_values is not None:
        domain = F.array(*[F.lit(v) for v in col_values]).cast(f"array<{kind.simpleString()}>")
        cells = cells.where(F.array_contains(domain, F.col(col))) if col_values else cells.limit(0)
    else:
        domain = (cells if col_domain is None else col_domain).agg(F.collect_set(col)).scalar()
    # cells are counted once: they pass through the rows they belong to
    pair = F.struct(F.col(col).alias("c"), F.col(n).alias("n"))
    have = cells.groupBy(row).agg(F.collect_list(pair).alias("_have"))
    if row_domain is not None:
        have = have.join(row_domain.select(row).where(F.col(row).isNotNull()).distinct(), row, "full")
    cell_type = f"array<struct<c:{kind.simpleString()},n:{cells.schema[n].dataType.simpleString()}>>"
    own = F.coalesce("_have", F.array().cast(cell_type))
    rows = have.select(row, own.alias("_own"), F.array_except(domain, own["c"]).alias("_rest"))
    zero = F.arrays_zip("_rest", F.array_repeat(F.lit(0), F.size("_rest"))).cast(cell_type)
    return rows.select(row, F.explode(F.concat("_own", zero)).alias("_c")).select(row, F.col("_c.c").alias(col), F.col("_c.n").alias(n))


def complete_counts(df: DataFrame, row: str, col: str, col_values: list | None = None,
                    row_domain: DataFrame | None = None, n: str = "n",
                    weight: str | None = None, col_domain: DataFrame | None = None) -> DataFrame:
    """Long ``(row, col, n)`` counts over the complete grid.

    Pairs are counted once, in long form; the zero cells come last.  Rows are
    every ``row`` value of the counted pairs, plus the values of ``row_domain``
    (one column named ``row``) if given — the re-index-to-``range(k)`` of a
    cross-tab.  Null ``row``/``col`` values are left out, like a pandas
    cross-tab: a value that only stands beside a null is no row or column.
    With ``weight`` the cells sum that column instead of counting rows.
    """
    base = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    value = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return complete_cells(base.groupBy(row, col).agg(value.alias(n)), row, col, col_values, row_domain, n, col_domain)


def crosstab(df: DataFrame, a: str, b: str, domain: DataFrame | None = None,
             b_values: list | None = None) -> DataFrame:
    """Counts of (a, b) over the full grid, zero filled; ``domain``
    optionally re-indexes ``a`` to a given id set (e.g. ``spark.range(k)``)."""
    return complete_counts(df, a, b, b_values, domain)


def row_percent(ct: DataFrame, a: str, n: str = "n", out: str = "row_pct") -> DataFrame:
    """Share of each cell in its ``a`` row, in percent; an empty row gives 0."""
    row_total = F.sum(n).over(Window.partitionBy(a))
    return ct.withColumn(out, F.coalesce(F.try_divide(F.col(n) * F.lit(100.0), row_total), F.lit(0.0)))


def deviation(df: DataFrame, a: str, b: str, domain: DataFrame | None = None) -> DataFrame:
    """``(a, b, n, row_pct, global_pct, deviation)`` with deviation =
    row % − global % of ``b`` (percentage points).  Global shares count rows
    with a non-null ``b`` (whatever ``a`` is)."""
    glob = label_distribution(df, b).select(b, F.col("pct").alias("global_pct"))
    ct = row_percent(crosstab(df, a, b, domain), a)
    return (ct.join(glob, b, "left")
              .withColumn("global_pct", F.coalesce("global_pct", F.lit(0.0)))
              .withColumn("deviation", F.col("row_pct") - F.col("global_pct")))


def log_odds(df: DataFrame, label: str, cat: str, cat_values: list | None = None) -> DataFrame:
    """Log odds of every label × category cell with +½ in all four cells.

    ``(label, cat, n, log_odds)``.  Row and column totals are group-bys joined
    back (AQE broadcasts them when their measured size is small); the grand
    total is the sum of the label totals, a scalar subquery.
    Categories never observed but listed in ``cat_values`` get a zero column
    instead of a missing one.
    """
    ct = complete_counts(df, label, cat, cat_values)
    row_t = ct.groupBy(label).agg(F.sum("n").alias("_rt"))
    col_t = ct.groupBy(cat).agg(F.sum("n").alias("_ct"))
    grand = row_t.agg(F.sum("_rt")).scalar()
    g = ct.join(row_t, label).join(col_t, cat)
    a = F.col("n")
    b = F.col("_rt") - a
    c = F.col("_ct") - a
    d = grand - (a + b + c)
    return g.select(label, cat, "n", odds_score(a, b, c, d).alias("log_odds"))


def term_log_odds(docs: DataFrame, key: str, label: str, tokens: str, term: str = "term") -> DataFrame:
    """Log odds of label × term *presence* (documents, not occurrences).

    For label l and term t: a = labelled-l documents holding t, b = the other
    l documents, c = non-l documents holding t, d = the rest; every cell +½.
    Every (label, term) pair of the vocabulary is scored, zero cells included.

    Plan: one pass explodes each row's distinct terms, and a null term for the
    row itself, and counts (term, label) pairs, with partial counts map-side, so
    a term present everywhere costs a row per label and map task; label sizes,
    term totals and zero cells follow from those counts.  Documents without any
    token still count in the sizes.
    """
    labelled = docs.where(F.col(label).isNotNull())
    held = F.array_compact(F.array_distinct(F.coalesce(tokens, F.array().cast(labelled.schema[tokens].dataType))))
    none = F.array(F.lit(None).cast(labelled.schema[tokens].dataType.elementType))
    rows = labelled.select(label, F.explode_outer(F.concat(none, held)).alias(term))
    # which cells are sizes is an aggregate: a filter on it stays above the exchange, which all parts share
    counted = rows.groupBy(term, label).agg(F.count(F.lit(1)).alias("a"), F.max(F.col(term).isNull()).alias("_size"))
    sizes = counted.where("_size").select(label, F.col("a").alias("_nl"))
    n_all = sizes.agg(F.sum("_nl")).scalar()
    cells = counted.where("not _size").select(term, label, "a")
    # every label of the corpus is a column, also one whose documents hold no token
    # (the filter keeps the count in it: without, it would be another exchange than the others')
    labels = sizes.where("_nl > 0").agg(F.collect_set(label)).scalar()
    terms = cells.groupBy(term).agg(F.collect_list(F.struct(label, "a")).alias("_cells"), F.sum("a").alias("df"))
    seen = terms.select(term, "df", F.explode("_cells").alias("_s")).select(term, "df", "_s.*")
    unseen = terms.select(term, "df", F.explode(F.array_except(labels, F.col(f"_cells.{label}"))).alias(label), F.lit(0).cast("long").alias("a"))
    grid = seen.unionByName(unseen).join(sizes, label)
    a, nl, dft = F.col("a"), F.col("_nl"), F.col("df")
    b = nl - a
    c = dft - a
    d = (n_all - nl) - c
    return grid.select(label, term, "a", "df", odds_score(a, b, c, d).alias("score"))


def label_keywords(scores: DataFrame, label: str, n: int = 100, term: str = "term",
                   score: str = "score") -> DataFrame:
    """The ``n`` best positive-score terms per label, ties alphabetical.

    ``row_number() <= n`` is planned as a partial WindowGroupLimit before the
    shuffle, so each map task sends at most n rows per label.  Scores are
    compared at 1e-9 so that values equal in exact arithmetic tie the same way
    on every engine.
    """
    w = Window.partitionBy(label).orderBy(F.round(score, 9).desc(), F.col(term).asc())
    return (scores.where(F.col(score) > 0)
                  .withColumn("rank", F.row_number().over(w))
                  .where(F.col("rank") <= n))


def label_cluster_counts(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """Counts by (label, cluster), by label and by cluster in one pass
    (GROUPING SETS).  ``level`` says which set a row belongs to."""
    return (df.groupingSets([[label, cluster], [label], [cluster]], label, cluster)
              .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid"))
              .withColumn("level", F.when(F.col("_gid") == 0, "label_cluster")
                                    .when(F.col("_gid") == 1, "label").otherwise("cluster"))
              .drop("_gid"))


def max_abs(df: DataFrame, col: str, out: str = "max_abs") -> DataFrame:
    """A10: largest absolute value (the symmetric colour scale of a heat map)."""
    return df.agg(F.max(F.abs(col)).alias(out))

