"""Small categorical domains (labels, topics, clusters) brought to the driver.

Labels, topics and clusters are small by nature (13 labels, 10 topics), so
their *distinct values and counts* may be collected and used as literals —
never their rows.  Every collect here is bounded by ``limit(max_size + 1)``,
so a mistaken high-cardinality column fails fast instead of flooding the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DOMAIN = 10_000
# Conditional aggregates per pivot chunk: wide enough for any label set we
# expect, narrow enough to keep the aggregation buffer small.
PIVOT_CHUNK = 512

__all__ = ["MAX_DOMAIN", "PIVOT_CHUNK", "small_domain", "small_counts", "chunks"]


def _check(n: int, col: str, max_size: int) -> None:
    if n > max_size:
        raise ValueError(f"column {col!r} has more than {max_size} distinct values; "
                         "it is not a categorical domain")


def small_domain(df: DataFrame, col: str, max_size: int = MAX_DOMAIN) -> list:
    """Sorted distinct non-null values of ``col`` (bounded collect)."""
    rows = (df.select(col).where(F.col(col).isNotNull()).distinct()
              .limit(max_size + 1).collect())
    _check(len(rows), col, max_size)
    return sorted(r[0] for r in rows)


def small_counts(df: DataFrame, col: str, max_size: int = MAX_DOMAIN) -> list[tuple]:
    """Sorted ``(value, count)`` pairs of a categorical column (nulls excluded)."""
    rows = (df.where(F.col(col).isNotNull()).groupBy(col).count()
              .limit(max_size + 1).collect())
    _check(len(rows), col, max_size)
    return sorted((r[0], int(r[1])) for r in rows)


def chunks(values: list, size: int = PIVOT_CHUNK):
    for i in range(0, len(values), size):
        yield values[i:i + size]
