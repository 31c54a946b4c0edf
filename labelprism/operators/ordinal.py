"""Global and per-group ordinals without a single-partition window.

``row_number() OVER (ORDER BY x)`` with no PARTITION BY moves every row to one
task.  These helpers number rows with bounded tasks instead:

* :func:`sorted_ordinal` — dense 0-based position in a total order: range
  partition, sort within partitions, count per partition, add the running
  offset of earlier partitions (a table with one row per partition).
* :func:`uniform_rank_within` — position inside each group by a uniform key
  (an md5-derived value): the group is cut into equal slices of the unit
  interval, as many as its size asks for, so a hot group is spread over many
  tasks, and slice offsets come from a (groups × slices) count table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelprism.session import ensure_checkpoint_dir

__all__ = ["sorted_ordinal", "join_null_safe", "uniform_rank_within"]


def sorted_ordinal(df: DataFrame, order_cols: list[str], out: str = "ordinal",
                   num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row in ``order_cols`` order.

    The range-partitioned, sorted frame is checkpointed to the shared
    checkpoint folder before it is numbered: range bounds come from a sample,
    and a recomputation after an executor loss must not see different bounds
    than the counting pass did.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order_cols)
                .sortWithinPartitions(*order_cols)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id()))
    frozen = ranged.checkpoint(eager=True)
    local = frozen.withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    counts = frozen.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a single-task window is fine here
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    return (local.join(F.broadcast(offsets), "_pid")
                 .withColumn(out, (F.col("_off") + F.col("_local")).cast("long"))
                 .drop("_pid", "_mid", "_local", "_off"))


def join_null_safe(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """Inner join on equal names in which a null equals a null; the columns of
    ``left`` and those of ``right`` that are no key."""
    named = right.withColumnsRenamed({c: f"_right_{c}" for c in cols})
    equal = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in cols])
    return left.join(named, equal).drop(*(f"_right_{c}" for c in cols))


def uniform_rank_within(df: DataFrame, group_cols: list[str], u_col: str, tie_col: str,
                        out: str = "rank0", slice_rows: int = 50_000) -> DataFrame:
    """Add ``out`` = 0-based rank of each row inside its group, ordered by
    ``(u_col, tie_col)``, where ``u_col`` is uniform on [0, 1).

    A group is cut into as many equal slices of the unit interval as its size
    needs for about ``slice_rows`` rows in each; a null group is a group.
    """
    sizes = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_size"))
    slices = F.greatest(F.ceil(F.col("_size") / slice_rows), F.lit(1))
    sliced = (join_null_safe(df, sizes, group_cols)
                .withColumn("_b", F.least(F.floor(F.col(u_col) * slices), slices - 1).cast("long")).drop("_size"))
    w_local = Window.partitionBy(*group_cols, "_b").orderBy(u_col, tie_col)
    ranked = sliced.withColumn("_local", F.row_number().over(w_local) - 1)
    counts = sliced.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group_cols, "_b", F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    return (join_null_safe(ranked, offsets, [*group_cols, "_b"])
                  .select(*df.columns, (F.col("_off") + F.col("_local")).cast("long").alias(out)))
