"""Parquet scans and sinks, split unions, renames and table guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

__all__ = [
    "table_path", "read_table", "spread", "write_report", "write_by_label", "union_splits", "rename", "require_columns",
    "require_rows", "debug_head", "profile", "write_table", "save_model", "load_model",
]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
               columns: list[str] | None = None) -> DataFrame:
    """Read a Parquet table.

    With ``schema`` the scan skips inference and fails fast on a missing or
    mistyped column; with ``columns`` only those columns reach the scan's
    ``ReadSchema`` (Catalyst would prune them anyway, this just says so).
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(path)
    if columns is not None:
        require_columns(df, columns)
        df = df.select(*columns)
    return df


def spread(df: DataFrame, key: str, min_factor: int = 2) -> DataFrame:
    """Hash-partition ``df`` by ``key`` when the scan gives too few tasks.

    A table stored as a few large row groups scans as a few tasks, and
    tokenising text is CPU-heavy, so every later narrow step would run on those
    few cores.  When the scan already has ≥ ``min_factor`` × the cluster's
    parallelism (the normal case for a large table) nothing changes.  Hashing
    by the document key keeps one document in one task, so later per-document
    aggregates (bags of words, normalisation) need no further shuffle.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism * min_factor
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(max(want, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def union_splits(dfs: list[DataFrame]) -> DataFrame:
    """Union all splits by column name; duplicates kept, missing columns null."""
    if not dfs:
        raise ValueError("union_splits needs at least one DataFrame")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename columns; names absent from ``df`` are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fail before any job runs when a required column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required column(s) {missing}; have {df.columns}")
    return df


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """Fail when nothing is left (one short job that stops at the first row)."""
    if df.isEmpty():
        raise ValueError(f"no rows left in {what} after cleaning")
    return df


def debug_head(df: DataFrame, n: int, key: str) -> DataFrame:
    """First ``n`` rows by ``key`` (a top-k, not a full sort); ``n == 0`` keeps all."""
    if n <= 0:
        return df
    return df.orderBy(key).limit(n)


def profile(df: DataFrame, label: str | None = None, vector: str | None = None) -> DataFrame:
    """One-row profile: rows, columns, distinct labels, vector width range.

    A single aggregate pass; ``count_distinct`` on the label is exact (labels
    are a small domain; the partial aggregate keeps the shuffle small).
    """
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns")]
    if label is not None:
        aggs.append(F.count_distinct(F.col(label)).alias("n_classes"))
    if vector is not None:
        if not isinstance(df.schema[vector].dataType, ArrayType):
            raise TypeError(f"{vector} is not an array column")
        aggs.append(F.min(F.size(vector)).cast("long").alias("min_width"))
        aggs.append(F.max(F.size(vector)).cast("long").alias("max_width"))
    return df.agg(*aggs)


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write Parquet (no index column exists in a DataFrame to begin with)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_report(lines: DataFrame, path: str, order: list[str], line: str = "line") -> None:
    """S08 sink: a small report (e.g. k topics × 30 ranked words) as one text
    file in ``order``.  A range-sorted frame coalesced to one partition keeps
    its order; only use this for report-sized frames."""
    lines.orderBy(*order).select(line).coalesce(1).write.mode("overwrite").text(path)


def write_by_label(df: DataFrame, path: str, label: str) -> None:
    """One output folder per label (the per-label keyword tables behind a word
    cloud), named by the label's file-safe form (space / \\ : → _)."""
    from labelprism.functions.columns import safe_key
    df.withColumn("file_label", safe_key(label)).write.mode("overwrite").partitionBy("file_label").parquet(path)


def save_model(model, path: str) -> str:
    """Persist a fitted ``pyspark.ml`` model (or pipeline) with MLWriter."""
    model.write().overwrite().save(path)
    return path


def load_model(model_cls, path: str):
    """Reload a model saved by :func:`save_model`; ``model_cls`` is its class."""
    return model_cls.load(path)
