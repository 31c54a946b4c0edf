"""Score a stream of text rows: word tokens → keyword-rule score, written
with exactly-once file-sink semantics (checkpointed progress)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelprism.functions.columns import word_tokens
from labelprism.operators.vectors import rule_score

__all__ = ["scored_stream", "start_scoring"]


def scored_stream(stream: DataFrame, key: str, text: str, rules: list[tuple[list[str], float]]) -> DataFrame:
    """Stateless transform usable on a streaming or a batch DataFrame."""
    toks = stream.select(key, word_tokens(text).alias("_tokens"))
    return rule_score(toks, key, "_tokens", rules)


def start_scoring(spark: SparkSession, source_dir: str, schema: str, key: str, text: str,
                  rules: list[tuple[list[str], float]], sink_dir: str, checkpoint_dir: str,
                  max_files_per_trigger: int = 8) -> StreamingQuery:
    """Read Parquet files as they land in ``source_dir``, score them, append to
    ``sink_dir``.  ``checkpoint_dir`` must be on shared storage so a restarted
    driver resumes where it stopped."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
                .parquet(source_dir))
    out = scored_stream(src, key, text, rules).withColumn("scored_at", F.current_timestamp())
    return (out.writeStream.format("parquet").option("path", sink_dir)
               .option("checkpointLocation", checkpoint_dir).outputMode("append").start())
