"""The distil filter over a growing folder of teacher-record files.

The filter is row-wise (explode, length and word predicates, answer
extraction, correctness), so it runs unchanged on a Structured Streaming
source: new record files are filtered as they land and appended to a
Parquet sink. The checkpoint location makes the sink exactly-once and lets
the query resume after a failure. Dedupe, caps and the split stay batch
steps over the accumulated table (they need the whole set).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from thinkframe.operators.distill import (
    DEFAULT_MAX_TRACE_CHARS,
    DEFAULT_MIN_TRACE_TOKENS,
    explode_records,
    filter_traces,
    flag_traces,
)
from thinkframe.sources.io import TEACHER_RECORD


def start_filter_stream(
    spark: SparkSession,
    source_dir: str,
    sink_dir: str,
    checkpoint_dir: str,
    task: str,
    max_trace_chars: int = DEFAULT_MAX_TRACE_CHARS,
    min_trace_tokens: int = DEFAULT_MIN_TRACE_TOKENS,
    available_now: bool = False,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start the streaming filter: JSONL teacher records in, filtered traces out."""
    reader = spark.readStream.schema(TEACHER_RECORD)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    records = reader.json(source_dir)
    flat = explode_records(records).withColumn("task", F.lit(task))
    kept = filter_traces(flat, max_trace_chars, min_trace_tokens, keep_cols=["pos"])
    writer = (
        kept.writeStream.format("parquet")
        .option("path", sink_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def start_keep_rate_stream(
    spark: SparkSession,
    source_dir: str,
    table_dir: str,
    checkpoint_dir: str,
    task: str,
    max_trace_chars: int = DEFAULT_MAX_TRACE_CHARS,
    min_trace_tokens: int = DEFAULT_MIN_TRACE_TOKENS,
    available_now: bool = False,
) -> StreamingQuery:
    """A1 as a running aggregate: seen / kept / percent per task over the stream.

    A stateful streaming aggregation (one state row per task); every
    micro-batch rewrites the small result table at ``table_dir`` from the
    complete aggregate, and the checkpoint holds the state for recovery.
    """
    records = spark.readStream.schema(TEACHER_RECORD).json(source_dir)
    flat = explode_records(records.drop("meta")).withColumn("task", F.lit(task))
    flagged = flag_traces(flat, max_trace_chars, min_trace_tokens)
    agg = flagged.groupBy("task").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("kept")).alias("kept")
    )

    def publish(batch, _epoch_id):
        batch.withColumn("pct", F.col("kept") * 100.0 / F.greatest(F.col("seen"), F.lit(1))).write.mode(
            "overwrite"
        ).parquet(table_dir)

    writer = (
        agg.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint_dir)
        .foreachBatch(publish)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
