"""Structured Streaming jobs on requests and on the event log. All can run with ``availableNow``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyrisk.functions.json_body import with_body_columns
from tallyrisk.operators.clean import validate
from tallyrisk.operators.monitor import is_error
from tallyrisk.operators.score import log_records, score_requests
from tallyrisk.plans.monitoring_run import monitoring_run
from tallyrisk.sources.batches import write_run
from tallyrisk.sources.event_log import append_run

WATERMARK = "10 minutes"
WINDOW = "1 hour"


def file_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind)
    if files:
        reader = reader.option("pathGlobFilter", files)
    return reader.load(path)


def scored_log(requests: DataFrame) -> DataFrame:
    """Requests (fields, ``timestamp``, ``latency_ms``, ``inference_ms``, ``body``) to log records:
    validate, score, decide. No state, so the same function serves batch and stream."""
    return log_records(score_requests(validate(with_body_columns(requests)).drop("failed_fields")))


def totals(logs: DataFrame) -> DataFrame:
    """Running totals; quantiles are approximate, because exact ones need unbounded state."""
    return logs.agg(
        F.count(F.lit(1)).alias("request_count"),
        F.count_if(is_error()).alias("error_count"),
        F.approx_percentile("latency_ms", F.lit(0.5), F.lit(10000)).alias("latency_p50"),
        F.approx_percentile("latency_ms", F.lit(0.95), F.lit(10000)).alias("latency_p95"),
    )


def health_windows(logs: DataFrame, window: str = WINDOW, watermark: str = WATERMARK) -> DataFrame:
    """Requests, errors and latency per time window; rows later than the watermark are dropped."""
    timed = logs.withWatermark("timestamp", watermark)
    grouped = timed.groupBy(F.window("timestamp", window).alias("w")).agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.count_if(is_error()).alias("n_errors"),
        F.avg("latency_ms").alias("latency_mean"),
        F.max("latency_ms").alias("latency_max"),
        F.approx_percentile("latency_ms", F.lit(0.95), F.lit(10000)).alias("latency_p95"),
    )
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_requests", "n_errors", "latency_mean", "latency_max", "latency_p95")


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the stream to Parquet files, exactly once."""
    return (
        df.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def replace_at(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest complete result as Parquet; a repeated batch writes the same folder again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        df.writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def newest_result(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(path)
    newest = stored.agg(F.max("batch_id")).scalar()
    return stored.where(F.col("batch_id") == newest).drop("batch_id")


def log_and_watch(
    logs: DataFrame,
    log_path: str,
    checkpoint: str,
    on_run: Callable[[DataFrame], None] | None = None,
    reference: DataFrame | None = None,
    runs_path: str | None = None,
) -> StreamingQuery:
    """Per micro-batch: store the new log rows, then run monitoring over the whole log. The rows of
    a batch go to their own folder, so a repeated batch does not store them twice; with ``runs_path`` its run goes there under
    the number of the batch, and a repeated batch leaves one run. Otherwise the run is handed to ``on_run`` or appended to the
    history table."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")
        spark = batch.sparkSession
        run = monitoring_run(spark.read.schema(batch.schema).parquet(log_path), reference)
        if runs_path:
            write_run(run, runs_path, batch_id)
        else:
            (on_run or append_run)(run)

    return (
        logs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
