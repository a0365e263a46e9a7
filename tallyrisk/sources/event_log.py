"""The scoring event log and the monitoring-run history as Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyrisk.functions.json_body import parsed, starts_with
from tallyrisk.session import settle
from tallyrisk.sources.schemas import API_CALL_COLUMNS, API_CALLS, MODEL_RUNS, MONITORING_RUNS


# Fixed value: times in JSON keep their microseconds.
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def create_tables(spark: SparkSession, calls: str = "api_calls", runs: str = "monitoring_runs") -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {calls} ({API_CALLS}) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {runs} ({MONITORING_RUNS}) USING parquet")


def with_defaults(events: DataFrame) -> DataFrame:
    """Missing time becomes now, missing keys and features become empty, the decision is text."""
    no_keys = F.array().cast("array<string>")
    no_features = F.create_map().cast("map<string,double>")
    return events.withColumns(
        {
            "timestamp": F.coalesce(F.col("timestamp").cast("timestamp"), F.current_timestamp()),
            "payload_keys": F.coalesce("payload_keys", no_keys),
            "input_features": F.coalesce("input_features", no_features),
            "decision": F.col("decision").cast("string"),
        }
    )


def append_events(events: DataFrame, table: str = "api_calls") -> None:
    """Append to the log table. The id is the time in microseconds followed by a hash, so it grows
    with time and needs no counter on the driver."""
    ready = with_defaults(events)
    mixed = F.pmod(F.xxhash64("timestamp", "payload_hash", "endpoint", "latency_ms"), F.lit(1000))
    numbered = ready.withColumn("id", F.unix_micros("timestamp") * 1000 + mixed)
    numbered.select("id", *API_CALL_COLUMNS).write.mode("append").insertInto(table)


def append_json(events: DataFrame, path: str) -> None:
    """Append as JSON Lines; an event without a time gets the current one."""
    stamped = events.withColumn("timestamp", F.coalesce(F.col("timestamp").cast("timestamp"), F.current_timestamp()))
    stamped.write.mode("append").options(**JSON_OPTIONS).json(path)


def read_json_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(API_CALLS).json(path)


def split_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Mark raw log lines: ``blank``, ``malformed``, ``other`` (valid JSON, no object) or ``event``."""
    text = F.trim(F.col(column))
    kind = (
        F.when(F.length(text) == 0, F.lit("blank"))
        .when(parsed(text).isNull(), F.lit("malformed"))
        .when(starts_with(text) == "{", F.lit("event"))
        .otherwise(F.lit("other"))
    )
    return lines.withColumn("kind", kind)


def clean_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Log lines that are JSON objects, parsed to the log schema."""
    events = split_lines(lines, column).where(F.col("kind") == "event")
    return events.select(F.from_json(F.col(column), API_CALLS).alias("e")).select("e.*")


def backfill(spark: SparkSession, path: str, table: str = "api_calls", skip_known: bool = False) -> int:
    """Load a JSON Lines file into the log table and return the number of rows. One malformed line
    stops the load before anything is written. ``skip_known`` leaves out events whose time and
    payload hash are stored already. The lines are read and parsed once: what is checked, counted and stored are the same rows."""
    lines = split_lines(spark.read.text(path)).withColumn("event", F.from_json("value", API_CALLS))
    read = settle(lines.where("kind IN ('event', 'malformed')").select("kind", "event"))
    if not read.where("kind = 'malformed'").isEmpty():
        raise ValueError(f"malformed log line in {path}")
    events = read.select("event.*")
    if skip_known:
        stored = spark.table(table).select(F.col("timestamp").alias("__time"), F.col("payload_hash").alias("__hash")).distinct()
        # Events without a body have no hash; they are known by their time alone.
        same = F.col("timestamp").eqNullSafe(F.col("__time")) & F.col("payload_hash").eqNullSafe(F.col("__hash"))
        events = events.join(stored, same, "left_anti")
        events = settle(events)
    count = events.count()
    append_events(events, table)
    return count


def recent_events(logs: DataFrame, n: int = 5000) -> DataFrame:
    """The newest n events without their id (top-n, no global sort)."""
    order: list[Column] = [F.col("timestamp").desc_nulls_last(), F.col("id").desc_nulls_last()]
    return logs.orderBy(*order).limit(n).select(*API_CALL_COLUMNS)


def append_run(summary: DataFrame, table: str = "monitoring_runs") -> None:
    """Append one run; ``operational`` and ``drift`` are structs and stored as JSON text."""
    now = F.current_timestamp()
    documents = summary.select(
        F.unix_micros(now).alias("id"),
        now.alias("run_at"),
        F.coalesce(F.to_json("operational"), F.lit("{}")).alias("operational"),
        F.coalesce(F.to_json("drift"), F.lit("{}")).alias("drift"),
    )
    documents.write.mode("append").insertInto(table)


def append_model_run(spark: SparkSession, name: str, parameters: dict, metrics: dict, table: str = "model_runs") -> None:
    """Record parameters and metrics of a training run in a history table."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({MODEL_RUNS}) USING parquet")
    row = [(name, {k: str(v) for k, v in parameters.items()}, {k: float(v) for k, v in metrics.items()})]
    df = spark.createDataFrame(row, "run_name STRING, parameters MAP<STRING, STRING>, metrics MAP<STRING, DOUBLE>")
    df.select(F.current_timestamp().alias("run_at"), "run_name", "parameters", "metrics").write.mode("append").insertInto(table)


def clear_table(spark: SparkSession, table: str) -> int:
    """Count the rows, then empty the table."""
    count = spark.table(table).count()
    spark.sql(f"TRUNCATE TABLE {table}")
    return count
