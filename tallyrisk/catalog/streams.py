"""Streaming queries: the supplied files are the stream, one run over all that is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrisk.catalog.base import query, table
from tallyrisk.catalog.scoring import LOG_DOUBLES, LOG_SELECT, LOGGED, flat_log, request_rows
from tallyrisk.catalog.standins import STANDINS, cte
from tallyrisk.session import scratch_path
from tallyrisk.streaming import jobs as J


def _stream(spark, sf, name):
    return J.file_stream(spark, sf, table(spark, sf, name).schema, files=f"{name}.parquet")


def _log_stream(spark, sf):
    columns = STANDINS["logs"][1]
    events = _stream(spark, sf, "events").selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items() if c != "body"])
    return events.withColumn("timestamp", F.col("ts").cast("timestamp"))


@query("stream_score", f"{cte('requests')}, {LOGGED} {LOG_SELECT}", LOG_DOUBLES)
def stream_score(spark, sf):
    requests = _stream(spark, sf, "lineitem").selectExpr(*[f"{e} AS `{c}`" for c, e in STANDINS["requests"][1].items()])
    out = scratch_path(spark, "scored")
    scored = J.scored_log(request_rows(requests))
    J.append_to(scored, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return flat_log(spark.read.schema(scored.schema).parquet(f"{out}/data"))


@query("stream_totals", f"{cte('logs')} SELECT count(*) AS request_count, count(*) FILTER (WHERE status_code >= 400) AS error_count FROM logs")
def stream_totals(spark, sf):
    out = scratch_path(spark, "totals")
    J.replace_at(J.totals(_log_stream(spark, sf)), f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return J.newest_result(spark, f"{out}/data").select("request_count", "error_count")


@query(
    "stream_ops_windows",
    f"""{cte('logs')}, w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n_requests,
    count(*) FILTER (WHERE status_code >= 400) AS n_errors, avg(latency_ms) AS latency_mean, max(latency_ms) AS latency_max FROM logs GROUP BY 1, 2)
    SELECT * FROM w WHERE window_end <= (SELECT max(ts) FROM logs) - INTERVAL 10 MINUTE""",
    "latency_mean latency_max",
)
def stream_ops_windows(spark, sf):
    out = scratch_path(spark, "windows")
    windows = J.health_windows(_log_stream(spark, sf))
    J.append_to(windows, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    stored = spark.read.schema(windows.schema).parquet(f"{out}/data")
    return stored.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}).drop("latency_p95")
