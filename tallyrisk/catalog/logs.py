"""Monitoring queries on the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrisk.catalog.base import query
from tallyrisk.catalog.standins import cte, log_table, plain_logs
from tallyrisk.functions.json_body import feature_map, parsed
from tallyrisk.operators import monitor as M
from tallyrisk.plans.monitoring_run import monitoring_run
from tallyrisk.session import scratch_path
from tallyrisk.sources import batches as B
from tallyrisk.sources.event_log import recent_events

LOGS = cte("logs")


def _ntz(c: str):
    return F.col(c).cast("timestamp_ntz")


@query(
    "ops_summary",
    f"""{LOGS} SELECT count(*) AS n_requests, avg(CASE WHEN status_code >= 400 THEN 1.0 ELSE 0.0 END) AS error_rate,
    quantile_cont(latency_ms, 0.95) AS latency_p95_ms FROM logs""",
    "error_rate latency_p95_ms",
)
def ops_summary(spark, sf):
    return M.ops_summary(plain_logs(spark, sf))


_ANOMALY = f"""{LOGS}, everything AS (SELECT count(*) AS n_requests,
    avg(CASE WHEN status_code >= 400 THEN 1.0 ELSE 0.0 END) AS error_rate, quantile_cont(latency_ms, 0.95) AS latency_p95_ms FROM logs),
    newest AS (SELECT latency_ms FROM logs ORDER BY ts DESC, id DESC LIMIT 300),
    recent AS (SELECT quantile_cont(latency_ms, 0.95) AS recent_p95 FROM newest)"""


@query(
    "latency_anomaly",
    f"""{_ANOMALY} SELECT n_requests, error_rate, latency_p95_ms, recent_p95,
    least(n_requests, 300) > 30 AND latency_p95_ms > 0 AND recent_p95 > latency_p95_ms * 1.5 AS latency_abnormal
    FROM everything, recent""",
    "error_rate latency_p95_ms recent_p95",
)
def latency_anomaly(spark, sf):
    return M.latency_anomaly(plain_logs(spark, sf))


@query(
    "ops_alerts",
    f"""{_ANOMALY} SELECT n_requests, error_rate > 0.05 AS high_error_rate,
    least(n_requests, 300) > 30 AND latency_p95_ms > 0 AND recent_p95 > latency_p95_ms * 1.5 AS abnormal_latency,
    CAST((error_rate > 0.05)::INT + (least(n_requests, 300) > 30 AND latency_p95_ms > 0 AND recent_p95 > latency_p95_ms * 1.5)::INT AS INT) AS n_alerts
    FROM everything, recent""",
)
def ops_alerts(spark, sf):
    return M.ops_alerts(plain_logs(spark, sf)).select(
        "n_requests",
        F.array_contains("alerts", "high error rate").alias("high_error_rate"),
        F.array_contains("alerts", "abnormal latency").alias("abnormal_latency"),
        F.size("alerts").alias("n_alerts"),
    )


@query("latency_series", f"{LOGS} SELECT ts AS timestamp, latency_ms FROM logs WHERE latency_ms IS NOT NULL", "latency_ms")
def latency_series(spark, sf):
    return M.latency_series(plain_logs(spark, sf)).withColumn("timestamp", _ntz("timestamp"))


@query(
    "score_histogram",
    f"""{LOGS} SELECT CAST(least(floor(score / 0.05) + 1, 20) AS BIGINT) AS bin, count(*) AS n,
    (CAST(least(floor(score / 0.05) + 1, 20) AS BIGINT) - 1) * 0.05 AS bin_start
    FROM logs WHERE score BETWEEN 0 AND 1 GROUP BY 1""",
    "bin_start",
)
def score_histogram(spark, sf):
    return M.score_histogram(plain_logs(spark, sf))


@query(
    "decision_distribution",
    f"""{LOGS} SELECT coalesce(decision, 'UNKNOWN') AS value, count(*) AS n,
    count(*) / (SELECT count(*) FROM logs)::DOUBLE AS share FROM logs GROUP BY 1""",
    "share",
)
def decision_distribution(spark, sf):
    return M.decision_shares(plain_logs(spark, sf))


@query(
    "latency_percentiles",
    f"""{LOGS} SELECT 'inference_ms' AS measure, quantile_cont(inference_ms, 0.5) AS p50, quantile_cont(inference_ms, 0.95) AS p95 FROM logs
    UNION ALL SELECT 'latency_ms', quantile_cont(latency_ms, 0.5), quantile_cont(latency_ms, 0.95) FROM logs""",
    "p50 p95",
)
def latency_percentiles(spark, sf):
    logs = plain_logs(spark, sf)
    parts = [M.latency_quantiles(logs, c).select(F.lit(c).alias("measure"), "p50", "p95") for c in ("inference_ms", "latency_ms")]
    return parts[0].unionByName(parts[1])


@query(
    "latency_rank_percentile",
    f"""{LOGS}, ranked AS (SELECT latency_ms, status_code, row_number() OVER (ORDER BY latency_ms) - 1 AS k, count(*) OVER () AS n FROM logs)
    SELECT count(*) AS request_count, count(*) FILTER (WHERE status_code >= 400) AS error_count,
    max(latency_ms) FILTER (WHERE k = CAST(floor(0.5::DOUBLE * (n - 1)) AS BIGINT)) AS latency_p50,
    max(latency_ms) FILTER (WHERE k = CAST(floor(0.95::DOUBLE * (n - 1)) AS BIGINT)) AS latency_p95 FROM ranked""",
    "latency_p50 latency_p95",
)
def latency_rank_percentile(spark, sf):
    return M.runtime_totals(plain_logs(spark, sf))


_VALID = "status_code < 400 AND ts IS NOT NULL AND body LIKE '{%:%}'"


@query(
    "log_valid_rows",
    f"{LOGS} SELECT id, ts AS timestamp, status_code, latency_ms, CAST(json_extract(body, '$.k') AS DOUBLE) AS k FROM logs WHERE {_VALID}",
    "latency_ms k",
)
def log_valid_rows(spark, sf):
    valid = M.valid_rows(log_table(spark, sf))
    return valid.select("id", _ntz("timestamp").alias("timestamp"), "status_code", "latency_ms", F.col("input_features")["k"].alias("k"))


_WINDOWS = f"""{LOGS}, valid AS (SELECT *, row_number() OVER (ORDER BY ts DESC, id DESC) AS rn, count(*) OVER () AS n FROM logs WHERE {_VALID}),
    sized AS (SELECT *, CASE WHEN n < 40 THEN 0 WHEN n >= 250 THEN 50 ELSE greatest(20, least(50, n // 5)) END AS c,
    CASE WHEN n < 40 THEN 0 WHEN n >= 250 THEN 200 ELSE greatest(20, n - greatest(20, least(50, n // 5))) END AS b FROM valid)"""


@query(
    "drift_windows",
    f"""{_WINDOWS} SELECT id, ts AS timestamp, CAST(rn AS INT) AS rn, CASE WHEN rn <= c THEN 'current' ELSE 'baseline' END AS side,
    n AS n_valid_logs, CAST(c AS BIGINT) AS current_window, CAST(b AS BIGINT) AS baseline_window FROM sized WHERE rn <= c + b""",
)
def drift_windows(spark, sf):
    top = M.drift_windows(log_table(spark, sf))
    return top.select("id", _ntz("timestamp").alias("timestamp"), "rn", "side", "n_valid_logs", "current_window", "baseline_window")


@query(
    "log_recent_events",
    f"""{LOGS} SELECT ts AS timestamp, endpoint, method, status_code, latency_ms, inference_ms, sha256(json(body)::VARCHAR) AS payload_hash,
    score, decision, 'demo-0.1.0' AS model_version, CASE WHEN status_code >= 400 THEN 'Prediction failed' END AS error
    FROM logs ORDER BY ts DESC, id DESC LIMIT 5000""",
    "latency_ms inference_ms score",
)
def log_recent_events(spark, sf):
    newest = recent_events(log_table(spark, sf))
    return newest.withColumn("timestamp", _ntz("timestamp")).drop("payload_keys", "input_features")


# Run history: every event is a run whose documents are JSON text.
_RUNS = """runs AS (SELECT event_id AS id, ts AS run_at,
    '{"error_rate": ' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) || '.5, "latency_p95_ms": "' || event_type || '"}' AS operational,
    CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN '{"enabled": true}' ELSE '{"enabled": false}' END AS drift FROM events)"""


def _runs(spark, sf):
    from tallyrisk.catalog.base import table

    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"error_rate": '), k, F.lit('.5, "latency_p95_ms": "'), F.col("event_type"), F.lit('"}'))
    drift = F.when(F.col("event_type") == "view", F.lit('{"enabled": true}')).when(F.col("event_type") != "error", F.lit('{"enabled": false}'))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("run_at"), text.alias("operational"), drift.alias("drift"))


@query(
    "mon_history_json",
    f"""WITH {_RUNS} SELECT id, run_at, TRY_CAST(json_extract_string(operational, '$.error_rate') AS DOUBLE) AS error_rate,
    TRY_CAST(json_extract_string(operational, '$.latency_p95_ms') AS DOUBLE) AS latency_p95_ms,
    coalesce(TRY_CAST(json_extract_string(drift, '$.enabled') AS BOOLEAN), false) AS drift_enabled
    FROM runs ORDER BY run_at DESC, id DESC LIMIT 50""",
    "error_rate latency_p95_ms",
)
def mon_history_json(spark, sf):
    return M.run_history(_runs(spark, sf), limit=50)


@query(
    "mon_history_counts",
    f"""WITH {_RUNS} SELECT count(*) AS runs_count, count(*) FILTER (WHERE coalesce(drift LIKE '%true%', false)) AS drift_enabled_runs,
    count(*) FILTER (WHERE NOT coalesce(drift LIKE '%true%', false)) AS drift_disabled_runs FROM runs""",
)
def mon_history_counts(spark, sf):
    return M.run_history(_runs(spark, sf)).agg(
        F.count(F.lit(1)).alias("runs_count"),
        F.count_if("drift_enabled").alias("drift_enabled_runs"),
        F.count_if(~F.col("drift_enabled")).alias("drift_disabled_runs"),
    )


@query(
    "mon_latest_run",
    f"WITH {_RUNS} SELECT id, run_at, operational, coalesce(drift, '{{}}') AS drift FROM runs ORDER BY run_at DESC, id DESC LIMIT 1",
)
def mon_latest_run(spark, sf):
    return M.latest_run(_runs(spark, sf))


# The two windows hold the single feature k; its KS statistic over 250 rows decides the verdict.
_KS = f"""{_WINDOWS}, w AS (SELECT CAST(json_extract(body, '$.k') AS DOUBLE) AS v, rn <= c AS is_cur FROM sized WHERE rn <= c + b),
    steps AS (SELECT v, sum(count(*) FILTER (WHERE NOT is_cur)) OVER (ORDER BY v) / (SELECT count(*) FROM w WHERE NOT is_cur)::DOUBLE AS f_ref,
    sum(count(*) FILTER (WHERE is_cur)) OVER (ORDER BY v) / (SELECT count(*) FROM w WHERE is_cur)::DOUBLE AS f_cur FROM w GROUP BY v),
    dist AS (SELECT max(abs(f_ref - f_cur)) AS d, (SELECT count(*) FROM w WHERE NOT is_cur)::DOUBLE AS n, (SELECT count(*) FROM w WHERE is_cur)::DOUBLE AS m FROM steps),
    lam AS (SELECT (sqrt(n * m / (n + m)) + 0.12 + 0.11 / sqrt(n * m / (n + m))) * d AS l FROM dist),
    pv AS (SELECT CASE WHEN l < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * (SELECT sum((CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * j * j * l * l)) FROM range(1, 101) t(j)))) END AS p FROM lam)"""


@query(
    "monitoring_run",
    f"""{_KS}, e AS (SELECT count(*) AS n_requests, avg(CASE WHEN status_code >= 400 THEN 1.0 ELSE 0.0 END) AS error_rate,
    quantile_cont(latency_ms, 0.95) AS latency_p95_ms FROM logs)
    SELECT n_requests, error_rate, latency_p95_ms, true AS drift_enabled, CAST(1 AS INT) AS n_features_compared,
    CAST((p < 0.05)::INT AS INT) AS n_drifted, 'logs_baseline_vs_current' AS reference_source,
    (SELECT count(*) FROM valid) AS n_valid_logs, CAST(200 AS INT) AS baseline_window, CAST(50 AS INT) AS current_window FROM e, pv""",
    "error_rate latency_p95_ms",
)
def run_monitoring(spark, sf):
    run = monitoring_run(log_table(spark, sf))
    return run.select(
        "operational.n_requests",
        "operational.error_rate",
        "operational.latency_p95_ms",
        F.col("drift.enabled").alias("drift_enabled"),
        "drift.n_features_compared",
        "drift.n_drifted",
        "drift.reference_source",
        "drift.windowing.n_valid_logs",
        "drift.windowing.baseline_window",
        "drift.windowing.current_window",
    )


@query(
    "mon_append_run",
    f"""{LOGS} SELECT 7::BIGINT AS id, avg(CASE WHEN status_code >= 400 THEN 1.0 ELSE 0.0 END) AS error_rate,
    quantile_cont(latency_ms, 0.95) AS latency_p95_ms, true AS drift_enabled FROM logs""",
    "error_rate latency_p95_ms",
)
def mon_append_run(spark, sf):
    """A run over the whole log is stored under its batch, twice, and read from the history."""
    run = monitoring_run(log_table(spark, sf))
    path = scratch_path(spark, "runs")
    for _ in range(2):
        B.write_run(run, path, 7)
    return M.run_history(B.read_runs(spark, path)).drop("run_at")
