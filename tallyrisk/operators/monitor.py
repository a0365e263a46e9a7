"""Operational numbers of the scoring log: summary, alerts, windows, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyrisk.operators.aggregate import value_shares, with_scalars
from tallyrisk.operators.running import exact_quantiles
from tallyrisk.operators.windows import newest_rows

# Alert limits and log window sizes.
ERROR_STATUS = 400
ERROR_RATE_LIMIT = 0.05
RECENT_ROWS = 300
RECENT_MINIMUM = 30
LATENCY_FACTOR = 1.5
MIN_LOGS = 40
CURRENT_ROWS = 50
BASELINE_ROWS = 200
SMALLEST_WINDOW = 20
NO_LOGS = "no production log available"
TOO_FEW_LOGS = "not enough valid logs for baseline and current windows"


def newest_first(time: str = "timestamp", tie: str = "id") -> list[Column]:
    return [F.col(time).desc_nulls_last(), F.col(tie).desc_nulls_last()]


def is_error(status: str = "status_code") -> Column:
    """Status 400 or above; an unknown status is no error."""
    return F.coalesce(F.col(status) >= ERROR_STATUS, F.lit(False))


def valid_rows(logs: DataFrame) -> DataFrame:
    """Rows with a timestamp, a good status and at least one feature."""
    return logs.where(
        F.col("timestamp").isNotNull() & (F.col("status_code") < ERROR_STATUS) & (F.size("input_features") > 0)
    )


def latency_quantiles(logs: DataFrame, column: str = "latency_ms") -> DataFrame:
    return exact_quantiles(logs, column, {"p50": 0.5, "p95": 0.95})


def runtime_totals(logs: DataFrame) -> DataFrame:
    """Requests, errors and lower-rank p50/p95 (0 without rows)."""
    ranks = exact_quantiles(logs, "latency_ms", {"latency_p50": 0.5, "latency_p95": 0.95}, method="lower")
    totals = logs.agg(F.count(F.lit(1)).alias("request_count"), F.count_if(is_error()).alias("error_count"))
    joined = with_scalars(totals, ranks)
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("latency_p50", "latency_p95")})


def ops_summary(logs: DataFrame) -> DataFrame:
    """Number of requests, error rate over all rows, interpolated p95 latency (0 without latencies,
    null without rows)."""
    p95 = exact_quantiles(logs, "latency_ms", {"latency_p95_ms": 0.95})
    totals = logs.agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.avg(is_error().cast("double")).alias("error_rate"),
    )
    row = with_scalars(totals, p95)
    latency = F.when(F.col("n_requests") > 0, F.coalesce("latency_p95_ms", F.lit(0.0)))
    return row.withColumn("latency_p95_ms", latency)


def recent_p95(logs: DataFrame, order: list[Column] | None = None, n: int = RECENT_ROWS) -> DataFrame:
    """p95 of the newest n rows; the percentile's value map is bounded by n."""
    recent = logs.orderBy(*(order or newest_first())).limit(n)
    return recent.agg(F.percentile("latency_ms", F.lit(0.95)).alias("recent_p95"))


def latency_anomaly(logs: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Newest-300 p95 against the p95 of all rows."""
    row = with_scalars(ops_summary(logs), recent_p95(logs, order))
    abnormal = (
        (F.least("n_requests", F.lit(RECENT_ROWS)) > RECENT_MINIMUM)
        & (F.col("latency_p95_ms") > 0)
        & (F.col("recent_p95") > F.col("latency_p95_ms") * LATENCY_FACTOR)
    )
    return row.withColumn("latency_abnormal", F.coalesce(abnormal, F.lit(False)))


def ops_alerts(logs: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Summary with the list of alert texts."""
    row = latency_anomaly(logs, order)
    alerts = F.array_compact(
        F.array(
            F.when(F.col("n_requests") == 0, F.lit(NO_LOGS)),
            F.when(F.col("error_rate") > ERROR_RATE_LIMIT, F.lit("high error rate")),
            F.when(F.col("latency_abnormal"), F.lit("abnormal latency")),
        )
    )
    return row.withColumn("alerts", alerts)


def latency_series(logs: DataFrame) -> DataFrame:
    return logs.select("timestamp", "latency_ms").dropna().orderBy("timestamp", "latency_ms")


def score_histogram(logs: DataFrame, low: float = 0.0, high: float = 1.0, bins: int = 20, column: str = "score") -> DataFrame:
    """Counts per equal-width bin; the top edge belongs to the last bin."""
    inside = logs.where(F.col(column).between(low, high))
    number = F.least(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins).cast("long"))
    width = (high - low) / bins
    counts = inside.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("bin_start", F.lit(low) + (F.col("bin") - 1) * F.lit(width))


def decision_shares(logs: DataFrame, column: str = "decision") -> DataFrame:
    return value_shares(logs, column, "UNKNOWN")


def window_sizes(n: Column) -> tuple[Column, Column]:
    """Rows of the current and the baseline window for n valid rows."""
    small = F.greatest(F.lit(SMALLEST_WINDOW), F.least(F.lit(CURRENT_ROWS), F.floor(n / 5)))
    whole = n >= CURRENT_ROWS + BASELINE_ROWS
    current = F.when(n < MIN_LOGS, F.lit(0)).when(whole, F.lit(CURRENT_ROWS)).otherwise(small)
    baseline = F.when(n < MIN_LOGS, F.lit(0)).when(whole, F.lit(BASELINE_ROWS)).otherwise(F.greatest(F.lit(SMALLEST_WINDOW), n - small))
    return current.cast("long"), baseline.cast("long")


def drift_windows(logs: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """The newest valid rows marked ``current`` or ``baseline`` (at most 250 rows), with their rank,
    the number of valid rows and both window sizes."""
    valid = valid_rows(logs)
    n = valid.agg(F.count(F.lit(1))).scalar()
    top = newest_rows(valid, order or newest_first(), CURRENT_ROWS + BASELINE_ROWS).withColumn("n_valid_logs", n)
    current, baseline = window_sizes(F.col("n_valid_logs"))
    top = top.withColumns({"current_window": current, "baseline_window": baseline})
    side = F.when(F.col("rn") <= F.col("current_window"), F.lit("current")).when(
        F.col("rn") <= F.col("current_window") + F.col("baseline_window"), F.lit("baseline")
    )
    return top.withColumn("side", side).where(F.col("side").isNotNull())


def run_history(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs with numbers read from their JSON documents: all, or the newest for a trend."""
    newest = runs
    if limit is not None:
        newest = runs.orderBy(F.col("run_at").desc_nulls_last(), F.col("id").desc_nulls_last()).limit(limit)
    return newest.select(
        "id",
        "run_at",
        F.get_json_object("operational", "$.error_rate").try_cast("double").alias("error_rate"),
        F.get_json_object("operational", "$.latency_p95_ms").try_cast("double").alias("latency_p95_ms"),
        F.coalesce(F.get_json_object("drift", "$.enabled").try_cast("boolean"), F.lit(False)).alias("drift_enabled"),
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run; a missing document reads as an empty one. A plain aggregate, one row."""
    newest = runs.agg(F.max_by(F.struct(*runs.columns), F.struct("run_at", "id")).alias("r")).select("r.*")
    return newest.withColumns({c: F.coalesce(F.col(c), F.lit("{}")) for c in ("operational", "drift")})
