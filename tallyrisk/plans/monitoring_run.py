"""One monitoring run: operational summary, drift between log windows, and the reasons if there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tallyrisk.functions.json_body import features_long
from tallyrisk.operators import drift as D, monitor as M
from tallyrisk.session import settle

NO_REFERENCE = "reference or production features not available"
NO_COMMON = "no informative feature in common"
FROM_WINDOWS = "logs_baseline_vs_current"
FROM_REFERENCE = "reference_csv_vs_all_logs"


def window_counts(windows: DataFrame) -> DataFrame:
    """(feature, value) counts of the baseline and current windows (at most 250 log rows)."""
    sides = {s: windows.where(F.col("side") == s) for s in ("baseline", "current")}
    long = {s: features_long(rows, []) for s, rows in sides.items()}
    sizes = {s: rows.agg(F.count(F.lit(1))).scalar() for s, rows in sides.items()}
    return D.side_counts(long["baseline"], long["current"], sizes["baseline"], sizes["current"])


def feature_maps(reference: DataFrame) -> DataFrame:
    """Column ``input_features`` of a reference table: it has one already, or each of its numeric columns is a feature."""
    if "input_features" in reference.columns:
        return reference
    names = [f.name for f in reference.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    if not names:
        return reference.select(F.create_map().cast("map<string,double>").alias("input_features"))
    values = F.array(*[F.col(f"`{n}`").cast("double") for n in names])
    return reference.select(F.map_from_arrays(F.lit(names), values).alias("input_features"))


def reference_counts(reference: DataFrame, logs: DataFrame) -> DataFrame:
    """(feature, value) counts of a reference table (wide, or with an ``input_features`` map) and of all logs."""
    return D.map_counts(feature_maps(reference), logs)


def monitoring_run(logs: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """One row with the structs ``operational`` and ``drift``.

    Windows of the newest valid rows are compared if there are enough; else the reference with all
    logs. Only counts of at most a few numbers reach the driver to choose between the two."""
    alerts = M.ops_alerts(logs)
    operational = alerts.select(F.struct("n_requests", "error_rate", "latency_p95_ms", "alerts").alias("operational"))

    n_valid = M.valid_rows(logs).count()
    current, baseline = (0, 0)
    source = FROM_REFERENCE
    tests = None
    if n_valid >= M.MIN_LOGS:
        # At most 250 rows: written once, so that the log is not parsed again for every figure.
        windows = settle(M.drift_windows(logs).select("side", "input_features"))
        sizes = {r["side"]: r["n"] for r in windows.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
        current, baseline = sizes.get("current", 0), sizes.get("baseline", 0)
        source = FROM_WINDOWS
        tests = D.drift_tests(window_counts(windows))
    elif reference is not None:
        tests = D.drift_tests(reference_counts(reference, logs))

    frame = operational
    if tests is None:
        verdict = {"enabled": F.lit(False), "n_features_compared": F.lit(0), "n_drifted": F.lit(0), "share_drifted": F.lit(0.0)}
        reason = F.lit(NO_REFERENCE)
    else:
        row = D.drift_verdict(tests)
        verdict = {c: row.select(c).scalar() for c in row.columns}
        reason = F.when(~verdict["enabled"], F.lit(NO_COMMON))
    drift = F.struct(
        verdict["enabled"].alias("enabled"),
        reason.alias("reason"),
        verdict["n_features_compared"].cast("int").alias("n_features_compared"),
        verdict["n_drifted"].cast("int").alias("n_drifted"),
        verdict["share_drifted"].alias("share_drifted"),
        F.lit(source).alias("reference_source"),
        F.struct(
            F.lit(n_valid).cast("bigint").alias("n_valid_logs"),
            F.lit(baseline).cast("int").alias("baseline_window"),
            F.lit(current).cast("int").alias("current_window"),
            F.lit(None if n_valid >= M.MIN_LOGS else M.TOO_FEW_LOGS).cast("string").alias("reason"),
        ).alias("windowing"),
    )
    return frame.withColumn("drift", drift)


def write_summary(run: DataFrame, path: str) -> None:
    run.write.mode("overwrite").json(path)
