"""Scoring, event log, sources, streams, saved models."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrisk.catalog.scoring import request_rows
from tallyrisk.catalog.standins import log_table, plain_logs, standin
from tallyrisk.operators import monitor as M, neighbours as N, score as R
from tallyrisk.plans import monitoring_run as MR, training as T
from tallyrisk.session import scratch_path
from tallyrisk.sources import event_log as L, tables as S
from tallyrisk.sources.schemas import API_CALLS, RAW_TABLES, REQUEST
from tallyrisk.streaming import jobs as J


# --- scoring ---------------------------------------------------------------------------------------


def test_rule_model_stays_in_range(spark):
    df = spark.createDataFrame([(42, 65000.0, 15000.0, 1700.0, 8.0, 3.0), (35, 50000.0, 12000.0, 1200.0, 6.0, 3.0)], REQUEST)
    for r in R.score_requests(df).collect():
        assert 0 <= r["score"] <= 1 and r["decision"] in {"ACCEPT", "REJECT"}


def test_decision_limits(spark):
    df = spark.createDataFrame([(0.4889,), (0.4888,), (0.5889,), (None,)], "score DOUBLE")
    got = [(r["decision"], r["score_missing"]) for r in R.decide(df).collect()]
    assert got == [("REJECT", False), ("ACCEPT", False), ("REJECT", False), ("ACCEPT", True)]


def test_feature_maps_need_a_fitted_model(spark):
    df = spark.sql("SELECT map('a', 1D) AS features UNION ALL SELECT CAST(NULL AS MAP<STRING, DOUBLE>)")
    assert sorted(r["status_code"] for r in R.route(df, False).collect()) == [200, 400]
    assert {r["status_code"] for r in R.route(df, True).collect()} == {200}


def test_perturbation_keeps_zero_and_one_and_is_repeatable(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 100.0)], "id INT, a DOUBLE, b DOUBLE, c DOUBLE")
    rows = [tuple(r) for r in R.perturb(df, ["a", "b", "c"], 20, 10, 7, "id").collect()]
    assert all(r[1] == 0 and r[2] == 1 and 90 <= r[3] <= 110 for r in rows) and len({r[3] for r in rows}) > 10
    assert sorted(rows) == sorted(tuple(r) for r in R.perturb(df, ["a", "b", "c"], 20, 10, 7, "id").collect())


# --- log windows and alerts --------------------------------------------------------------------------


def logs_of(spark, n, status=200, latency=10.0):
    t = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)
    features = F.create_map(F.lit("k"), (F.col("id") % 9).cast("double"))
    return spark.range(n).select("id", t.alias("timestamp"), F.lit(status).alias("status_code"), F.lit(latency).alias("latency_ms"), features.alias("input_features"))


@pytest.mark.parametrize("n,current,baseline", [(39, 0, 0), (40, 20, 20), (249, 49, 200), (250, 50, 200), (300, 50, 200)])
def test_window_sizes(spark, n, current, baseline):
    got = M.drift_windows(logs_of(spark, n)).groupBy("side").count().collect()
    sizes = {r["side"]: r["count"] for r in got}
    assert (sizes.get("current", 0), sizes.get("baseline", 0)) == (current, baseline)


def test_empty_log(spark):
    row = M.ops_alerts(logs_of(spark, 0)).first()
    assert (row["n_requests"], row["error_rate"], row["latency_p95_ms"], row["alerts"]) == (0, None, None, [M.NO_LOGS])
    totals = M.runtime_totals(logs_of(spark, 0)).first()
    assert tuple(totals) == (0, 0, 0.0, 0.0)


def test_alerts(spark):
    old = logs_of(spark, 8000)
    new = logs_of(spark, 310, status=500, latency=100.0).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 30 DAYS"))
    assert M.ops_alerts(old).first()["alerts"] == []
    assert M.ops_alerts(old.unionByName(new)).first()["alerts"] == ["abnormal latency"]
    assert M.ops_alerts(new).first()["alerts"] == ["high error rate"]


def test_unknown_status_is_no_error(spark):
    df = logs_of(spark, 4).withColumn("status_code", F.when(F.col("id") == 0, 500).when(F.col("id") == 1, 200))
    assert M.ops_summary(df).first()["error_rate"] == 0.25


def test_monitoring_run_explains_itself(spark):
    few = MR.monitoring_run(logs_of(spark, 10)).first()["drift"]
    assert not few["enabled"] and few["reason"] == MR.NO_REFERENCE and few["windowing"]["reason"] == M.TOO_FEW_LOGS
    reference = spark.sql("SELECT map('k', CAST(id AS DOUBLE)) AS input_features FROM range(30)")
    compared = MR.monitoring_run(logs_of(spark, 10), reference).first()["drift"]
    assert compared["enabled"] and compared["reference_source"] == MR.FROM_REFERENCE and compared["n_features_compared"] == 1
    full = MR.monitoring_run(logs_of(spark, 300)).first()["drift"]
    assert full["enabled"] and full["reference_source"] == MR.FROM_WINDOWS and full["windowing"]["baseline_window"] == 200
    flat = MR.monitoring_run(logs_of(spark, 300).withColumn("input_features", F.create_map(F.lit("k"), F.lit(1.0)))).first()["drift"]
    assert not flat["enabled"] and flat["reason"] == MR.NO_COMMON


# --- tables ------------------------------------------------------------------------------------------


def test_log_table_round_trip(spark, sf):
    calls, runs = "calls_t1", "runs_t1"
    L.create_tables(spark, calls, runs)
    L.create_tables(spark, calls, runs)
    logs = log_table(spark, sf)
    L.append_events(logs, calls)
    assert spark.table(calls).count() == logs.count()
    bare = spark.createDataFrame([(None, "/predict", "POST", 422, 1.0, 0.0)], "timestamp TIMESTAMP, endpoint STRING, method STRING, status_code INT, latency_ms DOUBLE, inference_ms DOUBLE")
    full = bare.select("*", *[F.lit(None).cast(t).alias(c) for c, t in [("payload_hash", "string"), ("payload_keys", "array<string>"), ("input_features", "map<string,double>"), ("score", "double"), ("decision", "int"), ("model_version", "string"), ("error", "string")]])
    L.append_events(full, calls)
    newest = L.recent_events(spark.table(calls), 1).first()
    assert newest["payload_keys"] == [] and newest["input_features"] == {} and newest["timestamp"].year >= 2024
    L.append_run(MR.monitoring_run(logs), runs)
    history = M.run_history(spark.table(runs)).first()
    assert history["drift_enabled"] and history["error_rate"] == pytest.approx(M.ops_summary(logs).first()["error_rate"])
    assert M.latest_run(spark.table(runs)).first()["operational"].startswith("{")
    assert L.clear_table(spark, calls) == logs.count() + 1 and spark.table(calls).count() == 0
    L.append_model_run(spark, "first", {"depth": 5}, {"auc": 0.75}, "model_runs_t1")
    assert spark.table("model_runs_t1").first()["metrics"] == {"auc": 0.75}


def test_backfill(spark, sf):
    path = scratch_path(spark, "lines")
    logs = log_table(spark, sf)
    text = logs.select(F.to_json(F.struct(*logs.columns), L.JSON_OPTIONS).alias("value"))
    more = spark.createDataFrame([("",), ("  ",), ("[1]",), ('"x"',)], "value STRING")
    text.unionByName(more).write.text(path)
    L.create_tables(spark, "calls_t2", "runs_t2")
    n = logs.count()
    assert L.backfill(spark, path, "calls_t2") == n
    assert L.backfill(spark, path, "calls_t2", skip_known=True) == 0
    assert L.backfill(spark, path, "calls_t2") == n and spark.table("calls_t2").count() == 2 * n
    broken = scratch_path(spark, "broken")
    spark.createDataFrame([('{"endpoint": "/x"}',), ("{oops",)], "value STRING").write.text(broken)
    with pytest.raises(ValueError):
        L.backfill(spark, broken, "calls_t2")


def test_json_log_keeps_its_own_time(spark):
    path = scratch_path(spark, "log")
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 2, 3, 4, 5, 678901)), ("b", None)], "endpoint STRING, timestamp TIMESTAMP")
    L.append_json(df, path)
    got = {r["endpoint"]: r["timestamp"] for r in L.read_json_log(spark, path).collect()}
    assert got["a"] == dt.datetime(2024, 1, 2, 3, 4, 5, 678901) and got["b"].year > 2024


def test_source_preference(spark):
    path = scratch_path(spark, "pref")
    assert S.first_source(spark, API_CALLS, "no_such_table", path).isEmpty()
    L.append_json(logs_of(spark, 3), path)
    assert S.first_source(spark, API_CALLS, "no_such_table", path).count() == 3
    L.create_tables(spark, "calls_t3", "runs_t3")
    assert S.first_source(spark, API_CALLS, "calls_t3", path).count() == 3  # the table has no rows yet
    L.backfill(spark, path, "calls_t3")
    L.backfill(spark, path, "calls_t3")
    assert S.first_source(spark, API_CALLS, "calls_t3", path).count() == 6


def test_missing_sources(spark):
    missing = scratch_path(spark, "none")
    assert S.optional(lambda: S.read_csv(spark, missing, RAW_TABLES["bureau"])) is None
    with pytest.raises(FileNotFoundError):
        S.read_raw_csv(spark, missing, {"bureau": "bureau.csv"}, RAW_TABLES, needed=["bureau"])


def test_a_row_cap_needs_an_order(spark):
    path = scratch_path(spark, "csv")
    S.write_csv(spark.range(9), path)
    with pytest.raises(ValueError):
        S.read_csv(spark, path, "id BIGINT", cap=5)
    assert sorted(r["id"] for r in S.read_csv(spark, path, "id BIGINT", cap=2, order="id").collect()) == [0, 1]


def test_bucketed_ingest_needs_no_shuffle(spark, sf):
    bureau = standin(spark, sf, "bureau")
    S.ingest(bureau, scratch_path(spark, "bucketed"), "SK_ID_CURR", buckets=4, table="bureau_t1")
    plan = spark.table("bureau_t1").groupBy("SK_ID_CURR").count()
    plan.collect()
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


# --- streams -----------------------------------------------------------------------------------------


def _requests(spark, sf):
    return request_rows(standin(spark, sf, "requests"))


def test_scored_stream_equals_batch(spark, sf):
    source, out = scratch_path(spark, "requests"), scratch_path(spark, "out")
    batch = _requests(spark, sf)
    batch.repartition(3).write.parquet(source)
    scored = J.scored_log(J.file_stream(spark, source, batch.schema))
    J.append_to(scored, f"{out}/data", f"{out}/cp").awaitTermination()
    J.append_to(scored, f"{out}/data", f"{out}/cp").awaitTermination()  # a restart adds nothing
    a = spark.read.schema(scored.schema).parquet(f"{out}/data")
    b = J.scored_log(batch)
    key = F.xxhash64("timestamp", "payload_hash", "status_code", "score", "decision", "error")
    assert a.count() == b.count() and a.agg(F.sum(key.cast("decimal(38,0)"))).first() == b.agg(F.sum(key.cast("decimal(38,0)"))).first()


def test_late_rows_are_dropped(spark):
    source, out = scratch_path(spark, "late"), scratch_path(spark, "late-out")
    schema = "timestamp TIMESTAMP, status_code INT, latency_ms DOUBLE"

    def batch(*hours):
        rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), 500, 2.0) for h in hours]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        J.append_to(J.health_windows(J.file_stream(spark, source, schema)), f"{out}/data", f"{out}/cp").awaitTermination()

    batch(0.1, 0.2, 5.5)
    batch(0.3, 9.5)  # the first of these comes hours too late
    rows = spark.read.parquet(f"{out}/data").orderBy("window_start").collect()
    assert [(r["window_start"].hour, r["n_requests"], r["n_errors"]) for r in rows] == [(0, 2, 2), (5, 1, 1)]


def test_running_totals_of_the_stream(spark, sf):
    source, out = scratch_path(spark, "totals-in"), scratch_path(spark, "totals")
    logs = plain_logs(spark, sf)
    logs.write.parquet(source)
    J.replace_at(J.totals(J.file_stream(spark, source, logs.schema)), f"{out}/data", f"{out}/cp").awaitTermination()
    got, want = J.newest_result(spark, f"{out}/data").first(), M.runtime_totals(logs).first()
    assert (got["request_count"], got["error_count"]) == (want["request_count"], want["error_count"])
    assert got["latency_p95"] == pytest.approx(want["latency_p95"], rel=0.02)


def test_monitoring_of_a_stream(spark, sf):
    source, out = scratch_path(spark, "watch-in"), scratch_path(spark, "watch")
    logs = log_table(spark, sf)
    logs.write.parquet(source)
    runs = []
    J.log_and_watch(J.file_stream(spark, source, logs.schema), f"{out}/log", f"{out}/cp", on_run=lambda r: runs.append(r.first())).awaitTermination()
    assert len(runs) == 1 and runs[0]["operational"]["n_requests"] == logs.count() and runs[0]["drift"]["enabled"]


# --- models ------------------------------------------------------------------------------------------


def test_bundle_round_trip_and_fallback(spark):
    rows = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("label"), ((F.col("id") % 2) * 2 + F.col("id") % 7).cast("double").alias("a"))
    model = T.logistic(["a"]).fit(T.with_class_weight(rows))
    path = scratch_path(spark, "bundle")
    assert T.load_bundle(spark, path) is None
    T.save_bundle(spark, T.ModelBundle(model, ["a"], {"a": 3.0}, "v1"), path)
    bundle = T.load_bundle(spark, path)
    assert (bundle.feature_names, bundle.medians, bundle.model_version) == (["a"], {"a": 3.0}, "v1")
    holes = rows.withColumn("a", F.when(F.col("id") > 10, F.col("a")))
    got = T.score_batch(holes, bundle, ["id"])
    assert got.count() == 400 and got.where("score IS NULL").isEmpty()
    request = spark.createDataFrame([(42, 65000.0, 15000.0, 1700.0, 8.0, 3.0)], REQUEST).withColumn("id", F.lit(1))
    assert T.score_batch(request, None, ["id"]).first()["model_version"] == R.RULE_MODEL_VERSION


def test_smote_balances_between_neighbours(spark):
    rows = spark.range(300).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"), F.col("id").cast("double").alias("a"), (F.col("id") * 2).cast("double").alias("b"))
    got = T.smote(rows, ["a", "b"], "id").toPandas()
    assert (got.label == 1).sum() == (got.label == 0).sum() == 270
    made = got[got.synthetic]
    assert made.a.between(0, 290).all() and (abs(made.b - 2 * made.a) < 1e-6).all()


def test_smote_with_equal_rows(spark):
    rows = spark.range(200).select("id", (F.col("id") < 40).cast("int").alias("label"), F.lit(1.0).alias("a"), F.lit(2.0).alias("b"))
    got = T.smote(rows, ["a", "b"], "id")
    assert got.where("label = 1").count() == 160 and got.where("label = 1 AND (a <> 1 OR b <> 2)").isEmpty()


def test_smote_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 7)
    keys = ["spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"]
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "false")
    try:
        rows = spark.range(400).select(
            F.when(F.col("id") > 30, F.col("id") % 50).alias("id"), (F.col("id") % 20 == 0).cast("int").alias("label"), F.rand(1).alias("a"), F.rand(2).alias("b")
        )
        found = []
        for parts in (3, 64):
            spark.conf.set(keys[1], str(parts))
            got = T.smote(rows, ["a", "b"], "id").where("synthetic").select(F.round("a", 9), F.round("b", 9))
            found.append(sorted(tuple(r) for r in got.collect()))
        assert len(found[0]) == 360 and found[0] == found[1]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_smote_mixes_with_the_nearest(spark):
    """Every synthetic row lies between a rare row and one of its five nearest rare rows; missing features stay missing."""
    rng = np.random.default_rng(7)
    z = np.concatenate((rng.normal(size=(40, 3)), rng.normal(size=(300, 3)) + 5))
    rows = [(i, int(i < 40), *map(float, v)) for i, v in enumerate(z)]
    got = T.smote(spark.createDataFrame(rows, "id INT, label INT, a DOUBLE, b DOUBLE, c DOUBLE"), ["a", "b", "c"], "id").where("synthetic").select("a", "b", "c").toPandas().to_numpy()
    rare = z[:40]
    unit = (rare - rare.mean(axis=0)) / rare.std(axis=0)
    gap = ((unit[:, None] - unit[None]) ** 2).sum(axis=2)
    np.fill_diagonal(gap, np.inf)
    ends = [(rare[i], rare[j]) for i in range(40) for j in np.argsort(gap[i])[:5]]

    def between(v):
        return any(abs(np.linalg.norm(v - p) + np.linalg.norm(q - v) - np.linalg.norm(q - p)) < 1e-9 for p, q in ends)

    assert len(got) == 260 and all(between(v) for v in got)
    holes = spark.createDataFrame([(i, int(i < 5), None, float(i)) for i in range(20)], "id INT, label INT, a DOUBLE, b DOUBLE")
    made = T.smote(holes, ["a", "b"], "id").where("synthetic")
    assert made.count() == 10 and made.where("a IS NOT NULL OR b NOT BETWEEN 0 AND 4").isEmpty()
