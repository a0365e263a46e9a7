"""The log and the run history by batch: repeats, attempts that were killed, ids, malformed lines."""

import os

import pytest
from pyspark.sql import functions as F

from tallyrisk.sources import batches as B
from tallyrisk.streaming import jobs


def events_of(spark, n, first=0):
    rows = spark.range(first, first + n, numPartitions=3)
    return rows.selectExpr(
        "timestamp_seconds(id) AS timestamp", "'/predict' AS endpoint", "'POST' AS method", "200 AS status_code", "CAST(id AS DOUBLE) AS latency_ms",
        "1D AS inference_ms", "'same' AS payload_hash", "array('k') AS payload_keys", "map('k', 1D) AS input_features", "0.5D AS score", "'OK' AS decision",
        "'v1' AS model_version", "CAST(NULL AS STRING) AS error",
    )


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "log")
    assert B.read_events(spark, path).count() == 0
    assert B.write_events(events_of(spark, 50), path, 1) == 50
    assert B.write_events(events_of(spark, 20, 100), path, 2) == 20
    assert B.write_events(events_of(spark, 50), path, 1) == 50
    stored = B.read_events(spark, path)
    assert [tuple(r) for r in stored.groupBy("batch").count().orderBy("batch").collect()] == [(1, 50), (2, 20)]
    ids = [r["id"] for r in stored.select("id").collect()]
    assert sorted(ids) == [(1 << B.ROW_BITS) + i for i in range(50)] + [(2 << B.ROW_BITS) + i for i in range(20)]
    assert B.write_events(events_of(spark, 0), path, 2) == 0 and B.read_events(spark, path).count() == 50


def test_a_killed_attempt_shows_nothing(spark, tmp_path):
    """What an attempt leaves behind when it is ended before its job: files in the writer's own folder."""
    path = str(tmp_path / "log")
    B.write_events(events_of(spark, 5), path, 1)
    left = tmp_path / "log" / "batch=2" / "_temporary" / "0" / "task_0"
    os.makedirs(left)
    events_of(spark, 9).withColumn("id", F.lit(1)).write.parquet(str(left / "part"))
    assert B.read_events(spark, path).count() == 5
    B.write_events(events_of(spark, 9), path, 2)
    assert B.read_events(spark, path).count() == 14 and not os.path.exists(left)


def test_an_attempt_that_fails_midway_is_repeated(spark, tmp_path):
    path = str(tmp_path / "log")
    B.write_events(events_of(spark, 5), path, 1)
    faulty = events_of(spark, 40).withColumn("score", F.when(F.col("latency_ms") > 30, F.raise_error(F.lit("lost"))).otherwise(F.col("score")))
    with pytest.raises(Exception, match="lost"):
        B.write_events(faulty, path, 2)
    assert B.read_events(spark, path).count() == 5
    B.write_events(events_of(spark, 40), path, 2)
    assert B.read_events(spark, path).select("id").distinct().count() == 45


def test_equal_rows_get_ids_of_their_own(spark, tmp_path):
    same = events_of(spark, 1).crossJoin(spark.range(300)).drop("id").repartition(5)
    path = str(tmp_path / "log")
    assert B.write_events(same, path, 3) == 300
    assert B.read_events(spark, path).select("id").distinct().count() == 300


def test_lines(spark, tmp_path):
    source, broken, path = (str(tmp_path / x) for x in ("lines", "broken", "log"))
    good = ['{"endpoint": "/a", "latency_ms": 1.5}', "  ", "[1]", '{"endpoint": "/b"}']
    spark.createDataFrame([(x,) for x in good], "value string").write.text(source)
    spark.createDataFrame([(x,) for x in [*good, '{"endpoint": ']], "value string").write.text(broken)
    assert B.backfill_lines(spark, source, path, 1) == 2 == B.backfill_lines(spark, source, path, 1)
    assert sorted(r["endpoint"] for r in B.read_events(spark, path).collect()) == ["/a", "/b"]
    with pytest.raises(ValueError, match="malformed"):
        B.backfill_lines(spark, broken, path, 2)
    assert B.read_events(spark, path).count() == 2
    with pytest.raises(ValueError, match="range"):
        B.backfill_lines(spark, source, path, -1)


def test_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    run = spark.sql("SELECT struct(0.5D AS error_rate) AS operational, CAST(NULL AS STRUCT<enabled: BOOLEAN>) AS drift")
    assert B.read_runs(spark, path).count() == 0
    for batch in (4, 4, 5):
        assert B.write_run(run, path, batch) == 1
    assert sorted((r["id"], r["operational"], r["drift"]) for r in B.read_runs(spark, path).collect()) == [(4, '{"error_rate":0.5}', "{}"), (5, '{"error_rate":0.5}', "{}")]


def test_a_repeated_micro_batch_leaves_one_run(spark, tmp_path):
    """A stream that starts anew without its checkpoint repeats its batches under the same numbers."""
    source, log, runs = (str(tmp_path / x) for x in ("in", "log", "runs"))
    events = events_of(spark, 30).withColumn("id", F.monotonically_increasing_id())
    events.write.parquet(source)
    for attempt in range(2):
        stream = jobs.log_and_watch(spark.readStream.schema(events.schema).parquet(source), log, str(tmp_path / f"check{attempt}"), runs_path=runs)
        assert stream.awaitTermination(60)
    assert spark.read.parquet(log).count() == 30
    stored = B.read_runs(spark, runs).collect()
    assert [r["id"] for r in stored] == [0] and '"n_requests":30' in stored[0]["operational"]
