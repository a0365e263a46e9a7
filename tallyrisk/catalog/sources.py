"""Sources and sinks: data is written below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrisk.catalog.base import query, table
from tallyrisk.catalog.standins import cte, log_table, standin
from tallyrisk.session import scratch_path
from tallyrisk.sources import batches as B, event_log as L, tables as T
from tallyrisk.sources.schemas import RAW_TABLES

LOGS = cte("logs")


@query("src_scan_cap", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10000", "o_totalprice")
def src_scan_cap(spark, sf):
    path = scratch_path(spark, "orders-csv")
    T.write_csv(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path)
    return T.read_csv(spark, path, "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE", cap=10000, order="o_orderkey")


@query(
    "src_optional",
    f"""{cte("bureau", "bureau_balance")} SELECT SK_ID_CURR, count(*) AS N_CREDITS, sum(AMT_CREDIT_SUM) AS CREDIT, (SELECT count(*) FROM bureau_balance) AS N_MONTHS FROM bureau GROUP BY 1""",
    "CREDIT",
)
def src_optional(spark, sf):
    folder = scratch_path(spark, "raw")
    for name in ("bureau", "bureau_balance"):
        T.write_csv(standin(spark, sf, name), f"{folder}/{name}.csv")
    files = {n: f"{n}.csv" for n in ("bureau", "bureau_balance", "credit_card_balance")}
    found = T.read_raw_csv(spark, folder, files, RAW_TABLES, needed=["bureau"])
    assert "credit_card_balance" not in found
    per_client = found["bureau"].groupBy("SK_ID_CURR").agg(F.count(F.lit(1)).alias("N_CREDITS"), F.sum("AMT_CREDIT_SUM").alias("CREDIT"))
    return per_client.withColumn("N_MONTHS", found["bureau_balance"].agg(F.count(F.lit(1))).scalar())


_LOG_COLUMNS = """SELECT ts AS timestamp, endpoint, status_code, latency_ms, sha256(json(body)::VARCHAR) AS payload_hash, CAST(json_extract(body, '$.k') AS DOUBLE) AS k, score, decision FROM logs"""


def _flat(logs, *more):
    return logs.select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "endpoint", "status_code", "latency_ms", "payload_hash", F.col("input_features")["k"].alias("k"), "score", "decision", *more
    )


@query("src_event_log", f"{LOGS} {_LOG_COLUMNS}", "latency_ms k score")
def src_event_log(spark, sf):
    path = scratch_path(spark, "log-json")
    L.append_json(log_table(spark, sf), path)
    return _flat(L.read_json_log(spark, path))


@query(
    "csv_pair_to_features",
    """SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN 111.5 ELSE c_acctbal END AS balance, coalesce(TRY_CAST(c_nationkey::VARCHAR AS DOUBLE), 0.0) AS nation, 7.0::DOUBLE AS segment, 0.0::DOUBLE AS absent FROM customer""",
    "balance nation segment absent",
)
def csv_pair_to_features(spark, sf):
    balance = F.when(F.col("c_nationkey") % 4 == 0, F.lit("")).otherwise(F.col("c_acctbal").cast("string"))
    rows = table(spark, sf, "customer").select(
        "c_custkey",
        F.lit('note,balance,nation,segment').alias("columns_csv"),
        F.concat(F.lit('"a, b"'), F.lit(","), balance, F.lit(","), F.col("c_nationkey").cast("string"), F.lit(","), F.col("c_mktsegment")).alias("row_csv"),
    )
    return T.csv_pair_features(rows, ["balance", "nation", "segment", "absent"], {"balance": 111.5, "segment": 7.0})


@query(
    "log_append_defaults",
    f"""{LOGS} SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN NULL ELSE ts END, TIMESTAMP '2024-06-01') AS timestamp, CAST(CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END AS INT) AS n_keys,
    CAST(CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END AS INT) AS n_features, decision FROM logs""",
)
def log_append_defaults(spark, sf):
    events = log_table(spark, sf).withColumns(
        {
            "timestamp": F.when(F.col("id") % 3 != 0, F.col("timestamp")),
            "payload_keys": F.when(F.col("id") % 2 != 0, F.col("payload_keys")),
            "input_features": F.when(F.col("id") % 5 != 0, F.col("input_features")),
        }
    )
    ready = L.with_defaults(events)
    # The default time is the time of the run; it is shown as a fixed one here.
    shown = F.when(F.col("timestamp") > F.lit("2024-06-01").cast("timestamp"), F.lit("2024-06-01").cast("timestamp")).otherwise(F.col("timestamp"))
    return ready.select("id", shown.cast("timestamp_ntz").alias("timestamp"), F.size("payload_keys").alias("n_keys"), F.size("input_features").alias("n_features"), "decision")


@query(
    "log_backfill_clean",
    f"""{LOGS} {_LOG_COLUMNS} WHERE id % 10 <> 0""",
    "latency_ms k score",
)
def log_backfill_clean(spark, sf):
    logs = log_table(spark, sf)
    text = F.to_json(F.struct(*logs.columns), L.JSON_OPTIONS)
    # Every tenth line is blank or a JSON value that is no object.
    line = F.when(F.col("id") % 20 == 0, F.lit("  ")).when(F.col("id") % 10 == 0, F.concat(F.lit("["), F.col("id").cast("string"), F.lit("]"))).otherwise(text)
    path = scratch_path(spark, "log-lines")
    logs.select(line.alias("value")).write.text(path)
    return _flat(L.clean_lines(spark.read.text(path)))


@query(
    "log_backfill",
    f"""{LOGS}, once AS ({_LOG_COLUMNS} WHERE id % 10 <> 0) SELECT *, CASE WHEN status_code >= 400 THEN 2 ELSE 1 END::BIGINT AS batch, 1::BIGINT AS same_id FROM once""",
    "latency_ms k score",
)
def log_backfill(spark, sf):
    """Two files of JSON lines become two batches; the first is loaded twice, as after an attempt that was killed."""
    logs = log_table(spark, sf)
    text = F.to_json(F.struct(*logs.columns), L.JSON_OPTIONS)
    line = F.when(F.col("id") % 20 == 0, F.lit("  ")).when(F.col("id") % 10 == 0, F.lit("[1]")).otherwise(text)
    path = scratch_path(spark, "log-batches")
    for batch, part in ((1, ~F.coalesce(F.col("status_code") >= 400, F.lit(False))), (2, F.col("status_code") >= 400)):
        lines = scratch_path(spark, "log-lines")
        logs.where(part).select(line.alias("value")).write.text(lines)
        for _ in range(3 - batch):
            B.backfill_lines(spark, lines, path, batch)
    stored = B.read_events(spark, path)
    copies = stored.groupBy("id").agg(F.count(F.lit(1)).alias("same_id"))
    joined = stored.join(copies, "id")
    return _flat(joined, "batch", "same_id")
