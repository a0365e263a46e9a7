"""The supplied tables seen as credit tables, event log and requests.

The mapping is written once as plain expressions that Spark and the SQL side both understand;
``DAYS(x)`` stands for the days from the reference date to x (0 or negative)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyrisk.catalog.base import table
from tallyrisk.functions.json_body import with_body_columns

REFERENCE_DAY = "2001-08-02"

_PAID = "lineitem JOIN orders ON l_orderkey = o_orderkey"

# name -> (source, column -> expression)
STANDINS: dict[str, tuple[str, dict[str, str]]] = {
    "application": (
        "customer",
        {
            "SK_ID_CURR": "c_custkey",
            "TARGET": "CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL WHEN c_acctbal < 0 THEN 1 ELSE 0 END",
            "CODE_GENDER": "CASE WHEN c_nationkey = 24 THEN 'XNA' WHEN c_nationkey = 23 THEN NULL WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END",
            "FLAG_OWN_CAR": "CASE WHEN c_nationkey % 3 = 0 THEN 'N' ELSE 'Y' END",
            "AMT_INCOME_TOTAL": "c_acctbal * 2100",
            "AMT_CREDIT": "abs(c_acctbal) * 20",
            "AMT_ANNUITY": "CAST(floor(abs(c_acctbal) / 1000) * 12000 AS DOUBLE)",
            "AMT_GOODS_PRICE": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE abs(c_acctbal) * 18 END",
            "CNT_FAM_MEMBERS": "CAST(c_custkey % 5 AS DOUBLE)",
            "DAYS_BIRTH": "CAST(-(7000 + (c_custkey * 37) % 20000) AS DOUBLE)",
            "DAYS_EMPLOYED": "CAST(CASE WHEN c_nationkey % 6 = 0 THEN 365243 ELSE -((c_custkey * 13) % 9000) END AS DOUBLE)",
            "DAYS_ID_PUBLISH": "CAST(-((c_custkey * 11) % 5000) AS DOUBLE)",
            "DAYS_LAST_PHONE_CHANGE": "CAST(-((c_custkey * 7) % 4) AS DOUBLE)",
            "OWN_CAR_AGE": "CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 30 AS DOUBLE) END",
            "EXT_SOURCE_1": "CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 97 AS DOUBLE) / 97 END",
            "EXT_SOURCE_2": "CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE CAST((c_custkey * 3) % 89 AS DOUBLE) / 89 END",
            "EXT_SOURCE_3": "CASE WHEN c_nationkey % 8 = 0 THEN NULL ELSE CAST((c_custkey * 5) % 83 AS DOUBLE) / 83 END",
            "FLAG_DOCUMENT_2": "CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS INT)",
            "FLAG_DOCUMENT_3": "CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS INT)",
            "FLAG_DOCUMENT_4": "CAST(CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS INT)",
            "FLAG_DOCUMENT_5": "CAST(CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS INT)",
            "FLAG_DOCUMENT_6": "CAST(CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS INT)",
            "ORGANIZATION_TYPE": "c_mktsegment",
            "OCCUPATION_TYPE": "CASE WHEN c_nationkey = 7 THEN NULL WHEN c_nationkey < 10 THEN 'Managers' ELSE 'Laborers' END",
        },
    ),
    "bureau": (
        "orders",
        {
            "SK_ID_CURR": "o_custkey",
            "SK_ID_BUREAU": "o_orderkey",
            "CREDIT_ACTIVE": "CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Active' ELSE 'Sold' END",
            "CREDIT_TYPE": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Consumer credit' WHEN '2-HIGH' THEN 'Credit card' WHEN '3-MEDIUM' THEN 'Mortgage' WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'Microloan' END",
            "DAYS_CREDIT": "CAST(DAYS(o_orderdate) AS DOUBLE)",
            "DAYS_CREDIT_ENDDATE": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(DAYS(o_orderdate) + 30 * (o_orderkey % 40) AS DOUBLE) END",
            "DAYS_ENDDATE_FACT": "CASE WHEN o_orderstatus = 'F' THEN CAST(DAYS(o_orderdate) + o_orderkey % 300 AS DOUBLE) ELSE NULL END",
            "DAYS_CREDIT_UPDATE": "CAST(DAYS(o_orderdate) + o_orderkey % 50 AS DOUBLE)",
            "CREDIT_DAY_OVERDUE": "CAST(CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey % 60 ELSE 0 END AS DOUBLE)",
            "AMT_CREDIT_MAX_OVERDUE": "CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice / 64 ELSE NULL END",
            "AMT_CREDIT_SUM": "o_totalprice",
            "AMT_CREDIT_SUM_DEBT": "CASE WHEN o_orderstatus = 'F' THEN 0 * o_totalprice WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice / 2 END",
            "AMT_CREDIT_SUM_OVERDUE": "CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice / 32 ELSE 0 * o_totalprice END",
            "AMT_CREDIT_SUM_LIMIT": "CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice / 4 ELSE NULL END",
            "AMT_ANNUITY": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / 16 END",
            "CNT_CREDIT_PROLONG": "CAST(o_orderkey % 3 AS DOUBLE)",
        },
    ),
    "bureau_balance": (
        "lineitem",
        {
            "SK_ID_BUREAU": "l_orderkey",
            "MONTHS_BALANCE": "-l_linenumber",
            "STATUS": "CASE WHEN l_quantity > 48 THEN '1' WHEN l_quantity > 46 THEN '2' WHEN l_returnflag = 'R' THEN 'C' WHEN l_returnflag = 'N' THEN '0' ELSE 'X' END",
        },
    ),
    "previous_application": (
        "orders",
        {
            "SK_ID_PREV": "o_orderkey",
            "SK_ID_CURR": "o_custkey",
            "NAME_CONTRACT_STATUS": "CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Refused' ELSE 'Canceled' END",
            "NAME_CONTRACT_TYPE": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Cash loans' WHEN '2-HIGH' THEN 'Consumer loans' WHEN '3-MEDIUM' THEN NULL ELSE 'Revolving loans' END",
            "AMT_APPLICATION": "o_totalprice",
            "AMT_CREDIT": "CASE WHEN o_orderkey % 10 = 0 THEN 0 * o_totalprice ELSE o_totalprice * 0.875 END",
            "AMT_ANNUITY": "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 16 END",
            "AMT_DOWN_PAYMENT": "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice / 8 END",
            "AMT_GOODS_PRICE": "o_totalprice * 0.75",
            "RATE_DOWN_PAYMENT": "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_orderkey % 17 AS DOUBLE) / 32 END",
            "HOUR_APPR_PROCESS_START": "CAST(o_orderkey % 24 AS DOUBLE)",
            "CNT_PAYMENT": "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(6 + o_orderkey % 30 AS DOUBLE) END",
            "DAYS_DECISION": "CAST(DAYS(o_orderdate) AS DOUBLE)",
            "DAYS_FIRST_DRAWING": "CAST(365243 AS DOUBLE)",
            "DAYS_FIRST_DUE": "CAST(DAYS(o_orderdate) + 30 AS DOUBLE)",
            "DAYS_LAST_DUE_1ST_VERSION": "CAST(DAYS(o_orderdate) + 300 AS DOUBLE)",
            "DAYS_LAST_DUE": "CAST(CASE WHEN o_orderkey % 5 = 0 THEN 365243 ELSE DAYS(o_orderdate) + 200 END AS DOUBLE)",
            "DAYS_TERMINATION": "CAST(CASE WHEN o_orderkey % 5 = 0 THEN 365243 ELSE DAYS(o_orderdate) + 210 END AS DOUBLE)",
        },
    ),
    "installments_payments": (
        _PAID,
        {
            "SK_ID_PREV": "l_orderkey",
            "SK_ID_CURR": "o_custkey",
            "NUM_INSTALMENT_VERSION": "l_quantity - 10 * floor(l_quantity / 10)",
            "NUM_INSTALMENT_NUMBER": "l_linenumber",
            "DAYS_INSTALMENT": "CAST(DAYS(o_orderdate) + 12 * l_linenumber AS DOUBLE)",
            "DAYS_ENTRY_PAYMENT": "CASE WHEN l_partkey % 20 = 0 THEN NULL ELSE CAST(DAYS(l_shipdate) AS DOUBLE) END",
            "AMT_INSTALMENT": "CASE WHEN l_partkey % 25 = 1 THEN 0 * l_extendedprice ELSE l_extendedprice END",
            "AMT_PAYMENT": "CASE WHEN l_partkey % 20 = 0 THEN NULL ELSE l_extendedprice * (1 - l_discount + l_tax) END",
        },
    ),
    "pos_cash_balance": (
        _PAID,
        {
            "SK_ID_PREV": "l_orderkey",
            "SK_ID_CURR": "o_custkey",
            "MONTHS_BALANCE": "-CAST(l_linenumber + o_orderkey % 30 AS INT)",
            "SK_DPD": "CAST(CASE WHEN l_quantity > 40 THEN l_quantity - 40 ELSE 0 END AS DOUBLE)",
            "SK_DPD_DEF": "CAST(CASE WHEN l_quantity > 45 THEN l_quantity - 45 ELSE 0 END AS DOUBLE)",
            "NAME_CONTRACT_STATUS": "CASE WHEN l_returnflag = 'R' THEN 'Completed' WHEN l_returnflag = 'N' THEN 'Active' ELSE NULL END",
        },
    ),
    "credit_card_balance": (
        _PAID,
        {
            "SK_ID_PREV": "l_orderkey",
            "SK_ID_CURR": "o_custkey",
            "MONTHS_BALANCE": "-CAST(l_linenumber + 7 * (o_orderkey % 9) AS INT)",
            "AMT_BALANCE": "l_extendedprice",
            "AMT_CREDIT_LIMIT_ACTUAL": "CASE WHEN o_orderkey % 11 = 0 THEN 0 * l_extendedprice ELSE floor(o_totalprice / 1000) * 1000 END",
            "AMT_DRAWINGS_ATM_CURRENT": "CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_extendedprice / 8 END",
            "AMT_DRAWINGS_CURRENT": "l_extendedprice / 4",
            "AMT_INST_MIN_REGULARITY": "l_quantity * 64 - 64",
            "AMT_PAYMENT_CURRENT": "CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_extendedprice / 2 END",
            "AMT_PAYMENT_TOTAL_CURRENT": "l_extendedprice / 2",
            "AMT_TOTAL_RECEIVABLE": "l_extendedprice * 0.75",
            "CNT_DRAWINGS_CURRENT": "l_quantity",
            "SK_DPD": "CAST(CASE WHEN l_quantity > 45 THEN l_quantity - 45 ELSE 0 END AS DOUBLE)",
            "SK_DPD_DEF": "CAST(CASE WHEN l_quantity > 48 THEN l_quantity - 48 ELSE 0 END AS DOUBLE)",
            "NAME_CONTRACT_STATUS": "CASE WHEN l_returnflag = 'R' THEN 'Completed' ELSE 'Active' END",
        },
    ),
    # One scoring request per order line; some fields are out of range.
    "requests": (
        "lineitem",
        {
            "request_id": "l_orderkey * 8 + l_linenumber",
            "l_shipdate": "l_shipdate",
            "age": "CAST(l_quantity * 3 AS INT)",
            "income": "l_extendedprice",
            "credit_amount": "l_extendedprice * (1 - l_discount) / 4",
            "annuity": "l_extendedprice * l_tax / 2",
            "employment_years": "CAST(l_linenumber AS DOUBLE)",
            "family_members": "CAST(l_linenumber - 1 AS DOUBLE)",
        },
    ),
    # One log entry per event.
    "logs": (
        "events",
        {
            "id": "event_id",
            "ts": "ts",
            "endpoint": "'/predict'",
            "method": "'POST'",
            "status_code": "CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS INT)",
            "latency_ms": "value",
            "inference_ms": "value / 4",
            "body": "props",
            "score": "CASE WHEN event_type = 'error' THEN NULL ELSE value / (value + 50) END",
            "decision": "CASE WHEN event_type = 'error' THEN NULL WHEN value / (value + 50) >= 0.4889 THEN 'REJECT' ELSE 'ACCEPT' END",
        },
    ),
    # Scores with labels, one per event; scores have many ties.
    "scored": (
        "events",
        {
            "id": "event_id",
            "y": "CAST(CASE WHEN event_type = 'error' OR (event_type = 'click' AND value > 30) THEN 1 ELSE 0 END AS INT)",
            "score": "floor(value / (value + 20) * 512) / 512",
            "fold": "CAST(event_id % 5 AS INT)",
        },
    ),
}

_DAYS = re.compile(r"DAYS\((\w+)\)")


def _spark_expr(expr: str) -> str:
    return _DAYS.sub(rf"datediff(CAST(\1 AS DATE), DATE'{REFERENCE_DAY}')", expr)


def _duck_expr(expr: str) -> str:
    return _DAYS.sub(rf"date_diff('day', DATE '{REFERENCE_DAY}', CAST(\1 AS DATE))", expr)


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = STANDINS[name]
    if source == _PAID:
        rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    else:
        rows = table(spark, sf_dir, source)
    return rows.selectExpr(*[f"{_spark_expr(e)} AS `{c}`" for c, e in columns.items()])


def cte(*names: str) -> str:
    """``WITH`` clause that defines the stand-ins for the SQL side."""
    parts = []
    for name in names:
        source, columns = STANDINS[name]
        cells = ", ".join(f'{_duck_expr(e)} AS "{c}"' for c, e in columns.items())
        parts.append(f"{name} AS (SELECT {cells} FROM {source})")
    return "WITH " + ", ".join(parts)


def log_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log records with the full log schema."""
    logs = with_body_columns(standin(spark, sf_dir, "logs"))
    return logs.select(
        "id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        "endpoint",
        "method",
        "status_code",
        "latency_ms",
        "inference_ms",
        "payload_hash",
        "payload_keys",
        "input_features",
        "score",
        "decision",
        F.lit("demo-0.1.0").alias("model_version"),
        F.when(F.col("status_code") >= 400, F.lit("Prediction failed")).alias("error"),
    )


def plain_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log records without the parsed body: only the columns a query uses are read."""
    return standin(spark, sf_dir, "logs").withColumn("timestamp", F.col("ts").cast("timestamp")).drop("ts")
