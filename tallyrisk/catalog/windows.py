"""Ordered questions per key."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrisk.catalog.base import query, table
from tallyrisk.catalog.standins import cte, standin
from tallyrisk.operators import windows as W
from tallyrisk.plans.features import instalment_rows, newest_instalment

_NEWEST_SQL = "DAYS_INSTALMENT DESC NULLS LAST, SK_ID_PREV DESC, NUM_INSTALMENT_NUMBER DESC, DAYS_ENTRY_PAYMENT DESC NULLS LAST, AMT_INSTALMENT DESC NULLS LAST, AMT_PAYMENT DESC NULLS LAST"


@query(
    "win_last_k",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, CAST(rn AS INT) AS rn FROM
    (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 3""",
    "o_totalprice",
)
def win_last_k(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return W.last_k(orders, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 3)


@query(
    "win_last_non_null",
    f"""{cte("bureau")} SELECT SK_ID_CURR, arg_max(AMT_CREDIT_MAX_OVERDUE, DAYS_CREDIT * 10000000 + SK_ID_BUREAU) FILTER (WHERE AMT_CREDIT_MAX_OVERDUE IS NOT NULL) AS last_overdue
    FROM bureau GROUP BY 1""",
    "last_overdue",
)
def win_last_non_null(spark, sf):
    return W.last_non_null(standin(spark, sf, "bureau"), "SK_ID_CURR", "AMT_CREDIT_MAX_OVERDUE", F.struct("DAYS_CREDIT", "SK_ID_BUREAU"), "last_overdue")


PERIODS = [12, 24, 60, 120]


def trend_items(values, prefix="INS_"):
    items, names = [], []
    for v in values:
        for p in PERIODS:
            name = f"{prefix}{v}_TREND_{p}"
            items.append(f'CASE WHEN count({v}) FILTER (WHERE rn <= {p}) > 1 THEN regr_slope({v}, -rn) FILTER (WHERE rn <= {p}) END AS "{name}"')
            names.append(name)
    return items, names


_ITEMS, _NAMES = trend_items(["DPD", "PAID_OVER_AMOUNT"])
MEASURED = """measured AS (SELECT *, CASE WHEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT IS NOT NULL THEN greatest(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT, 0) END AS DPD,
    coalesce(sum(AMT_PAYMENT) OVER (PARTITION BY SK_ID_PREV, NUM_INSTALMENT_NUMBER), 0) - AMT_INSTALMENT AS PAID_OVER_AMOUNT FROM installments_payments)"""


@query(
    "win_trend_slope",
    f"""{cte("installments_payments")}, {MEASURED}, r AS (SELECT *, row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY {_NEWEST_SQL}) AS rn FROM measured)
    SELECT SK_ID_CURR, {', '.join(_ITEMS)} FROM r GROUP BY 1""",
    _NAMES,
)
def win_trend_slope(spark, sf):
    rows = instalment_rows(standin(spark, sf, "installments_payments"))
    return W.trend_slopes(rows, "SK_ID_CURR", newest_instalment(), ["DPD", "PAID_OVER_AMOUNT"], PERIODS, "INS_")
