"""Aggregates, category shares, slices, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrisk.catalog.base import query, table
from tallyrisk.catalog.standins import cte, plain_logs, standin
from tallyrisk.operators import aggregate as A
from tallyrisk.operators.running import column_medians

# SQL text of one aggregate, optionally over a row subset.
_FUNCTIONS = {
    "min": "min({c})",
    "max": "max({c})",
    "mean": "avg({c})",
    "var": "var_samp({c})",
    "std": "stddev_samp({c})",
    "count": "count({c})",
    "size": "count(*)",
    "nunique": "count(DISTINCT {c})",
    "sum": "sum({c})",
}


def agg_sql(column: str, stat: str, name: str, where: str | None = None) -> str:
    text = _FUNCTIONS[stat].format(c=f'"{column}"')
    if where:
        text += f" FILTER (WHERE {where})"
    if stat == "sum":
        text = f"coalesce({text}, 0)"
    if where:
        text = f"CASE WHEN count(*) FILTER (WHERE {where}) > 0 THEN {text} END"
    return f'{text} AS "{name}"'


def spec_sql(spec, prefix: str, where: str | None = None) -> tuple[list[str], list[str]]:
    """SELECT items and the names of the floating-point ones."""
    items, doubles = [], []
    for column, stats in spec.items():
        for stat in stats:
            name = A.out_name(prefix, column, stat)
            items.append(agg_sql(column, stat, name, where))
            if stat not in ("count", "size", "nunique"):
                doubles.append(name)
    return items, doubles


def share_sql(vocab, prefix: str, where: str | None = None, with_null: bool = True) -> tuple[list[str], list[str]]:
    items, names = [], []
    for column, values in vocab.items():
        for value in [*values, *([None] if with_null else [])]:
            name = A.out_name(prefix, f"{column}_{'nan' if value is None else value}", "mean")
            literal = "NULL" if value is None else f"'{value}'"
            text = f'avg(CASE WHEN "{column}" IS NOT DISTINCT FROM {literal} THEN 1.0 ELSE 0.0 END)'
            items.append(f'{text}{f" FILTER (WHERE {where})" if where else ""} AS "{name}"')
            names.append(name)
    return items, names


_LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_ALL = {c: ["mean", "std", "min", "max", "sum"] for c in _LINE_NUMBERS}
_ITEMS, _NAMES = spec_sql(_ALL, "LI_")


@query("agg_numeric_all", f"SELECT l_suppkey, {', '.join(_ITEMS)}, count(*) AS LI_COUNT FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1", _NAMES)
def agg_numeric_all(spark, sf):
    return A.aggregate_all_numeric(table(spark, sf, "lineitem").select("l_suppkey", *_LINE_NUMBERS), "l_suppkey", "LI_")


_ITEMS, _NAMES = spec_sql({c: ["min", "max", "mean", "sum", "var"] for c in _LINE_NUMBERS}, "CC_")


@query("agg_numeric_var", f"SELECT l_orderkey, {', '.join(_ITEMS)}, count(*) AS CC_COUNT FROM lineitem GROUP BY 1", _NAMES)
def agg_numeric_var(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", *_LINE_NUMBERS)
    return A.aggregate_all_numeric(rows, "l_orderkey", "CC_", ["min", "max", "mean", "sum", "var"])


_MAP = {"o_totalprice": ["min", "max", "mean", "sum", "var"], "o_orderkey": ["count"], "o_orderpriority": ["nunique"]}
_ITEMS, _NAMES = spec_sql(_MAP, "ORD_")


@query("agg_map_driven", f"SELECT o_custkey, {', '.join(_ITEMS)} FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1", _NAMES)
def agg_map_driven(spark, sf):
    return A.aggregate_by(table(spark, sf, "orders"), "o_custkey", _MAP, "ORD_")


_VOCAB = {"DEBT": ["min", "max", "mean", "sum", "var", "std", "count", "size", "nunique"]}
_ITEMS, _NAMES = spec_sql(_VOCAB, "")


@query(
    "agg_stat_vocab",
    f"""WITH o AS (SELECT o_custkey, o_orderdate, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS "DEBT" FROM orders)
    SELECT o_custkey, {', '.join(_ITEMS)}, quantile_cont("DEBT", 0.5) AS DEBT_MEDIAN,
    arg_min("DEBT", (epoch(o_orderdate) * 10000000 + o_orderkey)) FILTER (WHERE "DEBT" IS NOT NULL) AS DEBT_FIRST,
    arg_max("DEBT", (epoch(o_orderdate) * 10000000 + o_orderkey)) FILTER (WHERE "DEBT" IS NOT NULL) AS DEBT_LAST FROM o GROUP BY 1""",
    [*_NAMES, "DEBT_MEDIAN", "DEBT_FIRST", "DEBT_LAST"],
)
def agg_stat_vocab(spark, sf):
    rows = table(spark, sf, "orders").withColumn("DEBT", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")))
    spec = {"DEBT": [*_VOCAB["DEBT"], "median", "first", "last"]}
    return A.aggregate_by(rows, "o_custkey", spec, order=F.struct("o_orderdate", "o_orderkey"))


_SHARES = {"CREDIT_TYPE": ["Consumer credit", "Credit card", "Microloan", "Mortgage"], "CREDIT_ACTIVE": ["Active", "Closed", "Sold"]}
_ITEMS, _NAMES = share_sql(_SHARES, "B_")


@query("agg_category_share", f"{cte('bureau')} SELECT SK_ID_CURR, {', '.join(_ITEMS)} FROM bureau GROUP BY 1", _NAMES)
def agg_category_share(spark, sf):
    bureau = standin(spark, sf, "bureau")
    vocab = A.vocabularies(bureau, ["CREDIT_TYPE", "CREDIT_ACTIVE"])
    return A.category_shares(bureau, "SK_ID_CURR", vocab, "B_")


_BAL = {"MONTHS_BALANCE": ["min", "max", "mean", "size"]}
_BAL_ITEMS, _BAL_NAMES = spec_sql(_BAL, "BB_")
_ST_ITEMS, _ST_NAMES = share_sql({"STATUS": ["0", "1", "2", "C", "X"]}, "BB_", with_null=False)


@query(
    "agg_two_level",
    f"""{cte("bureau", "bureau_balance")}, bb AS (SELECT SK_ID_BUREAU, {', '.join(_BAL_ITEMS + _ST_ITEMS)} FROM bureau_balance GROUP BY 1)
    SELECT SK_ID_CURR, count(*) AS N_CREDITS, min(BB_MONTHS_BALANCE_MIN) AS MONTHS_MIN, CAST(sum(BB_MONTHS_BALANCE_SIZE) AS BIGINT) AS MONTHS_SIZE,
    avg(BB_MONTHS_BALANCE_MEAN) AS MONTHS_MEAN, {', '.join(f'avg({n}) AS {n}' for n in _ST_NAMES)}
    FROM bureau LEFT JOIN bb USING (SK_ID_BUREAU) GROUP BY 1""",
    ["MONTHS_MEAN", *_ST_NAMES],
)
def agg_two_level(spark, sf):
    from tallyrisk.plans.features import month_aggregates

    months = month_aggregates(standin(spark, sf, "bureau_balance"))
    rows = standin(spark, sf, "bureau").select("SK_ID_CURR", "SK_ID_BUREAU").join(months, "SK_ID_BUREAU", "left")
    return rows.groupBy("SK_ID_CURR").agg(
        F.count(F.lit(1)).alias("N_CREDITS"),
        F.min("BB_MONTHS_BALANCE_MIN").alias("MONTHS_MIN"),
        F.sum("BB_MONTHS_BALANCE_SIZE").alias("MONTHS_SIZE"),
        F.avg("BB_MONTHS_BALANCE_MEAN").alias("MONTHS_MEAN"),
        *[F.avg(c).alias(c) for c in months.columns if c.startswith("BB_STATUS_")],
    )


@query(
    "agg_ratio_of_sums",
    f"""{cte("bureau")} SELECT SK_ID_CURR, coalesce(sum(AMT_CREDIT_SUM_DEBT), 0) / nullif(coalesce(sum(AMT_CREDIT_SUM), 0), 0) AS debt_over_credit,
    coalesce(sum(AMT_CREDIT_SUM_DEBT) FILTER (WHERE CREDIT_ACTIVE = 'Active'), 0) / nullif(coalesce(sum(AMT_CREDIT_SUM) FILTER (WHERE CREDIT_ACTIVE = 'Active'), 0), 0) AS active_debt_over_credit
    FROM bureau GROUP BY 1""",
    "debt_over_credit active_debt_over_credit",
)
def agg_ratio_of_sums(spark, sf):
    active = F.col("CREDIT_ACTIVE") == "Active"
    rows = standin(spark, sf, "bureau").withColumns(
        {"active_debt": F.when(active, F.col("AMT_CREDIT_SUM_DEBT")), "active_credit": F.when(active, F.col("AMT_CREDIT_SUM"))}
    )
    return rows.groupBy("SK_ID_CURR").agg(
        A.ratio_of_sums("AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM").alias("debt_over_credit"),
        A.ratio_of_sums("active_debt", "active_credit").alias("active_debt_over_credit"),
    )


_SLICE_SPEC = {"AMT_CREDIT": ["min", "max", "mean", "sum", "count"], "DAYS_DECISION": ["mean", "size"]}
_RECENT = {"PREV": "true", "PREV_LAST12M": "DAYS_DECISION >= -360", "PREV_LAST24M": "DAYS_DECISION >= -720"}
_STATUS = {"PREV": "true", "PREV_APPROVED": "NAME_CONTRACT_STATUS = 'Approved'", "PREV_CASH": "NAME_CONTRACT_TYPE = 'Cash loans'", "PREV_REFUSED": "NAME_CONTRACT_STATUS = 'Refused'"}


def _slice_sql(slices, table_name="previous_application", spec=_SLICE_SPEC):
    items, names = [], []
    for name, where in slices.items():
        more = spec_sql(spec, f"{name}_", where)
        items += more[0]
        names += more[1]
    return f"{cte(table_name)} SELECT SK_ID_CURR, {', '.join(items)} FROM {table_name} GROUP BY 1", names


_TEXT, _NAMES = _slice_sql(_RECENT)


@query("agg_recency_slices", _TEXT, _NAMES)
def agg_recency_slices(spark, sf):
    slices = {"PREV": F.lit(True), **{f"PREV_LAST{m}M": F.col("DAYS_DECISION") >= -30 * m for m in (12, 24)}}
    return A.sliced_stats(standin(spark, sf, "previous_application"), "SK_ID_CURR", slices, _SLICE_SPEC)


_TEXT, _NAMES = _slice_sql(_STATUS)


@query("agg_status_slices", _TEXT, _NAMES)
def agg_status_slices(spark, sf):
    status, kind = F.col("NAME_CONTRACT_STATUS"), F.col("NAME_CONTRACT_TYPE")
    slices = {"PREV": F.lit(True), "PREV_APPROVED": status == "Approved", "PREV_CASH": kind == "Cash loans", "PREV_REFUSED": status == "Refused"}
    return A.sliced_stats(standin(spark, sf, "previous_application"), "SK_ID_CURR", slices, _SLICE_SPEC)


_GROUP = {"AMT_CREDIT": ["mean", "std", "median"], "AMT_ANNUITY": ["mean"]}


@query(
    "group_stats_broadcast",
    f"""{cte("application")}, g AS (SELECT OCCUPATION_TYPE, avg(AMT_CREDIT) AS GRP_OCCUPATION_TYPE_AMT_CREDIT_MEAN, stddev_samp(AMT_CREDIT) AS GRP_OCCUPATION_TYPE_AMT_CREDIT_STD,
    quantile_cont(AMT_CREDIT, 0.5) AS GRP_OCCUPATION_TYPE_AMT_CREDIT_MEDIAN, avg(AMT_ANNUITY) AS GRP_OCCUPATION_TYPE_AMT_ANNUITY_MEAN FROM application WHERE OCCUPATION_TYPE IS NOT NULL GROUP BY 1)
    SELECT SK_ID_CURR, application.OCCUPATION_TYPE, g.* EXCLUDE (OCCUPATION_TYPE) FROM application LEFT JOIN g USING (OCCUPATION_TYPE)""",
    [f"GRP_OCCUPATION_TYPE_{c}" for c in ("AMT_CREDIT_MEAN", "AMT_CREDIT_STD", "AMT_CREDIT_MEDIAN", "AMT_ANNUITY_MEAN")],
)
def group_stats_broadcast(spark, sf):
    rows = standin(spark, sf, "application").select("SK_ID_CURR", "OCCUPATION_TYPE", "AMT_CREDIT", "AMT_ANNUITY")
    return A.with_group_stats(rows, ["OCCUPATION_TYPE"], _GROUP).drop("AMT_CREDIT", "AMT_ANNUITY")


@query(
    "group_stats_derived_key",
    """WITH n AS (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, o_totalprice, n_lines FROM orders LEFT JOIN n ON o_orderkey = l_orderkey),
    g AS (SELECT n_lines, avg(o_totalprice) AS LL_N_LINES_O_TOTALPRICE_MEAN FROM o WHERE n_lines IS NOT NULL GROUP BY 1)
    SELECT o_orderkey, o.n_lines, LL_N_LINES_O_TOTALPRICE_MEAN FROM o LEFT JOIN g ON o.n_lines = g.n_lines""",
    "LL_N_LINES_O_TOTALPRICE_MEAN",
)
def group_stats_derived_key(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(lines, "o_orderkey", "left")
    stats = A.with_group_stats(orders, ["n_lines"], {"o_totalprice": ["mean"]}, "LL_")
    return stats.select("o_orderkey", "n_lines", "LL_N_LINES_O_TOTALPRICE_MEAN")


@query(
    "win_transform_sum",
    f"""{cte("installments_payments")} SELECT SK_ID_PREV, NUM_INSTALMENT_NUMBER, AMT_PAYMENT,
    coalesce(sum(AMT_PAYMENT) OVER (PARTITION BY SK_ID_PREV, NUM_INSTALMENT_NUMBER), 0) AS AMT_PAYMENT_GROUPED FROM installments_payments""",
    "AMT_PAYMENT AMT_PAYMENT_GROUPED",
)
def win_transform_sum(spark, sf):
    rows = standin(spark, sf, "installments_payments").select("SK_ID_PREV", "NUM_INSTALMENT_NUMBER", "AMT_PAYMENT")
    return A.with_group_total(rows, ["SK_ID_PREV", "NUM_INSTALMENT_NUMBER"], "AMT_PAYMENT", "AMT_PAYMENT_GROUPED")


# --- profiles -----------------------------------------------------------------------------------

_PROFILE = ["SK_ID_CURR", "TARGET", "CODE_GENDER", "AMT_GOODS_PRICE", "OWN_CAR_AGE", "EXT_SOURCE_1", "OCCUPATION_TYPE"]
_KINDS = {"SK_ID_CURR": "bigint", "TARGET": "int", "CODE_GENDER": "string", "OCCUPATION_TYPE": "string"}


@query(
    "profile_nulls",
    cte("application")
    + " "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{_KINDS.get(c, 'double')}' AS data_type, count(*) AS n_rows, count(*) - count({c}) AS n_null, 100.0 * (count(*) - count({c})) / count(*) AS pct_null FROM application"
        for c in _PROFILE
    ),
    "pct_null",
)
def profile_nulls(spark, sf):
    return A.null_profile(standin(spark, sf, "application").select(*_PROFILE))


@query(
    "profile_duplicates",
    """WITH g AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
    SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM g""",
)
def profile_duplicates(spark, sf):
    return A.duplicate_profile(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query("dedupe_rows", "SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS flag FROM lineitem")
def dedupe_rows(spark, sf):
    flag = F.when(F.col("l_returnflag") != "R", F.col("l_returnflag"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", flag.alias("flag")).dropDuplicates()


@query(
    "class_balance",
    f"""{cte("application")}, g AS (SELECT TARGET AS label, count(*) AS n FROM application WHERE TARGET IS NOT NULL GROUP BY 1),
    w AS (SELECT sum(n) AS total, max(n) AS hi, min(n) AS lo, sum(n) FILTER (WHERE label = 0) AS neg, sum(n) FILTER (WHERE label = 1) AS pos FROM g)
    SELECT label, n, 100.0 * n / total AS pct, hi / lo::DOUBLE AS imbalance_ratio, coalesce(neg, 0) / greatest(coalesce(pos, 0), 1)::DOUBLE AS scale_pos_weight FROM g, w""",
    "pct imbalance_ratio scale_pos_weight",
)
def class_balance(spark, sf):
    return A.class_balance(standin(spark, sf, "application"), "TARGET")


_MEDIANS = ["AMT_CREDIT", "AMT_GOODS_PRICE", "OWN_CAR_AGE", "EXT_SOURCE_1", "EXT_SOURCE_2", "DAYS_BIRTH"]


@query(
    "column_medians",
    cte("application") + " " + " UNION ALL ".join(f"SELECT '{c}' AS feature, quantile_cont({c}, 0.5) AS median FROM application" for c in _MEDIANS),
    "median",
)
def medians(spark, sf):
    return column_medians(standin(spark, sf, "application"), _MEDIANS)


@query(
    "top_mean_importance",
    "SELECT p_name AS feature, avg(p_retailprice) AS importance FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40",
    "importance",
)
def top_mean_importance(spark, sf):
    from tallyrisk.operators.evaluate import top_importances

    return top_importances(table(spark, sf, "part").select(F.col("p_name").alias("feature"), F.col("p_retailprice").alias("importance")))


@query(
    "score_summary",
    f"{cte('logs')} SELECT count(score) AS n_scores, min(score) AS score_min, avg(score) AS score_mean, max(score) AS score_max FROM logs",
    "score_min score_mean score_max",
)
def score_summary(spark, sf):
    return plain_logs(spark, sf).agg(
        F.count("score").alias("n_scores"), F.min("score").alias("score_min"), F.avg("score").alias("score_mean"), F.max("score").alias("score_max")
    )
