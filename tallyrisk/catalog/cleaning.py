"""Projections, filters, cleaning and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrisk.catalog.base import query, table
from tallyrisk.catalog.standins import cte, standin
from tallyrisk.functions import json_body as J, scalar as S
from tallyrisk.operators import clean as C
from tallyrisk.plans.features import APPLICATION_RATIOS, with_ratios

APP = cte("application")
EXT = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
DOCS = [f"FLAG_DOCUMENT_{i}" for i in range(2, 7)]


@query("flt_not_value_keep_null", f"{APP} SELECT SK_ID_CURR, CODE_GENDER FROM application WHERE CODE_GENDER IS DISTINCT FROM 'XNA'")
def flt_not_value_keep_null(spark, sf):
    return standin(spark, sf, "application").where(S.not_value("CODE_GENDER", "XNA")).select("SK_ID_CURR", "CODE_GENDER")


@query("flt_numeric_cap", f"{APP} SELECT SK_ID_CURR, AMT_INCOME_TOTAL FROM application WHERE AMT_INCOME_TOTAL < 20000000", "AMT_INCOME_TOTAL")
def flt_numeric_cap(spark, sf):
    return standin(spark, sf, "application").where(F.col("AMT_INCOME_TOTAL") < 20000000).select("SK_ID_CURR", "AMT_INCOME_TOTAL")


@query(
    "sentinel_to_null",
    f"""{cte("previous_application")} SELECT SK_ID_PREV, nullif(DAYS_FIRST_DRAWING, 365243) AS DAYS_FIRST_DRAWING, nullif(DAYS_FIRST_DUE, 365243) AS DAYS_FIRST_DUE,
    nullif(DAYS_LAST_DUE, 365243) AS DAYS_LAST_DUE, nullif(DAYS_TERMINATION, 365243) AS DAYS_TERMINATION FROM previous_application""",
    "DAYS_FIRST_DRAWING DAYS_FIRST_DUE DAYS_LAST_DUE DAYS_TERMINATION",
)
def sentinel_to_null(spark, sf):
    columns = ["DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE", "DAYS_TERMINATION"]
    return S.sentinel_to_null(standin(spark, sf, "previous_application"), columns).select("SK_ID_PREV", *columns)


@query(
    "inf_to_null",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax <> 0 AND l_partkey % 10 <> 3 THEN l_extendedprice / l_tax END AS ratio FROM lineitem",
    "ratio",
)
def inf_to_null(spark, sf):
    # External data may hold infinities and NaN: the text forms are how they arrive in files.
    raw = F.when(F.col("l_tax") != 0, F.try_divide("l_extendedprice", "l_tax")).otherwise(F.lit("Infinity").cast("double"))
    raw = F.when(F.col("l_partkey") % 10 == 3, F.lit("NaN").cast("double")).otherwise(raw)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("ratio"))
    return rows.withColumn("ratio", S.finite_or_null("ratio"))


@query(
    "split_by_target",
    f"""{APP} SELECT CASE WHEN TARGET IS NULL THEN 'test' ELSE 'train' END AS part, count(*) AS n, sum(AMT_CREDIT) AS credit
    FROM application GROUP BY 1""",
    "credit",
)
def split_by_target(spark, sf):
    train, test = C.split_by_label(standin(spark, sf, "application"), "TARGET")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("AMT_CREDIT").alias("credit")]
    return train.agg(F.lit("train").alias("part"), *aggs).unionByName(test.agg(F.lit("test").alias("part"), *aggs))


@query("drop_column_list", f"{APP} SELECT SK_ID_CURR, TARGET, AMT_CREDIT, AMT_INCOME_TOTAL, FLAG_DOCUMENT_3, DAYS_BIRTH FROM application", "AMT_CREDIT AMT_INCOME_TOTAL DAYS_BIRTH")
def drop_column_list(spark, sf):
    columns = ["SK_ID_CURR", "TARGET", "AMT_CREDIT", "AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS", "DAYS_BIRTH", *DOCS]
    return C.drop_unused(standin(spark, sf, "application").select(*columns))


@query(
    "align_and_fill",
    f"""{APP} SELECT SK_ID_CURR, coalesce(EXT_SOURCE_2, 0.5) AS EXT_SOURCE_2, coalesce(OWN_CAR_AGE, 9.0) AS OWN_CAR_AGE,
    coalesce(AMT_GOODS_PRICE, 0.0) AS AMT_GOODS_PRICE, 7.0::DOUBLE AS MISSING_FEATURE, 0.0::DOUBLE AS UNKNOWN_FEATURE FROM application""",
    "EXT_SOURCE_2 OWN_CAR_AGE AMT_GOODS_PRICE MISSING_FEATURE UNKNOWN_FEATURE",
)
def align_and_fill(spark, sf):
    names = ["EXT_SOURCE_2", "OWN_CAR_AGE", "AMT_GOODS_PRICE", "MISSING_FEATURE", "UNKNOWN_FEATURE"]
    medians = {"EXT_SOURCE_2": 0.5, "OWN_CAR_AGE": 9.0, "MISSING_FEATURE": 7.0}
    return C.align(standin(spark, sf, "application"), names, medians, keep=["SK_ID_CURR"])


@query("sanitize_columns", "SELECT p_partkey AS key, p_brand AS brand_name, p_type AS brand_name_2, p_size AS size_cm FROM part")
def sanitize_columns(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias(" key"), F.col("p_brand").alias("brand name"), F.col("p_type").alias("brand-name"), F.col("p_size").alias("size (cm)")
    )
    return S.clean_names(rows)


@query(
    "coerce_numeric",
    "SELECT p_partkey, p_name, TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand_number, TRY_CAST(p_type AS DOUBLE) AS type_number FROM part",
    "brand_number type_number",
)
def coerce_numeric(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", "p_name", S.to_number(F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("brand_number"), S.to_number("p_type").alias("type_number")
    )


@query(
    "narrow_types",
    """SELECT 'l_discount' AS column_name, 'float' AS narrow_type UNION ALL SELECT 'l_extendedprice', 'float' UNION ALL
    SELECT 'l_linenumber', (SELECT CASE WHEN max(l_linenumber) < 128 THEN 'byte' ELSE 'int' END FROM lineitem) UNION ALL
    SELECT 'l_orderkey', (SELECT CASE WHEN max(l_orderkey) < 128 THEN 'byte' WHEN max(l_orderkey) < 32768 THEN 'short' WHEN max(l_orderkey) < 2147483648 THEN 'int' ELSE 'long' END FROM lineitem) UNION ALL
    SELECT 'l_partkey', (SELECT CASE WHEN max(l_partkey) < 128 THEN 'byte' WHEN max(l_partkey) < 32768 THEN 'short' WHEN max(l_partkey) < 2147483648 THEN 'int' ELSE 'long' END FROM lineitem)""",
)
def narrow_types(spark, sf):
    columns = ["l_discount", "l_extendedprice", "l_linenumber", "l_orderkey", "l_partkey"]
    types = C.fit_narrow_types(table(spark, sf, "lineitem").select(*columns))
    return spark.createDataFrame(sorted(types.items()), "column_name STRING, narrow_type STRING")


REQ = cte("requests")
_BAD = {
    "age": "age BETWEEN 0 AND 120",
    "income": "income > 0",
    "credit_amount": "credit_amount > 0",
    "annuity": "annuity > 0",
    "employment_years": "employment_years >= 0",
    "family_members": "family_members > 0",
}


@query(
    "validate_split",
    f"""{REQ} SELECT request_id, age, annuity, family_members,
    CASE WHEN {" AND ".join(f"coalesce({c}, false)" for c in _BAD.values())} THEN NULL ELSE 'validation_error' END AS error,
    array_to_string(list_filter([{", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in _BAD.items())}], lambda x: x IS NOT NULL), ',') AS failed
    FROM requests""",
    "annuity family_members",
)
def validate_split(spark, sf):
    return C.validate(standin(spark, sf, "requests")).select(
        "request_id", "age", "annuity", "family_members", "error", F.array_join("failed_fields", ",").alias("failed")
    )


_SCENARIOS = [
    {"name": "base"},
    {"name": "older", "age": 60.0},
    {"name": "large loan", "credit_amount": 250000.0, "annuity": 12500.0},
    {"name": "no income", "income": 0.0},
]


@query(
    "what_if_scenarios",
    f"""{APP}, scenarios(scenario, age, income, credit, annuity) AS (VALUES ('base', NULL, NULL, NULL, NULL), ('older', 60.0, NULL, NULL, NULL),
    ('large loan', NULL, NULL, 250000.0, 12500.0), ('no income', NULL, 0.0, NULL, NULL)),
    mixed AS (SELECT SK_ID_CURR, scenario, coalesce(income::DOUBLE, AMT_INCOME_TOTAL) AS inc, coalesce(credit::DOUBLE, AMT_CREDIT) AS cre,
    coalesce(s.annuity::DOUBLE, AMT_ANNUITY) AS ann, coalesce(age::DOUBLE * -365, DAYS_BIRTH) AS birth, DAYS_EMPLOYED AS emp, CNT_FAM_MEMBERS AS fam
    FROM application, scenarios s)
    SELECT SK_ID_CURR, scenario, inc AS AMT_INCOME_TOTAL, cre AS AMT_CREDIT, birth AS DAYS_BIRTH,
    CASE WHEN fam > 0 THEN inc / fam END AS INCOME_PER_PERSON, CASE WHEN cre > 0 THEN ann / cre END AS PAYMENT_RATE,
    CASE WHEN inc > 0 THEN ann / inc END AS ANNUITY_INCOME_PERC, CASE WHEN birth < 0 THEN emp / birth END AS DAYS_EMPLOYED_PERC FROM mixed""",
    "AMT_INCOME_TOTAL AMT_CREDIT DAYS_BIRTH INCOME_PER_PERSON PAYMENT_RATE ANNUITY_INCOME_PERC DAYS_EMPLOYED_PERC",
)
def what_if_scenarios(spark, sf):
    return C.what_if(standin(spark, sf, "application"), _SCENARIOS).select(
        "SK_ID_CURR", "scenario", "AMT_INCOME_TOTAL", "AMT_CREDIT", "DAYS_BIRTH", "INCOME_PER_PERSON", "PAYMENT_RATE", "ANNUITY_INCOME_PERC", "DAYS_EMPLOYED_PERC"
    )


# --- scalar functions -------------------------------------------------------------------------


@query(
    "safe_ratios",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / nullif(l_tax, 0) AS by_tax,
    l_extendedprice / nullif(TRY_CAST(l_returnflag AS DOUBLE), 0) AS by_text, l_quantity / nullif(l_linenumber, 0) AS by_line FROM lineitem""",
    "by_tax by_text by_line",
)
def safe_ratios(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        S.safe_ratio("l_extendedprice", "l_tax").alias("by_tax"),
        S.safe_ratio("l_extendedprice", "l_returnflag").alias("by_text"),
        S.safe_ratio("l_quantity", "l_linenumber").alias("by_line"),
    )


@query(
    "application_ratios",
    f"""{APP}, cleaned AS (SELECT * REPLACE (nullif(DAYS_EMPLOYED, 365243) AS DAYS_EMPLOYED) FROM application)
    SELECT SK_ID_CURR, {", ".join(f"{a} / nullif({b}, 0) AS {n}" for n, a, b in APPLICATION_RATIOS)} FROM cleaned""",
    [n for n, _, _ in APPLICATION_RATIOS],
)
def application_ratios(spark, sf):
    rows = S.sentinel_to_null(standin(spark, sf, "application"), ["DAYS_EMPLOYED"])
    return with_ratios(rows).select("SK_ID_CURR", *[n for n, _, _ in APPLICATION_RATIOS])


_LIST = f"list_filter([{', '.join(EXT)}], lambda x: x IS NOT NULL)"


@query(
    "rowwise_stats",
    f"""{APP} SELECT SK_ID_CURR, coalesce(list_sum({_LIST}), 0.0) AS total, CASE WHEN len({_LIST}) = 0 THEN 1.0 ELSE list_product({_LIST}) END AS product,
    list_min({_LIST}) AS lowest, list_max({_LIST}) AS highest, list_avg({_LIST}) AS mean, list_median({_LIST}) AS middle,
    CASE WHEN len({_LIST}) > 1 THEN list_var_samp({_LIST}) END AS variance, EXT_SOURCE_1 * 2 + EXT_SOURCE_2 + EXT_SOURCE_3 * 3 AS weighted FROM application""",
    "total product lowest highest mean middle variance weighted",
)
def rowwise_stats(spark, sf):
    return standin(spark, sf, "application").select(
        "SK_ID_CURR",
        S.row_sum(EXT).alias("total"),
        S.row_product(EXT).alias("product"),
        S.row_min(EXT).alias("lowest"),
        S.row_max(EXT).alias("highest"),
        S.row_mean(EXT).alias("mean"),
        S.row_median(EXT).alias("middle"),
        S.row_variance(EXT).alias("variance"),
        S.row_weighted_sum({"EXT_SOURCE_1": 2, "EXT_SOURCE_2": 1, "EXT_SOURCE_3": 3}).alias("weighted"),
    )


@query(
    "rowwise_kurtosis",
    f"""{APP} SELECT SK_ID_CURR, CASE WHEN list_min([{', '.join(DOCS)}]) = list_max([{', '.join(DOCS)}]) THEN 0.0
    ELSE list_kurtosis([{', '.join(DOCS)}]) END AS kurt FROM application""",
    "kurt",
)
def rowwise_kurtosis(spark, sf):
    return standin(spark, sf, "application").select("SK_ID_CURR", S.row_kurtosis(DOCS).alias("kurt"))


@query(
    "age_bucket",
    f"""{APP}, aged AS (SELECT SK_ID_CURR, -DAYS_BIRTH * (1 + CAST(EXT_SOURCE_1 AS DOUBLE)) / 365 AS y FROM application)
    SELECT SK_ID_CURR, CAST(CASE WHEN y < 27 THEN 1 WHEN y < 40 THEN 2 WHEN y < 50 THEN 3 WHEN y < 65 THEN 4 WHEN y < 99 THEN 5 ELSE 0 END AS INT) AS bucket FROM aged""",
)
def age_bucket(spark, sf):
    days = F.col("DAYS_BIRTH") * (1 + F.col("EXT_SOURCE_1"))
    return standin(spark, sf, "application").select("SK_ID_CURR", S.age_bucket(days).alias("bucket"))


@query(
    "date_parts",
    """SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate) AS INT) AS o_orderdate_year, CAST(month(o_orderdate) AS INT) AS o_orderdate_month,
    CAST(isodow(o_orderdate) - 1 AS INT) AS o_orderdate_dayofweek FROM orders""",
)
def date_parts(spark, sf):
    return S.date_parts(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"))


@query(
    "installment_measures",
    f"""{cte("installments_payments")}, m AS (SELECT *, DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT AS late FROM installments_payments)
    SELECT SK_ID_PREV, NUM_INSTALMENT_NUMBER, DAYS_ENTRY_PAYMENT, AMT_PAYMENT / nullif(AMT_INSTALMENT, 0) AS PAYMENT_PERC, AMT_INSTALMENT - AMT_PAYMENT AS PAYMENT_DIFF,
    CASE WHEN late IS NOT NULL THEN greatest(late, 0) END AS DPD, CASE WHEN late IS NOT NULL THEN greatest(-late, 0) END AS DBD,
    CAST(coalesce(late > 0, false) AS INT) AS LATE_PAYMENT, CAST(coalesce(late > 7, false) AS INT) AS DPD_7, CAST(coalesce(late > 15, false) AS INT) AS DPD_15 FROM m""",
    "DAYS_ENTRY_PAYMENT PAYMENT_PERC PAYMENT_DIFF DPD DBD",
)
def installment_measures(spark, sf):
    from tallyrisk.plans.features import instalment_measures

    return instalment_measures(standin(spark, sf, "installments_payments")).select(
        "SK_ID_PREV", "NUM_INSTALMENT_NUMBER", "DAYS_ENTRY_PAYMENT", "PAYMENT_PERC", "PAYMENT_DIFF", "DPD", "DBD", "LATE_PAYMENT", "DPD_7", "DPD_15"
    )


# --- JSON bodies --------------------------------------------------------------------------------

# Request bodies made from customers: every third has a nested features object, some are lists,
# plain text or broken.
_BODY_SQL = """bodies AS (SELECT c_custkey, CASE WHEN c_nationkey = 1 THEN '[' || c_custkey || ']' WHEN c_nationkey = 2 THEN '{"broken": ' || c_custkey
    WHEN c_nationkey % 3 = 0 THEN '{"note":"n","features":{"income":' || CAST(c_custkey AS VARCHAR) || ',"seg":"' || c_mktsegment || '","flag":' || (CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'false' END) || ',"none":null}}'
    ELSE '{"zip":"12","income":' || CAST(c_custkey AS VARCHAR) || '.5,"age":' || CAST(c_nationkey AS VARCHAR) || ',"deep":{"x":1}}' END AS body FROM customer)"""


def _bodies(spark, sf):
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    flag = F.when(F.col("c_acctbal") < 0, "true").otherwise("false")
    nested = F.concat(F.lit('{"note":"n","features":{"income":'), key, F.lit(',"seg":"'), "c_mktsegment", F.lit('","flag":'), flag, F.lit(',"none":null}}'))
    flat = F.concat(F.lit('{"zip":"12","income":'), key, F.lit('.5,"age":'), nation, F.lit(',"deep":{"x":1}}'))
    body = (
        F.when(F.col("c_nationkey") == 1, F.concat(F.lit("["), key, F.lit("]")))
        .when(F.col("c_nationkey") == 2, F.concat(F.lit('{"broken": '), key))
        .when(F.col("c_nationkey") % 3 == 0, nested)
        .otherwise(flat)
    )
    return table(spark, sf, "customer").select("c_custkey", body.alias("body"))


@query(
    "json_extract_features",
    f"""WITH {_BODY_SQL}, long AS (SELECT c_custkey, 'income' AS feature, CAST(coalesce(json_extract(body, '$.features.income'), json_extract(body, '$.income')) AS DOUBLE) AS value FROM bodies WHERE json_valid(body) AND json_type(body) = 'OBJECT'
    UNION ALL SELECT c_custkey, 'age', CAST(json_extract(body, '$.age') AS DOUBLE) FROM bodies WHERE json_valid(body) AND json_type(body) = 'OBJECT'
    UNION ALL SELECT c_custkey, 'flag', CASE json_extract_string(body, '$.features.flag') WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 END FROM bodies WHERE json_valid(body) AND json_type(body) = 'OBJECT')
    SELECT c_custkey, feature, value FROM long WHERE value IS NOT NULL""",
    "value",
)
def json_extract_features(spark, sf):
    bodies = _bodies(spark, sf).withColumn("input_features", J.feature_map(J.parsed("body")))
    return J.features_long(bodies, ["c_custkey"])


@query(
    "json_sorted_keys",
    f"""WITH {_BODY_SQL} SELECT c_custkey, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT'
    THEN array_to_string(list_sort(json_keys(body)), ',') END AS keys FROM bodies""",
)
def json_sorted_keys(spark, sf):
    keys = F.when(J.is_object(F.col("body")), J.sorted_keys(F.col("body")))
    return _bodies(spark, sf).select("c_custkey", F.array_join(keys, ",").alias("keys"))


@query(
    "payload_hash",
    f"""WITH {_BODY_SQL} SELECT c_custkey, sha256(CASE WHEN NOT json_valid(body) THEN '{{"raw_payload":"' || replace(body, '"', '\\"') || '"}}'
    WHEN json_type(body) <> 'OBJECT' THEN '{{"payload_type":"list"}}'
    WHEN json_extract(body, '$.features') IS NOT NULL THEN '{{"features":{{"flag":' || json_extract(body, '$.features.flag') || ',"income":' || json_extract(body, '$.features.income') || ',"none":null,"seg":' || json_extract(body, '$.features.seg') || '}},"note":"n"}}'
    ELSE '{{"age":' || json_extract(body, '$.age') || ',"deep":{{"x":1}},"income":' || json_extract(body, '$.income') || ',"zip":"12"}}' END) AS payload_hash FROM bodies""",
)
def payload_hash(spark, sf):
    return _bodies(spark, sf).select("c_custkey", J.payload_hash(F.col("body")).alias("payload_hash"))


@query(
    "features_wide",
    f"""WITH {_BODY_SQL}, good AS (SELECT * FROM bodies WHERE json_valid(body) AND json_type(body) = 'OBJECT')
    SELECT c_custkey, CAST(json_extract(body, '$.age') AS DOUBLE) AS age, CASE json_extract_string(body, '$.features.flag') WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 END AS flag,
    CAST(coalesce(json_extract(body, '$.features.income'), json_extract(body, '$.income')) AS DOUBLE) AS income FROM good""",
    "age flag income",
)
def features_wide(spark, sf):
    bodies = _bodies(spark, sf).withColumn("input_features", J.feature_map(J.parsed("body")))
    names = sorted(r["feature"] for r in J.feature_vocabulary(bodies).collect())
    return J.features_wide(bodies, ["c_custkey"], names)
