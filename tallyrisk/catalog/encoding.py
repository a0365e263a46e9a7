"""Encoders, imputers, scalers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrisk.catalog.base import query, table
from tallyrisk.catalog.standins import cte, standin
from tallyrisk.operators import clean as C, encode as E
from tallyrisk.operators.running import fit_medians

APP = cte("application")


def _dummy(column: str, value: str | None) -> str:
    literal = "NULL" if value is None else f"'{value}'"
    return f"CAST({column} IS NOT DISTINCT FROM {literal} AS INT)"


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "onehot_low_card",
    f"""WITH c AS (SELECT DISTINCT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part),
    t AS (SELECT p_partkey, part.p_brand, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_type END AS p_type FROM part)
    SELECT p_partkey, CAST(code AS INT) AS p_brand, {', '.join(f'{_dummy("p_type", v)} AS p_type_{v}' for v in _TYPES)}, {_dummy("p_type", None)} AS p_type_nan FROM t JOIN c USING (p_brand)""",
)
def onehot_low_card(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 10 != 0, F.col("p_type")).alias("p_type"))
    return E.fit_onehot(part).apply(part)


@query(
    "factorize",
    f"""{APP}, c AS (SELECT OCCUPATION_TYPE, row_number() OVER (ORDER BY OCCUPATION_TYPE) - 1 AS code FROM (SELECT DISTINCT OCCUPATION_TYPE FROM application WHERE OCCUPATION_TYPE IS NOT NULL)),
    n AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS code FROM (SELECT DISTINCT coalesce(CODE_GENDER, '__NA__') AS g FROM application))
    SELECT SK_ID_CURR, CAST(coalesce(c.code, -1) AS INT) AS occupation, CAST(n.code AS INT) AS gender FROM application a LEFT JOIN c USING (OCCUPATION_TYPE) JOIN n ON coalesce(a.CODE_GENDER, '__NA__') = n.g""",
)
def factorize(spark, sf):
    rows = standin(spark, sf, "application").select("SK_ID_CURR", "OCCUPATION_TYPE", "CODE_GENDER")
    rows = E.factorize(rows, "OCCUPATION_TYPE", "occupation")
    return E.factorize(rows, "CODE_GENDER", "gender", missing=E.MISSING).select("SK_ID_CURR", "occupation", "gender")


@query(
    "label_encode",
    f"""{APP}, n AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS code FROM (SELECT DISTINCT coalesce(CODE_GENDER, 'nan') AS g FROM application)),
    o AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS code FROM (SELECT DISTINCT ORGANIZATION_TYPE AS g FROM application))
    SELECT SK_ID_CURR, CAST(n.code AS INT) AS CODE_GENDER, CAST(o.code AS INT) AS ORGANIZATION_TYPE FROM application a JOIN n ON coalesce(a.CODE_GENDER, 'nan') = n.g JOIN o ON a.ORGANIZATION_TYPE = o.g""",
)
def label_encode(spark, sf):
    return E.label_encode(standin(spark, sf, "application").select("SK_ID_CURR", "CODE_GENDER", "ORGANIZATION_TYPE"))


@query(
    "onehot_drop_first",
    f"""{APP} SELECT SK_ID_CURR, {_dummy("CODE_GENDER", "M")} AS CODE_GENDER_M, {_dummy("CODE_GENDER", "XNA")} AS CODE_GENDER_XNA,
    {', '.join(f'{_dummy("ORGANIZATION_TYPE", v)} AS ORGANIZATION_TYPE_{v}' for v in ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])} FROM application""",
)
def onehot_drop_first(spark, sf):
    rows = standin(spark, sf, "application").select("SK_ID_CURR", "CODE_GENDER", "ORGANIZATION_TYPE")
    return E.fit_onehot(rows, with_null=False, drop_first=True).apply(rows)


@query(
    "ordinal_fit_apply",
    f"""{APP}, f AS (SELECT coalesce(CODE_GENDER, '__NA__') AS g FROM application WHERE TARGET = 1), n AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS code FROM (SELECT DISTINCT g FROM f))
    SELECT SK_ID_CURR, CAST(coalesce(code, -1) AS INT) AS code FROM application a LEFT JOIN n ON coalesce(a.CODE_GENDER, '__NA__') = n.g WHERE TARGET IS NULL OR TARGET = 0""",
)
def ordinal_fit_apply(spark, sf):
    rows = standin(spark, sf, "application").select("SK_ID_CURR", "TARGET", "CODE_GENDER")
    codes = E.fit_codes(rows.where("TARGET = 1"), "CODE_GENDER", E.MISSING)
    valid = rows.where("TARGET IS NULL OR TARGET = 0")
    return E.apply_codes(valid, codes, "CODE_GENDER", "code", E.MISSING).select("SK_ID_CURR", "code")


_IMPUTE = ["SK_ID_CURR", "OWN_CAR_AGE", "EXT_SOURCE_1", "AMT_GOODS_PRICE", "CODE_GENDER", "OCCUPATION_TYPE"]


@query(
    "impute_auto",
    f"""{APP}, m AS (SELECT quantile_cont(OWN_CAR_AGE, 0.5) AS a, quantile_cont(EXT_SOURCE_1, 0.5) AS b, quantile_cont(AMT_GOODS_PRICE, 0.5) AS c FROM application),
    g AS (SELECT CODE_GENDER AS v FROM application WHERE CODE_GENDER IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    o AS (SELECT OCCUPATION_TYPE AS v FROM application WHERE OCCUPATION_TYPE IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT SK_ID_CURR, coalesce(OWN_CAR_AGE, a) AS OWN_CAR_AGE, coalesce(EXT_SOURCE_1, b) AS EXT_SOURCE_1, coalesce(AMT_GOODS_PRICE, c) AS AMT_GOODS_PRICE,
    coalesce(CODE_GENDER, g.v) AS CODE_GENDER, coalesce(OCCUPATION_TYPE, o.v) AS OCCUPATION_TYPE FROM application, m, g, o""",
    "OWN_CAR_AGE EXT_SOURCE_1 AMT_GOODS_PRICE",
)
def impute_auto(spark, sf):
    # The extra column is null in more than half of the rows and is dropped.
    rows = standin(spark, sf, "application").select(*_IMPUTE, F.when(F.col("TARGET") == 1, F.lit(1.0)).alias("RARE"))
    return E.fit_imputer(rows).apply(rows)


_TRAIN = ["OWN_CAR_AGE", "EXT_SOURCE_1", "AMT_GOODS_PRICE"]


@query(
    "impute_train_median",
    f"""{APP}, m AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}' for c in _TRAIN)} FROM application WHERE TARGET IS NOT NULL)
    SELECT SK_ID_CURR, {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in _TRAIN)} FROM application, m WHERE TARGET IS NULL""",
    _TRAIN,
)
def impute_train_median(spark, sf):
    train, test = C.split_by_label(standin(spark, sf, "application"), "TARGET")
    return C.align(test, _TRAIN, fit_medians(train, _TRAIN), keep=["SK_ID_CURR"])


_SCALE = ["l_quantity", "l_extendedprice", "l_discount", "constant"]


@query(
    "standardize",
    f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, 3.0::DOUBLE AS constant FROM lineitem),
    s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}' for c in _SCALE)} FROM l)
    SELECT l_orderkey, l_linenumber, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in _SCALE)} FROM l, s""",
    _SCALE,
)
def standardize(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", F.lit(3.0).alias("constant"))
    return E.fit_scaler(rows, _SCALE).apply(rows)


@query(
    "median_payload",
    f"""{APP} SELECT 'EXT_SOURCE_1' AS feature, quantile_cont(EXT_SOURCE_1, 0.5) AS median FROM application UNION ALL
    SELECT 'OWN_CAR_AGE', quantile_cont(OWN_CAR_AGE, 0.5) FROM application UNION ALL SELECT 'UNKNOWN', 0.0""",
    "median",
)
def median_payload(spark, sf):
    from tallyrisk.operators.running import column_medians
    from tallyrisk.sources.tables import median_payload as payload

    medians = column_medians(standin(spark, sf, "application"), ["EXT_SOURCE_1", "OWN_CAR_AGE"])
    return payload(medians, ["EXT_SOURCE_1", "OWN_CAR_AGE", "UNKNOWN"]).select(F.explode("features").alias("feature", "median"))
