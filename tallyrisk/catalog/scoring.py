"""Scoring of request tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrisk.catalog.base import query, table
from tallyrisk.catalog.standins import cte, standin
from tallyrisk.functions import json_body as J
from tallyrisk.operators import score as R
from tallyrisk.operators.clean import validate

REQ = cte("requests")
_RATIOS = ", ".join(f"{a} / nullif({b}, 0) AS {n}" for n, a, b in R.REQUEST_RATIOS)
FEATURED = f"featured AS (SELECT *, {_RATIOS} FROM requests)"
SCORED = f"""{FEATURED}, scored AS (SELECT *, 1.0 / (1.0 + exp(-(0.015 * employment_age_perc + 0.10 * income_credit_perc - 2.5 * annuity_income_perc - 1.8 * payment_rate + 0.000001 * income))) AS score FROM featured)"""
_KEYS = ["request_id", "l_shipdate"]


@query("scoring_features", f"{REQ}, {FEATURED} SELECT request_id, l_shipdate, {', '.join(n for n, _, _ in R.REQUEST_RATIOS)} FROM featured", [n for n, _, _ in R.REQUEST_RATIOS])
def scoring_features(spark, sf):
    return R.request_features(standin(spark, sf, "requests")).select(*_KEYS, *[n for n, _, _ in R.REQUEST_RATIOS])


@query("score_rule_model", f"{REQ}, {SCORED} SELECT request_id, l_shipdate, income, score FROM scored", "income score")
def score_rule_model(spark, sf):
    return R.request_features(standin(spark, sf, "requests")).withColumn("score", R.rule_score()).select(*_KEYS, "income", "score")


@query(
    "decide",
    f"""{REQ}, {SCORED}, s AS (SELECT request_id, l_shipdate, income, CASE WHEN request_id % 17 = 0 THEN NULL ELSE score END AS score FROM scored)
    SELECT request_id, l_shipdate, income, score, CASE WHEN score >= 0.4889 THEN 'REJECT' ELSE 'ACCEPT' END AS decision, score IS NULL AS score_missing FROM s""",
    "income score",
)
def decide(spark, sf):
    rows = R.request_features(standin(spark, sf, "requests")).withColumn("score", F.when(F.col("request_id") % 17 != 0, R.rule_score()))
    return R.decide(rows.select(*_KEYS, "income", "score"))


@query(
    "route_payload",
    """SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'feature_map' ELSE 'compact' END AS route,
    CAST(CASE WHEN event_type IN ('view', 'click') THEN 400 ELSE 200 END AS INT) AS status_code,
    CASE WHEN event_type IN ('view', 'click') THEN 'feature_map_requires_fitted_model' END AS error FROM events""",
)
def route_payload(spark, sf):
    # Views and clicks carry a feature map, other events a compact payload.
    props = F.when(F.col("event_type").isin("view", "click"), J.feature_map(J.parsed("props")))
    rows = table(spark, sf, "events").select("event_id", props.alias("features"))
    return R.route(rows, has_fitted_model=False).drop("features")


LOGGED = f"""{SCORED}, checked AS (SELECT *, CASE WHEN coalesce(age BETWEEN 0 AND 120 AND income > 0 AND credit_amount > 0 AND annuity > 0 AND employment_years >= 0 AND family_members > 0, false) THEN NULL ELSE 'validation_error' END AS error,
    '{{"family_members":' || CAST(CAST(family_members AS INT) AS VARCHAR) || ',"request_id":' || CAST(request_id AS VARCHAR) || '}}' AS body FROM scored)"""
LOG_SELECT = """SELECT l_shipdate AS timestamp, '/predict' AS endpoint, 'POST' AS method, CAST(CASE WHEN error IS NULL THEN 200 ELSE 422 END AS INT) AS status_code, CAST(age AS DOUBLE) AS latency_ms,
    CASE WHEN error IS NULL THEN age / 4.0 ELSE 0.0 END AS inference_ms, sha256(body) AS payload_hash, 'family_members,request_id' AS payload_keys, CAST(request_id AS DOUBLE) AS request_id,
    CASE WHEN error IS NULL THEN score END AS score, CASE WHEN error IS NULL THEN CASE WHEN score >= 0.4889 THEN 'REJECT' ELSE 'ACCEPT' END END AS decision,
    CASE WHEN error IS NULL THEN 'demo-0.1.0' ELSE '0.1.0' END AS model_version, error FROM checked"""
LOG_DOUBLES = "latency_ms inference_ms request_id score"


def request_rows(df):
    """Requests with the service's own figures: time, body, latency."""
    body = F.to_json(F.struct(F.col("family_members").cast("int").alias("family_members"), "request_id"))
    return df.withColumns(
        {
            "timestamp": F.col("l_shipdate").cast("timestamp"),
            "body": body,
            "latency_ms": F.col("age").cast("double"),
            "inference_ms": F.col("age") / F.lit(4.0),
        }
    )


def flat_log(logs):
    return logs.withColumns(
        {
            "timestamp": F.col("timestamp").cast("timestamp_ntz"),
            "payload_keys": F.array_join("payload_keys", ","),
            "request_id": F.col("input_features")["request_id"],
        }
    ).drop("input_features")


@query("score_to_log", f"{REQ}, {LOGGED} {LOG_SELECT}", LOG_DOUBLES)
def score_to_log(spark, sf):
    from tallyrisk.streaming.jobs import scored_log

    return flat_log(scored_log(request_rows(standin(spark, sf, "requests"))))


@query("validation_summary", f"{REQ}, {LOGGED} SELECT coalesce(error, 'valid') AS outcome, count(*) AS n FROM checked GROUP BY 1")
def validation_summary(spark, sf):
    checked = validate(standin(spark, sf, "requests"))
    return checked.groupBy(F.coalesce("error", F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("score_sensitivity")
def score_sensitivity(spark, sf):
    rows = standin(spark, sf, "requests").withColumn("row_key", F.xxhash64("request_id", "l_shipdate", "income"))
    varied = R.perturb(rows, R.RAW_FEATURES, copies=3, percent=10.0, seed=42, key="row_key")
    scored = R.request_features(varied).withColumn("score", R.rule_score())
    return scored.groupBy("copy").agg(F.min("score").alias("score_min"), F.avg("score").alias("score_mean"), F.max("score").alias("score_max"))


@query(
    "demo_dataset",
    """WITH r AS (SELECT c_custkey AS i, 21 + c_custkey % 50 AS age, 18000 + c_custkey * 130 AS income, 3000 + c_custkey * 40 AS credit_amount, 300 + c_custkey * 3 AS annuity, c_custkey % 20 AS employment_years, 1 + c_custkey % 5 AS family_members FROM customer),
    f AS (SELECT *, employment_years / age::DOUBLE AS employment_age_perc, income / credit_amount::DOUBLE AS income_credit_perc, income / family_members::DOUBLE AS income_per_person, annuity / income::DOUBLE AS annuity_income_perc, annuity / credit_amount::DOUBLE AS payment_rate FROM r),
    s AS (SELECT *, 0.03 * employment_age_perc + 0.08 * income_credit_perc - 2.0 * annuity_income_perc - 1.2 * payment_rate + 0.000002 * income AS risk_signal FROM f)
    SELECT *, CAST(risk_signal >= (SELECT quantile_cont(risk_signal, 0.5) FROM s) AS INT) AS label FROM s""",
    "employment_age_perc income_credit_perc income_per_person annuity_income_perc payment_rate risk_signal",
)
def demo_dataset(spark, sf):
    return R.demo_dataset(table(spark, sf, "customer"), "c_custkey")
