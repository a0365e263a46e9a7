"""Scoring expressions: request features, rule model, decision, routing, log records, perturbation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyrisk.functions.scalar import safe_ratio

# Threshold, versions and the coefficients of the rule model.
DECISION_THRESHOLD = 0.4889
SERVICE_VERSION = "0.1.0"
RULE_MODEL_VERSION = "demo-0.1.0"
RULE_WEIGHTS = {
    "employment_age_perc": 0.015,
    "income_credit_perc": 0.10,
    "annuity_income_perc": -2.5,
    "payment_rate": -1.8,
    "income": 0.000001,
}
DEMO_WEIGHTS = {
    "employment_age_perc": 0.03,
    "income_credit_perc": 0.08,
    "annuity_income_perc": -2.0,
    "payment_rate": -1.2,
    "income": 0.000002,
}
RAW_FEATURES = ["age", "income", "credit_amount", "annuity", "employment_years", "family_members"]
# Ratio name, numerator, denominator.
REQUEST_RATIOS = [
    ("employment_age_perc", "employment_years", "age"),
    ("income_credit_perc", "income", "credit_amount"),
    ("income_per_person", "income", "family_members"),
    ("annuity_income_perc", "annuity", "income"),
    ("payment_rate", "annuity", "credit_amount"),
]
MODEL_FEATURES = [*RAW_FEATURES, *[name for name, _, _ in REQUEST_RATIOS]]


def request_features(df: DataFrame) -> DataFrame:
    """The five request ratios; null where undefined (fill with fitted medians, see ``align``)."""
    return df.withColumns({name: safe_ratio(top, bottom) for name, top, bottom in REQUEST_RATIOS})


def weighted(weights: dict[str, float]) -> Column:
    terms = [F.lit(w) * F.col(c).cast("double") for c, w in weights.items()]
    out = terms[0]
    for term in terms[1:]:
        out = out + term
    return out


def rule_score() -> Column:
    """Logistic of the rule model; null if an input is null."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-weighted(RULE_WEIGHTS)))


def decision(score: Column | str, threshold: float = DECISION_THRESHOLD) -> Column:
    """REJECT at or above the threshold; a missing score is accepted, so look at ``score_missing``."""
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c >= threshold, F.lit("REJECT")).otherwise(F.lit("ACCEPT"))


def decide(df: DataFrame, score: str = "score", threshold: float = DECISION_THRESHOLD) -> DataFrame:
    return df.withColumns({"decision": decision(score, threshold), "score_missing": F.col(score).isNull()})


def score_requests(df: DataFrame) -> DataFrame:
    """Request features, rule score, decision and version. Stateless: works on streams too."""
    scored = request_features(df).withColumn("score", rule_score())
    return decide(scored).withColumn("model_version", F.lit(RULE_MODEL_VERSION))


def route(df: DataFrame, has_fitted_model: bool, features: str = "features") -> DataFrame:
    """Which scoring path a request takes. Feature maps need a fitted model, else status 400."""
    is_map = F.col(features).isNotNull()
    refused = is_map & F.lit(not has_fitted_model)
    return df.withColumns(
        {
            "route": F.when(is_map, F.lit("feature_map")).otherwise(F.lit("compact")),
            "status_code": F.when(refused, F.lit(400)).otherwise(F.lit(200)),
            "error": F.when(refused, F.lit("feature_map_requires_fitted_model")),
        }
    )


def log_records(scored: DataFrame, endpoint: str = "/predict", method: str = "POST") -> DataFrame:
    """One log record per scored request. Needs ``timestamp``, ``error``, ``score``, ``decision``,
    ``model_version``, ``latency_ms``, ``inference_ms``, ``payload_hash``, ``payload_keys`` and
    ``input_features``. A failed record has status 422, no score and no decision."""
    bad = F.col("error").isNotNull()
    return scored.select(
        "timestamp",
        F.lit(endpoint).alias("endpoint"),
        F.lit(method).alias("method"),
        F.when(bad, F.lit(422)).otherwise(F.lit(200)).alias("status_code"),
        F.col("latency_ms").cast("double").alias("latency_ms"),
        F.when(bad, F.lit(0.0)).otherwise(F.col("inference_ms").cast("double")).alias("inference_ms"),
        "payload_hash",
        "payload_keys",
        "input_features",
        F.when(~bad, F.col("score")).alias("score"),
        F.when(~bad, F.col("decision")).alias("decision"),
        F.when(bad, F.lit(SERVICE_VERSION)).otherwise(F.col("model_version")).alias("model_version"),
        "error",
    )


def demo_dataset(df: DataFrame, index: str) -> DataFrame:
    """Request fields computed from a row number, the ratios, the risk signal and the label
    (signal at or above its median)."""
    from tallyrisk.operators.running import exact_quantiles

    i = F.col(index).cast("long")
    raw = df.select(
        i.alias("i"),
        (21 + i % 50).alias("age"),
        (18000 + i * 130).alias("income"),
        (3000 + i * 40).alias("credit_amount"),
        (300 + i * 3).alias("annuity"),
        (i % 20).alias("employment_years"),
        (1 + i % 5).alias("family_members"),
    )
    rows = request_features(raw).withColumn("risk_signal", weighted(DEMO_WEIGHTS))
    middle = exact_quantiles(rows, "risk_signal", {"m": 0.5}).scalar()
    return rows.withColumn("label", (F.col("risk_signal") >= middle).cast("int"))


def perturb(df: DataFrame, columns: Sequence[str], copies: int, percent: float, seed: int, key: str) -> DataFrame:
    """``copies`` variants of each row; every value but exact 0 and 1 is scaled by a factor within
    +- percent. The factor comes from a hash of (key, copy, column), so a recomputed task gives the
    same rows."""
    delta = percent / 100.0
    rows = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))

    def factor(c: str) -> Column:
        unit = F.pmod(F.xxhash64(F.col(key), F.col("copy"), F.lit(c), F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_002.0)
        return F.lit(1.0 - delta) + F.lit(2.0 * delta) * unit

    def varied(c: str) -> Column:
        value = F.col(c).cast("double")
        return F.when(value.isin(0.0, 1.0), value).otherwise(value * factor(c))

    return rows.withColumns({c: varied(c) for c in columns})
