"""Training, tuning and scoring with MLlib. Results depend on the engine's optimiser: rows-only checks,
apart from the sizes that are known beforehand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrisk.catalog.base import query, table
from tallyrisk.catalog.standins import STANDINS, cte
from tallyrisk.functions.json_body import feature_map, parsed
from tallyrisk.operators.clean import align
from tallyrisk.operators.evaluate import assign_folds, holdout
from tallyrisk.operators.neighbours import nearest_neighbours
from tallyrisk.operators.running import fit_medians
from tallyrisk.plans import leafwise as G, training as T
from tallyrisk.session import FIT_ROWS, scratch_path, settle, settle_evenly

FEATURES = ["value", "k", "hour", "weekday", "user"]


def labelled(spark, sf):
    """One row per event: key, label, five features."""
    label = STANDINS["scored"][1]["y"]
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.expr(label).alias("label"),
        "value",
        feature_map(parsed("props"))["k"].alias("k"),
        F.hour("ts").cast("double").alias("hour"),
        F.weekday("ts").cast("double").alias("weekday"),
        F.col("user_id").cast("double").alias("user"),
    )


def _split(spark, sf, balanced=False, most=FIT_ROWS):
    """Training rows, weighted by their own class sizes, and the held-out tenth."""
    rows = settle_evenly(holdout(labelled(spark, sf), ["id"], "label"), most)
    train, test = (rows.where(part).drop("is_valid") for part in ("NOT is_valid", "is_valid"))
    return T.with_class_weight(train, balanced=balanced), test


def _metrics(scored):
    return T.evaluate_scores(settle(scored.select("label", "score")))


@query("train_logreg")
def train_logreg(spark, sf):
    train, test = _split(spark, sf)
    return _metrics(T.with_probability(T.logistic(FEATURES).fit(train), test))


@query("train_rf")
def train_rf(spark, sf):
    train, test = _split(spark, sf, balanced=True)
    return _metrics(T.with_probability(T.random_forest(FEATURES).fit(train), test))


@query("train_gbt")
def train_gbt(spark, sf):
    train, test = _split(spark, sf)
    # Boosting stops by a tenth of the training rows, not by those it is judged on.
    rows = settle_evenly(holdout(train, ["id"], "label", seed=43))
    model = T.boosted_trees(FEATURES, validation="is_valid", maxIter=30, stepSize=0.1).fit(rows)
    return _metrics(T.with_probability(model, test))


@query("train_leafwise")
def train_leafwise(spark, sf):
    """Leaf-wise trees with the settings of the boosted model; a tenth of the training rows decides when to stop."""
    train, test = _split(spark, sf)
    rows = settle_evenly(holdout(train, ["id"], "label", seed=43))
    model = G.fit_leafwise(rows, FEATURES, weight=T.WEIGHT, validation="is_valid", settings=G.Settings(rounds=T.BOOST_ROUNDS, patience=20))
    return _metrics(model.transform(test, "score"))


@query("train_mlp")
def train_mlp(spark, sf):
    train, test = _split(spark, sf, most=T.NET_ROWS)
    return _metrics(T.with_probability(T.neural_net(FEATURES).fit(train), test))


@query("compare_models")
def compare_models(spark, sf):
    train, test = _split(spark, sf, most=T.NET_ROWS)
    return T.compare_models(T.families(FEATURES), T.with_family_weights(train.drop(T.WEIGHT)), test)


@query("tune_grid")
def tune_grid(spark, sf):
    rows = settle_evenly(assign_folds(T.with_class_weight(labelled(spark, sf)), ["id"], 3, label="label"))
    _, table_ = T.grid_search(T.logistic(FEATURES, maxIter=50), T.logistic_grid(rows.count() * 2 // 3), rows, k=3)
    return table_.select("trial", F.to_json("parameters").alias("parameters"), "auc")


@query("tune_cost")
def tune_cost(spark, sf):
    rows = settle_evenly(assign_folds(T.with_class_weight(labelled(spark, sf)), ["id"], 2, label="label"))
    space = {**T.SEARCH_SPACE, "maxIter": (5, 15, "int"), "maxDepth": (3, 6, "int")}
    trials = T.cost_search(T.boosted_trees, space, rows, FEATURES, n_trials=3, folds=2)
    return trials.select("trial", F.to_json("parameters").alias("parameters"), "mean_cost")


@query("cv_submission")
def cv_submission(spark, sf):
    test = F.col("hour") >= 20
    train = T.with_class_weight(labelled(spark, sf).where(~test))
    found = T.cross_validate(T.logistic(FEATURES, maxIter=50), train, FEATURES, ["id"], k=3, test=labelled(spark, sf).where(test))
    return found.test_scores


@query("feature_importances")
def feature_importances(spark, sf):
    rows = T.with_class_weight(labelled(spark, sf))
    found = T.cross_validate(T.boosted_trees(FEATURES, maxIter=10, stepSize=0.1), rows, FEATURES, ["id"], k=2)
    from tallyrisk.operators.evaluate import top_importances

    return top_importances(found.importances)


@query("score_batch")
def score_batch(spark, sf):
    train, _ = _split(spark, sf)
    medians = fit_medians(train, FEATURES)
    model = T.logistic(FEATURES).fit(align(train, FEATURES, medians, keep=["label", "weight"]))
    path = scratch_path(spark, "model")
    T.save_bundle(spark, T.ModelBundle(model, FEATURES, medians, "events-logistic-1"), path)
    return T.score_batch(labelled(spark, sf), T.load_bundle(spark, path), keep=["id"])


_FLAT = ["value", "CAST(hour(ts) AS DOUBLE)", "CAST(user_id % 13 AS DOUBLE)"]
_GAP = " + ".join(f"(a.f{i} - b.f{i}) * (a.f{i} - b.f{i})" for i in range(len(_FLAT)))


@query(
    "rare_neighbours",
    f"""WITH rare AS (SELECT event_id AS id, {', '.join(f'{e} AS f{i}' for i, e in enumerate(_FLAT))} FROM events WHERE {STANDINS["scored"][1]["y"]} = 1),
    pairs AS (SELECT a.id, b.id AS other, {_GAP} AS gap FROM rare a JOIN rare b ON a.id <> b.id)
    SELECT id, other, gap, CAST(nth AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, other) AS nth FROM pairs) WHERE nth <= 5""",
    "gap",
)
def rare_neighbours(spark, sf):
    """The five nearest rows of the rarer class for each of its rows, without missing any."""
    rare = table(spark, sf, "events").where(F.expr(STANDINS["scored"][1]["y"]) == 1)
    return nearest_neighbours(rare.select(F.col("event_id").alias("id"), F.array(*[F.expr(e) for e in _FLAT]).alias("z")), 5)


@query("smote")
def smote(spark, sf):
    return T.smote(labelled(spark, sf), FEATURES, "id")


@query(
    "smote_class_counts",
    f"""{cte("scored")}, c AS (SELECT count(*) FILTER (WHERE y = 0) AS neg, count(*) FILTER (WHERE y = 1) AS pos FROM scored)
    SELECT CAST(0 AS INT) AS label, false AS synthetic, neg AS n FROM c UNION ALL SELECT 1, false, pos FROM c
    UNION ALL SELECT CASE WHEN pos <= neg THEN 1 ELSE 0 END, true, abs(neg - pos) FROM c WHERE neg <> pos""",
)
def smote_class_counts(spark, sf):
    return T.smote(labelled(spark, sf), FEATURES, "id").groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))
