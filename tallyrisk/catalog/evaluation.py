"""Classifier evaluation on given scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrisk.catalog.base import query
from tallyrisk.catalog.standins import cte, standin
from tallyrisk.operators import evaluate as E

SCORED = cte("scored")


def _rows(spark, sf):
    return standin(spark, sf, "scored")


def _conf(p: str) -> str:
    return (
        f"count(*) FILTER (WHERE NOT {p} AND y = 0) AS tn, count(*) FILTER (WHERE {p} AND y = 0) AS fp, "
        f"count(*) FILTER (WHERE NOT {p} AND y = 1) AS fn, count(*) FILTER (WHERE {p} AND y = 1) AS tp"
    )


_METRICS = """coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS "precision", coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0)::DOUBLE, 0) AS accuracy"""


@query("confusion_counts", f"{SCORED} SELECT fold, {_conf('(score >= 0.4889)')} FROM scored GROUP BY fold")
def confusion_counts(spark, sf):
    return E.confusion(_rows(spark, sf).withColumn("guess", E.predicted("score", 0.4889)), "y", "guess", ["fold"])


@query("classification_metrics", f"{SCORED}, c AS (SELECT {_conf('(score >= 0.5)')} FROM scored) SELECT *, {_METRICS} FROM c", "precision recall f1 accuracy")
def classification_metrics(spark, sf):
    return E.add_metrics(E.confusion(_rows(spark, sf).withColumn("guess", E.predicted("score", 0.5)), "y", "guess"))


@query("business_cost", f"{SCORED}, c AS (SELECT fold, {_conf('(score >= 0.3)')} FROM scored GROUP BY fold) SELECT fold, 10 * fn + fp AS cost FROM c")
def business_cost(spark, sf):
    counts = E.confusion(_rows(spark, sf).withColumn("guess", E.predicted("score", 0.3)), "y", "guess", ["fold"])
    return E.add_cost(counts).select("fold", "cost")


def _grid(thresholds) -> str:
    return "grid(threshold) AS (VALUES " + ", ".join(f"({t!r}::DOUBLE)" for t in thresholds) + ")"


_COARSE = f"""{SCORED}, {_grid(E.coarse_thresholds())}, c AS (SELECT threshold, {_conf('(score >= threshold)')} FROM scored, grid GROUP BY threshold)"""


@query(
    "threshold_cost_curve",
    f"{_COARSE} SELECT *, 10 * fn + fp AS cost, {_METRICS} FROM c",
    "threshold precision recall f1 accuracy",
)
def threshold_cost_curve(spark, sf):
    return E.threshold_curve(_rows(spark, sf), "y", "score", E.coarse_thresholds())


_FINE = f"{SCORED}, {_grid(E.fine_thresholds())}, c AS (SELECT threshold, {_conf('(score >= threshold)')} FROM scored, grid GROUP BY threshold)"


@query(
    "threshold_optimal",
    f"{_FINE} SELECT threshold, 10 * fn + fp AS cost, {_METRICS} FROM c ORDER BY cost, threshold LIMIT 1",
    "threshold precision recall f1 accuracy",
)
def threshold_optimal(spark, sf):
    curve = E.threshold_curve(_rows(spark, sf), "y", "score", E.fine_thresholds())
    best = E.best_threshold(curve)
    return best.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


_AUC = """SELECT {g} sum(p * (below + n / 2.0)) / (max(pt)::DOUBLE * max(nt)) AS auc FROM (
    SELECT {g} p, n, coalesce(sum(n) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(p) OVER ({part}) AS pt, sum(n) OVER ({part}) AS nt
    FROM (SELECT {g} score, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM scored GROUP BY {g} score)) {by}"""


@query("roc_auc", f"{SCORED} {_AUC.format(g='', part='', by='')}", "auc")
def roc_auc(spark, sf):
    return E.roc_auc(_rows(spark, sf), "y", "score")


_POINTS = """pts AS (SELECT score AS threshold, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pt, sum(n) OVER () AS nt FROM
    (SELECT score, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM scored GROUP BY score) WINDOW w AS (ORDER BY score DESC))"""


@query(
    "roc_curve",
    f"{SCORED}, {_POINTS} SELECT threshold, fp / nt::DOUBLE AS fpr, tp / pt::DOUBLE AS tpr FROM pts UNION ALL SELECT NULL, 0.0, 0.0",
    "threshold fpr tpr",
)
def roc_curve(spark, sf):
    return E.roc_points(_rows(spark, sf), "y", "score")


@query(
    "pr_curve",
    f"""{SCORED}, {_POINTS} SELECT threshold, tp / (tp + fp)::DOUBLE AS "precision", tp / pt::DOUBLE AS recall FROM pts UNION ALL SELECT NULL, 1.0, 0.0""",
    "threshold precision recall",
)
def pr_curve(spark, sf):
    return E.pr_points(_rows(spark, sf), "y", "score")


_CV = f"""{SCORED}, {_grid(E.fine_thresholds())}, c AS (SELECT fold, threshold, {_conf('(score >= threshold)')} FROM scored, grid GROUP BY fold, threshold),
    k AS (SELECT fold, threshold, 10 * fn + fp AS cost, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy, row_number() OVER (PARTITION BY fold ORDER BY 10 * fn + fp, threshold) AS rn FROM c),
    a AS ({_AUC.format(g='fold,', part='PARTITION BY fold', by='GROUP BY fold')}), per AS (SELECT fold, auc, threshold, cost, accuracy FROM k JOIN a USING (fold) WHERE rn = 1)"""


@query("cv_fold_metrics", f"{_CV} SELECT * FROM per", "auc threshold accuracy")
def cv_fold_metrics(spark, sf):
    return E.cv_metrics(_rows(spark, sf), "y", "score")


@query(
    "cv_summary",
    f"{_CV} SELECT count(*) AS n_folds, {', '.join(f'avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std' for c in ('auc', 'accuracy', 'cost', 'threshold'))} FROM per",
    [f"{c}_{s}" for c in ("auc", "accuracy", "cost", "threshold") for s in ("mean", "std")],
)
def cv_summary(spark, sf):
    return E.cv_summary(E.cv_metrics(_rows(spark, sf), "y", "score"))


@query("assign_folds")
def assign_folds(spark, sf):
    return E.assign_folds(_rows(spark, sf).drop("fold"), ["id"], 5, label="y")


@query("holdout_split")
def holdout_split(spark, sf):
    return E.holdout(_rows(spark, sf).drop("fold"), ["id"], "y")


_SIZES = f"{SCORED}, s AS (SELECT y, count(*) AS n FROM scored GROUP BY y)"


@query(
    "fold_sizes",
    f"""{_SIZES} SELECT y, CAST(fold AS INT) AS fold, n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS n FROM s, range(5) t(fold)""",
)
def fold_sizes(spark, sf):
    folds = E.assign_folds(_rows(spark, sf).drop("fold"), ["id"], 5, label="y")
    return folds.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("holdout_sizes", f"{_SIZES} SELECT y, n, CAST(floor(n * 0.1 + 0.5) AS BIGINT) AS n_valid FROM s")
def holdout_sizes(spark, sf):
    rows = E.holdout(_rows(spark, sf).drop("fold"), ["id"], "y")
    return rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("n_valid"))
