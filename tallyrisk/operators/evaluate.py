"""Classifier evaluation on (label, score) rows: confusion, cost, AUC, curves, folds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from tallyrisk.operators.running import ranked, running_totals

# Cost of a missed default and of a refused good client.
COST_FN = 10
COST_FP = 1


def coarse_thresholds() -> list[float]:
    """0.10, 0.15 ... 0.90 with the float noise of a numeric range (its step is second minus first)."""
    step = (0.1 + 0.05) - 0.1
    return [0.1 + i * step for i in range(17)]


def fine_thresholds(points: int = 100) -> list[float]:
    """Evenly spaced points of [0, 1], both ends included."""
    step = 1.0 / (points - 1)
    return [i * step for i in range(points - 1)] + [1.0]


def predicted(score: Column | str, threshold: float) -> Column:
    c = F.col(score) if isinstance(score, str) else score
    return F.coalesce(c >= F.lit(threshold), F.lit(False)).cast("int")


def confusion(df: DataFrame, label: str, guess: str, groups: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp as four explicit counts (a class without rows counts 0)."""
    y, g = F.col(label), F.col(guess)
    return df.groupBy(*groups).agg(
        F.count_if((g == 0) & (y == 0)).alias("tn"),
        F.count_if((g == 1) & (y == 0)).alias("fp"),
        F.count_if((g == 0) & (y == 1)).alias("fn"),
        F.count_if((g == 1) & (y == 1)).alias("tp"),
    )


def _share(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def add_metrics(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy of confusion counts; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return df.withColumns(
        {
            "precision": _share(tp, tp + fp),
            "recall": _share(tp, tp + fn),
            "f1": _share(2 * tp, 2 * tp + fp + fn),
            "accuracy": _share(tp + tn, tp + tn + fp + fn),
        }
    )


def add_cost(df: DataFrame, cost_fn: float = COST_FN, cost_fp: float = COST_FP) -> DataFrame:
    return df.withColumn("cost", F.lit(cost_fn) * F.col("fn") + F.lit(cost_fp) * F.col("fp"))


def threshold_curve(
    df: DataFrame,
    label: str,
    score: str,
    thresholds: Sequence[float],
    groups: Sequence[str] = (),
    cost_fn: float = COST_FN,
    cost_fp: float = COST_FP,
) -> DataFrame:
    """Confusion counts, cost, precision and recall for every threshold from one pass.

    Rows are counted per (number of thresholds <= score, label): a partial aggregate with at most
    ``len(thresholds) + 1`` rows per group and task. Only those counts meet the thresholds."""
    marks = [float(t) for t in thresholds]
    bucketizer = Bucketizer(
        splits=[-math.inf, *marks, math.inf], inputCol="__score", outputCol="__bucket", handleInvalid="keep"
    )
    # A missing score is never predicted positive.
    rows = df.select(*groups, F.col(label).alias("__y"), F.coalesce(F.col(score).cast("double"), F.lit(-math.inf)).alias("__score"))
    counts = (
        bucketizer.transform(rows)
        .groupBy(*groups, F.col("__bucket").cast("int").alias("__bucket"))
        .agg(F.count_if(F.col("__y") == 1).alias("__pos"), F.count_if(F.col("__y") == 0).alias("__neg"))
    )
    grid = F.array(*[F.lit(t) for t in marks])
    met = counts.select(*groups, "__bucket", "__pos", "__neg", F.posexplode(grid).alias("__i", "threshold"))
    above = F.col("__bucket") > F.col("__i")

    def total(column: str, cond: Column) -> Column:
        return F.sum(F.when(cond, F.col(column)).otherwise(F.lit(0)))

    curve = met.groupBy(*groups, "threshold").agg(
        total("__neg", ~above).alias("tn"),
        total("__neg", above).alias("fp"),
        total("__pos", ~above).alias("fn"),
        total("__pos", above).alias("tp"),
    )
    return add_metrics(add_cost(curve, cost_fn, cost_fp))


def best_threshold(curve: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Lowest cost, then lowest threshold, with the metrics at that threshold."""
    order = F.struct("cost", "threshold")
    kept = ["threshold", "cost", "precision", "recall", "accuracy"]
    best = curve.groupBy(*groups).agg(F.min_by(F.struct(*kept), order).alias("b"))
    return best.select(*groups, "b.*")


def _score_counts(df: DataFrame, label: str, score: str, groups: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score, with the totals of the smaller scores."""
    counts = (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*groups, F.col(score).cast("double").alias("score"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    )
    return running_totals(counts, ["score"], ["pos", "neg"], groups)


def roc_auc(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve; equal scores count half. Null if one class is absent."""
    run = _score_counts(df, label, score, groups)
    area = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
    pairs = F.max("pos_total").cast("double") * F.max("neg_total").cast("double")
    return run.groupBy(*groups).agg(F.try_divide(area, pairs).alias("auc"))


def _curve_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row per distinct score used as threshold (score >= threshold is positive)."""
    run = _score_counts(df, label, score, [])
    return run.select(
        F.col("score").alias("threshold"),
        (F.col("pos_total") - F.col("pos_before")).alias("tp"),
        (F.col("neg_total") - F.col("neg_before")).alias("fp"),
        "pos_total",
        "neg_total",
    )


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, and the origin with a null threshold."""
    points = _curve_points(df, label, score).select(
        "threshold",
        F.try_divide("fp", "neg_total").alias("fpr"),
        F.try_divide("tp", "pos_total").alias("tpr"),
    )
    origin = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], points.schema)
    return points.unionByName(origin)


def pr_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, precision, recall) for every distinct score, and the end point (1, 0)."""
    points = _curve_points(df, label, score).select(
        "threshold",
        _share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _share(F.col("tp"), F.col("pos_total")).alias("recall"),
    )
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], points.schema)
    return points.unionByName(end)


# --- folds ------------------------------------------------------------------------------------


def _shuffle_key(keys: Sequence[str], seed: int) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))


def assign_folds(df: DataFrame, keys: Sequence[str], k: int, seed: int = 1001, label: str | None = None) -> DataFrame:
    """Fold 0..k-1 per row. Plain: by key hash. With a label: rows of each class are dealt out in
    hash order, so class sizes per fold differ by at most one; rows without a label get no fold."""
    if label is None:
        return df.withColumn("fold", F.pmod(_shuffle_key(keys, seed), F.lit(k)).cast("int"))
    placed = _numbered(df, keys, label, seed)
    fold = F.when(F.col(label).isNotNull(), F.pmod(F.col("position"), F.lit(k)).cast("int"))
    return placed.select(*df.columns, fold.alias("fold"))


def _numbered(df: DataFrame, keys: Sequence[str], label: str, seed: int) -> DataFrame:
    """The rows with their position in hash order among the rows of their class; rows without a label are
    a class of their own, so none is lost, and repeated keys get positions of their own."""
    marked = df.withColumns(
        {
            "__unlabelled": F.col(label).isNull(),
            "__class": F.coalesce(F.col(label).cast("string"), F.lit("")),
            "__mix": _shuffle_key(keys, seed),
        }
    )
    return ranked(marked, ["__mix", *keys], ["__unlabelled", "__class"])


def holdout(df: DataFrame, keys: Sequence[str], label: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``is_valid``: the first ``share`` of every class in hash order; null for rows without a label."""
    placed = _numbered(df, keys, label, seed)
    first = F.col("position") < F.round(F.col("group_size") * F.lit(share))
    return placed.select(*df.columns, F.when(F.col(label).isNotNull(), first).alias("is_valid"))


def cv_metrics(df: DataFrame, label: str, score: str, fold: str = "fold", points: int = 100) -> DataFrame:
    """Per fold: AUC, accuracy and cost at the fold's own best threshold."""
    auc = roc_auc(df, label, score, [fold])
    best = best_threshold(threshold_curve(df, label, score, fine_thresholds(points), [fold]), [fold])
    return auc.join(best.select(fold, "threshold", "cost", "accuracy"), fold)


def cv_summary(per_fold: DataFrame) -> DataFrame:
    """Mean and population spread over the folds."""
    out = []
    for c in ("auc", "accuracy", "cost", "threshold"):
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return per_fold.agg(F.count(F.lit(1)).alias("n_folds"), *out)


def top_importances(df: DataFrame, n: int = 40) -> DataFrame:
    """Mean importance per feature over the folds, largest first."""
    mean = df.groupBy("feature").agg(F.avg("importance").alias("importance"))
    return mean.orderBy(F.desc("importance"), "feature").limit(n)
