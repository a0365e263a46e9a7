"""Classifier evaluation and drift against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrisk.operators import drift as D, evaluate as E
from tallyrisk.operators.running import long_form


@pytest.fixture(scope="module")
def scored():
    rng = np.random.default_rng(11)
    y = (rng.random(3000) < 0.2).astype(int)
    return pd.DataFrame({"id": range(3000), "y": y, "s": np.round(np.clip(rng.normal(0.35 + 0.2 * y, 0.2), 0, 1), 2)})


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])


def test_auc_with_ties(spark, scored):
    df = spark.createDataFrame(scored)
    auc = E.roc_auc(df, "y", "s").first()["auc"]
    assert auc == pytest.approx(brute_auc(scored.y.to_numpy(), scored.s.to_numpy()))
    assert E.roc_auc(df.withColumn("s", -F.col("s")), "y", "s").first()["auc"] == pytest.approx(1 - auc)


def test_auc_of_one_class_is_null(spark):
    assert E.roc_auc(spark.createDataFrame([(0, 0.1), (0, 0.2)], "y INT, s DOUBLE"), "y", "s").first()["auc"] is None


def test_area_under_the_points_is_the_auc(spark, scored):
    pts = E.roc_points(spark.createDataFrame(scored), "y", "s").toPandas().sort_values(["fpr", "tpr"])
    assert np.trapezoid(pts.tpr, pts.fpr) == pytest.approx(brute_auc(scored.y.to_numpy(), scored.s.to_numpy()))
    assert (pts.tpr.iloc[0], pts.fpr.iloc[-1], pts.tpr.iloc[-1]) == (0, 1, 1)


def test_precision_recall_points(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y INT, s DOUBLE")
    got = {(r["threshold"], round(r["precision"], 4), r["recall"]) for r in E.pr_points(df, "y", "s").collect()}
    assert got == {(0.9, 1.0, 0.5), (0.8, 0.6667, 1.0), (0.1, 0.5, 1.0), (None, 1.0, 0.0)}


def test_thresholds_have_the_usual_float_noise():
    assert E.coarse_thresholds() == pytest.approx(list(np.arange(0.1, 0.95, 0.05)), abs=0)
    assert E.fine_thresholds() == list(np.linspace(0.0, 1.0, 100))


def test_threshold_curve_matches_a_loop(spark, scored):
    rows = scored.assign(s=scored.s.where(scored.id % 50 != 0))
    df = spark.createDataFrame(rows).withColumn("s", F.when(~F.isnan("s"), F.col("s")))
    curve = E.threshold_curve(df, "y", "s", E.fine_thresholds()).toPandas().sort_values("threshold")
    for r in curve.itertuples():
        guess = rows.s.fillna(-1) >= r.threshold
        assert r.fn == (~guess & (rows.y == 1)).sum() and r.fp == (guess & (rows.y == 0)).sum()
        assert r.cost == 10 * r.fn + r.fp and r.tn + r.fp + r.fn + r.tp == len(rows)
    best = E.best_threshold(E.threshold_curve(df, "y", "s", E.fine_thresholds())).first()
    first = curve[curve.cost == curve.cost.min()].iloc[0]
    assert (best["threshold"], best["cost"]) == (first.threshold, first.cost)


def test_one_class_confusion(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.9)], "y INT, s DOUBLE").withColumn("g", E.predicted("s", 0.5))
    row = E.add_metrics(E.add_cost(E.confusion(df, "y", "g"))).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"], row["cost"]) == (1, 1, 0, 0, 1)
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0, 0, 0, 0.5)


def test_folds_are_stratified_and_repeatable(spark, scored):
    df = spark.createDataFrame(scored)
    a = E.assign_folds(df, ["id"], 5, label="y").toPandas()
    sizes = a.groupby(["y", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1)).max() <= 1 and len(a) == len(scored)
    b = E.assign_folds(df.repartition(7), ["id"], 5, label="y").toPandas()
    assert a.set_index("id").fold.sort_index().equals(b.set_index("id").fold.sort_index())


def test_holdout_share(spark, scored):
    got = E.holdout(spark.createDataFrame(scored), ["id"], "y").toPandas()
    for _, part in got.groupby("y"):
        assert abs(part.is_valid.sum() - 0.1 * len(part)) <= 0.5


# --- drift -------------------------------------------------------------------------------------------


def brute_ks(a, b):
    grid = np.unique(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(np.sort(x), grid, side="right") / len(x) for x in (a, b))
    d = np.abs(fa - fb).max()
    w = (np.abs(fa - fb)[:-1] * np.diff(grid)).sum()
    ne = math.sqrt(len(a) * len(b) / (len(a) + len(b)))
    lam = (ne + 0.12 + 0.11 / ne) * d
    p = 1.0 if lam < 0.2 else min(1, max(0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam) for j in range(1, 101))))
    return d, p, w


def test_drift_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    ref = pd.DataFrame({"same": rng.normal(size=400), "moved": rng.normal(size=400), "holes": rng.normal(size=400), "flat": 1.0, "old": rng.normal(size=400)})
    cur = pd.DataFrame({"same": rng.normal(size=150), "moved": rng.normal(1, 1, 150), "holes": rng.normal(size=150), "flat": rng.normal(size=150), "new": 1.0})
    ref.loc[::5, "holes"] = np.nan
    cur.loc[::3, "holes"] = np.nan
    a, b = spark.createDataFrame(ref), spark.createDataFrame(cur)
    counts = D.side_counts(long_form(a, a.columns), long_form(b, b.columns), 400, 150)
    validity = {r["feature"]: r["is_valid"] for r in D.feature_validity(counts).collect()}
    assert validity == {"same": True, "moved": True, "holes": True, "flat": False}
    got = D.drift_tests(counts).toPandas().set_index("feature")
    fill = ref["holes"].median()
    for f in ("same", "moved", "holes"):
        x, y = (d[f].fillna(fill).to_numpy() for d in (ref, cur))
        ks, p, w = brute_ks(x, y)
        sd = x.std(ddof=1)
        r = got.loc[f]
        assert (r.ks, r.p_value, r.wasserstein) == pytest.approx((ks, p, w / sd))
        assert r.mean_shift == pytest.approx((y.mean() - x.mean()) / sd) and r.drifted == (p < 0.05)
    verdict = D.drift_verdict(D.drift_tests(counts)).first()
    assert verdict["enabled"] and verdict["n_features_compared"] == 3 and got.loc["moved", "drifted"]


def test_equal_samples_do_not_drift(spark):
    df = spark.createDataFrame([(float(i),) for i in range(50)], "v DOUBLE")
    row = D.drift_tests(D.side_counts(long_form(df, ["v"]), long_form(df, ["v"]), 50, 50)).first()
    assert (row["ks"], row["p_value"], row["drifted"], row["wasserstein"]) == (0.0, 1.0, False, 0.0)
