"""The registered fits do all their work: iterations, families and rounds."""

import pytest
from pyspark.sql import functions as F

from tallyrisk.catalog import models as M
from tallyrisk.plans import training as T
from tallyrisk.plans.leafwise import Leafwise, Settings


@pytest.fixture(scope="module")
def split(spark):
    """Training rows and held-out rows of five features, one of which tells the classes apart."""
    rows = spark.range(0, 400, 1, 2).select(
        "id",
        (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("label"),
        *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(97)) / 97.0).alias(c) for c in M.FEATURES[1:]],
    )
    rows = rows.withColumn(M.FEATURES[0], F.col("label") + F.col("hour")).localCheckpoint()
    return T.with_class_weight(rows.where("id % 5 > 0"), balanced=True), rows.where("id % 5 = 0")


def test_network_runs_all_iterations(spark, split, monkeypatch):
    made, make = [], T.neural_net
    monkeypatch.setattr(M, "_split", lambda *a, **k: split)
    monkeypatch.setattr(T, "neural_net", lambda *a, **k: made.append(make(*a, **k)) or made[-1])
    row = M.train_mlp(spark, "").first()
    (net,) = [p.getStages()[-1] for p in made]
    assert net.getMaxIter() == 500 and net.getLayers() == [5, 100, 50, 2]
    assert row["tn"] + row["fp"] + row["fn"] + row["tp"] == 80 and row["auc"] > 0.8


def test_five_families_in_full_are_compared(spark, split, monkeypatch):
    asked = []
    monkeypatch.setattr(M, "_split", lambda *a, **k: split)
    monkeypatch.setattr(T, "compare_models", lambda estimators, train, test: asked.append((estimators, train, test)))
    M.compare_models(spark, "")
    ((found, train, test),) = asked
    last = {name: e.getStages()[-1] for name, e in found.items() if name != "leafwise_trees"}
    assert set(last) == {"logistic", "random_forest", "boosted_trees", "neural_net"} and len(found) == 5
    assert last["logistic"].getMaxIter() == 1000 and last["random_forest"].getNumTrees() == 100
    assert last["boosted_trees"].getMaxIter() == 100 and last["boosted_trees"].getMaxDepth() == 6
    assert last["neural_net"].getMaxIter() == 500 and found["leafwise_trees"].settings.rounds == 100
    weights = {r["label"]: (r["w"], r["fixed"]) for r in train.groupBy("label").agg(F.sum(T.WEIGHT).alias("w"), F.max(T.POSITIVES).alias("fixed")).collect()}
    assert weights[0][0] == pytest.approx(weights[1][0]) and (weights[0][1], weights[1][1]) == (1.0, 3.0)
    assert T.POSITIVES not in test.columns


def test_leafwise_trees_are_compared_with_other_families(spark, split):
    train, test = split
    few = {
        "logistic": T.logistic(M.FEATURES),
        "leafwise_trees": Leafwise(M.FEATURES, weight=T.WEIGHT, settings=Settings(rounds=5, leaves=4, step=0.3)),
        "no_information": T.logistic(M.FEATURES[2:3]),
    }
    side_by_side, in_turn = (T.compare_models(few, train, test, parallelism=n).collect() for n in (5, 1))
    assert side_by_side == in_turn and [r["auc"] for r in in_turn] == sorted((r["auc"] for r in in_turn), reverse=True)
    assert {r["model"] for r in in_turn} == set(few) and in_turn[-1]["model"] == "no_information"
    assert min(r["auc"] for r in in_turn[:2]) > 0.8
