"""Leaf-wise boosting against a plain version, its stored form in another engine, and MLlib's trees."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrisk.operators.evaluate import roc_auc
from tallyrisk.plans import leafwise as G, training as T

FEATURES = ["a", "b", "c"]


def rows(n, seed):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({"id": range(n), "a": rng.normal(size=n), "b": rng.integers(0, 6, n).astype(float), "c": rng.normal(size=n).round(1)})
    frame.loc[rng.random(n) < 0.2, "c"] = np.nan
    signal = frame.a * (frame.b > 2) + np.where(frame.c.isna(), 1.0, frame.c.fillna(0) ** 2 - 1)
    frame["label"] = (signal + rng.normal(size=n) > 0.3).astype(int)
    return frame


def spark_rows(spark, frame, parts=3):
    df = spark.createDataFrame(frame).repartition(parts)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in FEATURES})


def brute_tree(bins, g, h, s, scale):
    """Grow by trying every split of every leaf, one split at a time; (node of each row, values, splits in order)."""
    worth = lambda m: G._shrunk(np.float64(g[m].sum() / scale), s.l1) ** 2 / (h[m].sum() / scale + s.l2)
    leaves, splits = [np.ones(len(bins), bool)], []

    def best(m):
        found = None
        for f in range(bins.shape[1]):
            for cut in range(1, G.BINS):
                for missing_left in (True, False):
                    left = m & np.where(bins[:, f] == 0, missing_left, bins[:, f] <= cut)
                    right = m & ~left
                    if left.sum() < s.min_rows or right.sum() < s.min_rows:
                        continue
                    gain = worth(left) + worth(right) - worth(m)
                    if gain > max(s.min_gain, found[0] + 1e-12 if found else -math.inf):
                        found = (gain, f, cut, missing_left, left, right)
        return found

    options = [best(leaves[0])]
    while len(leaves) < s.leaves and any(options):
        at = max((i for i, o in enumerate(options) if o), key=lambda i: options[i][0])
        _, f, cut, missing_left, left, right = options[at]
        splits.append((f, int(left.sum()), int(right.sum())))
        leaves[at : at + 1], options[at : at + 1] = [left, right], [best(left), best(right)]
    values = np.zeros(len(bins))
    for m in leaves:
        values[m] = -G._shrunk(np.float64(g[m].sum() / scale), s.l1) / (h[m].sum() / scale + s.l2) * s.step
    return values, splits


def test_same_trees_as_trying_every_split(spark):
    frame = rows(500, 1)
    s = G.Settings(rounds=3, leaves=7, row_share=1.0, column_share=1.0, min_rows=15, step=0.3)
    model = G.fit_leafwise(spark_rows(spark, frame), FEATURES, settings=s)
    bins = G.bins_of(frame[FEATURES].to_numpy(), model.edges)
    score, y, scale = np.full(500, model.base), frame.label.to_numpy(float), 2.0**40
    assert model.base == pytest.approx(math.log(y.sum() / (1 - y).sum())) and len(model.trees) == 3
    for tree in model.trees:
        g, h = G.gradients(y, np.ones(500), score, scale)
        values, splits = brute_tree(bins, g, h, s, scale)
        assert sorted(splits) == sorted(_splits(tree, bins))
        assert tree.scores(bins) == pytest.approx(values, abs=1e-9)
        score = score + tree.scores(bins)


def _splits(tree, bins):
    def below(node, m):
        f = tree.feature[node]
        if f < 0:
            return
        left = m & np.where(bins[:, f] == 0, tree.missing_left[node], bins[:, f] <= tree.cut[node])
        yield f, int(left.sum()), int((m & ~left).sum())
        yield from below(tree.left[node], left)
        yield from below(tree.right[node], m & ~left)

    return list(below(0, np.ones(len(bins), bool)))


def test_partitions_do_not_change_the_trees(spark, monkeypatch):
    """Sampling by the row itself and exact sums; scores are written down in between."""
    monkeypatch.setattr(G, "TREES_PER_WRITE", 2)
    frame = rows(800, 2)
    s = G.Settings(rounds=5, leaves=9, step=0.2)
    a, b = (G.fit_leafwise(spark_rows(spark, frame, parts), FEATURES, settings=s) for parts in (1, 13))
    assert a.trees == b.trees and len(a.trees) == 5 and max(len(t.feature) for t in a.trees) == 17


def test_stored_trees_score_the_same_in_sql(spark, tmp_path):
    frame = rows(600, 3)
    df = spark_rows(spark, frame)
    model = G.fit_leafwise(df, FEATURES, settings=G.Settings(rounds=4, leaves=6, step=0.3))
    model.table(spark).write.parquet(str(tmp_path / "trees"))
    expression = G.score_sql(spark.read.parquet(str(tmp_path / "trees")).collect())
    got = model.transform(df).toPandas().set_index("id").sort_index()
    db = duckdb.connect()
    db.register("frame", frame)
    want = db.sql(f"SELECT id, {expression} AS p FROM (SELECT id, {', '.join(f'CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}' for c in FEATURES)} FROM frame)").df().set_index("id").sort_index()
    assert got.probability_1.to_numpy() == pytest.approx(want.p.to_numpy(), abs=1e-12)
    assert set(model.importances()) == set(FEATURES) and sum(model.importances().values()) == sum(f >= 0 for t in model.trees for f in t.feature)


def test_early_stop_and_quality(spark):
    """Held-out AUC is not below that of MLlib's depth-wise trees; boosting stops when the validation loss rises."""
    train, test = spark_rows(spark, rows(3000, 4)), spark_rows(spark, rows(2000, 5))
    train = train.withColumn("is_valid", F.col("id") % 5 == 0)
    model = G.fit_leafwise(train, FEATURES, validation="is_valid", settings=G.Settings(rounds=40, leaves=8, step=0.3, patience=3))
    assert 0 < len(model.trees) < 40 and model.losses[len(model.trees)] == min(model.losses)
    own = roc_auc(model.transform(test), "label", "probability_1").first()[0]
    filled = lambda d: d.na.fill(-9.0, FEATURES)
    theirs = T.boosted_trees(FEATURES, weight=None, maxIter=len(model.trees), stepSize=0.3).fit(filled(train.where("NOT is_valid")))
    other = roc_auc(T.with_probability(theirs, filled(test)), "label", "score").first()[0]
    assert own >= other - 0.005 and own > 0.8


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, None, float(i), 1.0, 1) for i in range(50)], "id INT, a DOUBLE, b DOUBLE, c DOUBLE, label INT")
    one = G.fit_leafwise(df, FEATURES)
    assert one.trees == [] and one.base > 0
    assert G.fit_leafwise(df.limit(0), FEATURES).base == 0.0
    mixed = df.withColumn("label", F.when(F.col("id") % 10 != 3, (F.col("id") > 25).cast("int")))
    model = G.fit_leafwise(mixed, FEATURES, settings=G.Settings(rounds=2, leaves=3, min_rows=5))
    scored = model.transform(mixed.withColumn("__y", F.lit("kept")))
    assert scored.count() == 50 and scored.columns == [*mixed.columns, "__y", "probability_1"]
    assert scored.where("id > 26").agg(F.min("probability_1")).first()[0] > scored.where("id < 25").agg(F.max("probability_1")).first()[0]


def test_sums_of_many_tasks_are_shuffled_to_the_same_trees(spark, monkeypatch):
    df, s = spark_rows(spark, rows(900, 5), 4), G.Settings(rounds=3, leaves=5, step=0.3)
    few = G.fit_leafwise(df, FEATURES, settings=s)
    monkeypatch.setattr(G, "DIRECT_TASKS", 0)
    many = G.fit_leafwise(df, FEATURES, settings=s)
    assert few.trees == many.trees and few.losses == many.losses and len(few.trees) == 3


def _random_tree(rng, leaves, features):
    tree = G.Tree()
    ends = [tree.add()]
    while len(ends) < leaves:
        node = ends.pop(rng.integers(len(ends)))
        left, right = tree.add(), tree.add()
        tree.split(node, int(rng.integers(features)), int(rng.integers(1, G.BINS)), bool(rng.integers(2)), left, right)
        ends += [left, right]
    tree.value = [float(v) for v in rng.normal(size=len(tree.feature))]
    return tree


@pytest.mark.parametrize("leaves", [1, 2, 34, 64, 65, 200])
def test_leaves_are_found_without_walking_down(leaves):
    rng = np.random.default_rng(leaves)
    tree = _random_tree(rng, leaves, 4)
    bins = rng.integers(0, G.BINS, (500, 4)).astype(np.uint8)
    bins[rng.random((500, 4)) < 0.2] = 0
    for row, found in zip(bins, G.Finder(tree).node_of(bins)):
        node = 0
        while tree.feature[node] >= 0:
            value = row[tree.feature[node]]
            node = (tree.left if (tree.missing_left[node] if value == 0 else value <= tree.cut[node]) else tree.right)[node]
        assert found == node
    assert np.array_equal(tree.scores(bins), np.array(tree.value)[tree.node_of(bins)])


@pytest.mark.parametrize("top", [1 << 20, 1 << 50, 1 << 58])
def test_sums_are_exact(top):
    rng = np.random.default_rng(7)
    bins, place = rng.integers(0, G.BINS, (2, 3000)).astype(np.uint8), rng.integers(0, 2, 3000)
    bins[0] = 5
    g, h = (rng.integers(-top, top, 3000) // 3000 * 2 + 1 for _ in range(2))
    sums = G.node_sums(bins, place, 2, g, h)
    for p in range(2):
        assert [int(x) for x in sums[p, :, 0, 5]] == [sum(int(v) for v in g[place == p]), sum(int(v) for v in h[place == p]), int((place == p).sum())]
    assert sums[:, :, 1].sum() == sums[:, :, 0].sum()
    assert not G.node_sums(bins, place, 2, g, h, [1])[:, :, 0].any()


def test_rows_are_kept_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(G, "CHUNK_ROWS", 100)
    frame = rows(700, 8)
    df = spark_rows(spark, frame, 2)
    edges = G.fit_edges(df, FEATURES)
    columns = [F.col("label").cast("double").alias("y"), F.lit(1.5).alias("w"), (F.col("id") < 50).alias("held"), F.col("id").cast("long").alias("mix")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        chunks = G._chunks(df, FEATURES, edges, columns).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(len(c.y) for c in chunks) <= 100 and len(chunks) <= 12
    ids = np.concatenate([c.mix for c in chunks])
    order = np.argsort(ids)
    assert np.array_equal(ids[order], frame.id) and np.array_equal(np.concatenate([c.y for c in chunks])[order], frame.label)
    assert np.array_equal(np.concatenate([c.bins.T for c in chunks])[order], G.bins_of(frame[FEATURES].to_numpy(), edges))
    assert sum(c.held.sum() for c in chunks) == 50
