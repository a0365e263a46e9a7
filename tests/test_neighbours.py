"""Exact neighbours against brute force: dense and scattered points, copies, ties, few points, any number of partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrisk.operators import neighbours as N


def brute(ids, z, k):
    gap = N.squared_distances(z, z)
    out = []
    for i in range(len(ids)):
        order = sorted((gap[i, j], int(ids[j])) for j in range(len(ids)) if j != i)[:k]
        out += [(int(ids[i]), other, g, r + 1) for r, (g, other) in enumerate(order)]
    return sorted(out)


def found(df, k):
    return sorted(tuple(r) for r in N.nearest_neighbours(df, k).select("id", "other", "gap", "rank").collect())


def frame(spark, ids, z, parts=4):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, z)], "id long, z array<double>").repartition(parts)


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_all_neighbours_are_found(spark, monkeypatch, parts):
    monkeypatch.setattr(N, "CELL_ROWS", 40)
    rng = np.random.default_rng(3)
    z = np.concatenate((rng.normal(size=(300, 3)), rng.normal(size=(200, 3)) * 0.01 + 2, rng.integers(0, 3, (150, 3)), np.full((60, 3), 7.0)))
    ids = rng.permutation(len(z)) * 3 - 100
    assert found(frame(spark, ids, z, parts), 5) == brute(ids, z, 5)


def test_recall_on_many_features(spark):
    """10,000 points with 20 features: every one of the k nearest is found, in cells of the production size."""
    rng = np.random.default_rng(11)
    z = rng.normal(size=(10_000, 20))
    got = {}
    for r in N.nearest_neighbours(frame(spark, range(len(z)), z), 5).collect():
        got.setdefault(r["id"], []).append((r["gap"], r["other"]))
    squares = (z * z).sum(axis=1)
    for at in range(0, len(z), 500):
        gap = squares[at : at + 500, None] + squares[None, :] - 2 * z[at : at + 500] @ z.T
        gap[np.arange(len(gap)), np.arange(at, at + len(gap))] = np.inf
        for i, near in enumerate(np.argpartition(gap, 5, axis=1)[:, :5]):
            assert {o for _, o in got[at + i]} == set(near.tolist())


def test_few_and_missing_points(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [-0.0]), (3, None), (9, [4.0])], "id long, z array<double>").withColumn("place", F.lit("x"))
    assert found(df, 5) == [(1, 2, 0.0, 1), (1, 9, 16.0, 2), (2, 1, 0.0, 1), (2, 9, 16.0, 2), (9, 1, 16.0, 1), (9, 2, 16.0, 2)]
    assert found(df.limit(0), 5) == [] and found(df.where("id = 9"), 5) == []


def test_visits_are_limited_to_cells_in_reach(spark, monkeypatch):
    """Clusters far apart: no point visits a cell of another cluster."""
    monkeypatch.setattr(N, "CELL_ROWS", 100)
    rng = np.random.default_rng(5)
    z = np.concatenate([rng.normal(size=(200, 2)) * 0.1 + 100 * c for c in range(4)])
    cells = N._in_cells(frame(spark, range(800), z).withColumnRenamed("id", "place"), 2)
    own = N._closest(cells.select("cell", "place", "z"), cells, 5, 2)
    reach = own.groupBy("place").agg(F.max("gap").alias("reach"))
    visits = N._visits(cells, reach, N._boxes(cells, 2), 2)
    homes = {r["place"]: r["cell"] for r in cells.collect()}
    cluster = {c: {p // 200 for p, own in homes.items() if own == c} for c in homes.values()}
    assert all(cluster[r["cell"]] == {r["place"] // 200} for r in visits.collect())


def test_boxes_are_compared_in_blocks(spark, monkeypatch):
    """Places with a reach and without, and rows from more than one block: the same visits as from all distances at once."""
    monkeypatch.setattr(N, "BOX_GAPS", 8)
    rng = np.random.default_rng(4)
    z, cell = rng.normal(size=(50, 2)), rng.integers(0, 3, 50)
    cells = spark.createDataFrame([(i, [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(z, cell))], "place long, z array<double>, cell int")
    reach = spark.createDataFrame([(i, 0.3) for i in range(0, 50, 2)], "place long, reach double")
    numbers, low, high = N._boxes(cells, 2)
    gap = (np.maximum(0, np.maximum(low[None] - z[:, None], z[:, None] - high[None])) ** 2).sum(axis=2)
    limit = np.where(np.arange(50) % 2 == 0, 0.3, np.inf)
    want = {(int(numbers[c]), r) for r, c in zip(*np.nonzero((gap <= limit[:, None]) & (numbers[None] != cell[:, None])))}
    got = N._visits(cells, reach, (numbers, low, high), 2).collect()
    assert len(got) == len(want) and {(r["cell"], r["place"]) for r in got} == want
    assert all(np.allclose(r["z"], z[r["place"]]) for r in got)
