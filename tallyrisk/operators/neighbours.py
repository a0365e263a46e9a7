"""Exact k nearest neighbours as a distributed join, without comparing everything with everything.

Space is cut into cells by a k-d tree whose planes are medians of a bounded sample; every point is put into its cell. First
each point looks in its own cell, which gives k distances or fewer; the k-th bounds where nearer points can be. Then it
visits those other cells whose box of coordinates is no further away than that, and no others, so the
result is exact whatever the planes are: they decide how much is compared, not what is found. In each task a block of
visiting points meets the points of one cell as blocks of a matrix.

Equal points are one place: a place keeps the k + 1 smallest ids and stands for all of its points, so copies of
one point neither fill a cell nor multiply the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tallyrisk.operators.joins import spread_join
from tallyrisk.session import settle

# Rows of the sample that the planes are taken from; more cells mean larger ones beyond MAX_CELLS.
SAMPLE_ROWS = 50_000
CELL_ROWS = 2_000
MAX_CELLS = 16_384
# Visiting points that meet a cell in one task, and those that are compared at a time.
VISITORS = 20_000
BLOCK = 128
# Distances from points to boxes that a task holds at a time.
BOX_GAPS = 1 << 18


class Planes:
    """A k-d tree: inner node i has the children 2i + 1 and 2i + 2; leaves are cells."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros((1 << depth) - 1, dtype=np.int64)
        self.cut = np.zeros((1 << depth) - 1)
        parts = {0: sample}
        for node in range(len(self.axis)):
            own = parts.pop(node)
            if len(own):
                self.axis[node] = int(np.argmax(np.ptp(own, axis=0)))
                self.cut[node] = np.median(own[:, self.axis[node]])
            right = own[:, self.axis[node]] > self.cut[node]
            parts[2 * node + 1], parts[2 * node + 2] = own[~right], own[right]

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - len(self.axis)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of squared differences in the order of the dimensions: the same number wherever and with whomever it is computed."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        total += gap * gap
    return total


def nearest(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, squared distance) of the k nearest rows of b for each row of a, in order; of equal distances the
    earlier row of b."""
    found = []
    for at in range(0, len(a), BLOCK):
        gap = squared_distances(a[at : at + BLOCK], b)
        limit = np.partition(gap, k - 1, axis=1)[:, k - 1 : k] if len(b) > k else np.full((len(gap), 1), np.inf)
        row, col = np.nonzero(gap <= limit)
        near = gap[row, col]
        order = np.lexsort((col, near, row))
        row, col, near = row[order], col[order], near[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        best = rank < k
        found.append((row[best] + at, col[best], near[best]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _in_cells(places: DataFrame, dims: int) -> DataFrame:
    """places with their cell; the planes (at most MAX_CELLS of them) are broadcast with the task."""
    n = places.count()
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    picked = places.where(F.pmod(F.xxhash64("place"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(2 * SAMPLE_ROWS)
    sample = np.array([r["z"] for r in picked.select("z").collect()], dtype=np.float64).reshape(-1, dims)
    depth = max(0, int(np.ceil(np.log2(max(1, min(n / CELL_ROWS, MAX_CELLS))))))
    planes = Planes(sample, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = planes.cells(_matrix(batch.column("z"), dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32))], names=[*batch.schema.names, "cell"])

    return settle(places.mapInArrow(run, T.StructType([*places.schema.fields, T.StructField("cell", T.IntegerType())])))


def _closest(visits: DataFrame, cells: DataFrame, k: int, dims: int) -> DataFrame:
    """(place, other, gap): for each visit (cell, place, z) the k nearest places of that cell; a place is not its own
    neighbour. Visitors of a cell are dealt out in blocks, each with the cell's points."""
    per_cell = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("blocks"))
    dealt = visits.join(F.broadcast(per_cell), "cell").select("cell", F.pmod(F.xxhash64("place"), "blocks").cast("int").alias("block"), "place", "z", F.lit(True).alias("visits"))
    hosts = cells.join(F.broadcast(per_cell), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "place", "z", F.lit(False).alias("visits"))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("place")
        visiting = group.column("visits").to_numpy()
        place, z = group.column("place").to_numpy(), _matrix(group.column("z").combine_chunks(), dims)
        guests, hosts_ = place[visiting], place[~visiting]
        row, col, gap = nearest(z[visiting], z[~visiting], k + 1)
        other = guests[row] != hosts_[col]
        row, col, gap = row[other], col[other], gap[other]
        first = (np.arange(len(row)) - np.searchsorted(row, row)) < k
        return pa.table({"place": guests[row[first]], "other": hosts_[col[first]], "gap": gap[first]})

    return dealt.unionByName(hosts).groupBy("cell", "block").applyInArrow(run, "place long, other long, gap double")


def _boxes(cells: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, low, high) of the cells that have points, at most MAX_CELLS."""
    ends = [f(F.get("z", F.lit(j))).alias(f"{name}{j}") for j in range(dims) for f, name in ((F.min, "l"), (F.max, "h"))]
    frame: pd.DataFrame = cells.groupBy("cell").agg(*ends).toPandas()
    box = lambda name: frame[[f"{name}{j}" for j in range(dims)]].to_numpy()
    return frame["cell"].to_numpy(), box("l"), box("h")


def _visits(cells: DataFrame, reach: DataFrame, boxes: tuple, dims: int) -> DataFrame:
    """(cell, place, z): for each place the other cells whose box is within its reach (null: all other cells)."""
    numbers, low, high = boxes
    rows = cells.join(reach, "place", "left").select("place", "z", "cell", "reach")

    def reached(z: np.ndarray, own: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = np.zeros((len(z), len(numbers)))
        for j in range(dims):
            out = np.maximum(0.0, np.maximum(low[None, :, j] - z[:, j, None], z[:, j, None] - high[None, :, j]))
            gap += out * out
        return np.nonzero((gap <= limit[:, None]) & (numbers[None, :] != own[:, None]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _matrix(batch.column("z"), dims)
            own = batch.column("cell").to_numpy()
            limit = np.nan_to_num(batch.column("reach").to_numpy(zero_copy_only=False).astype(np.float64), nan=np.inf)
            step = max(1, BOX_GAPS // len(numbers))
            for at in range(0, len(z), step):
                row, col = reached(z[at : at + step], own[at : at + step], limit[at : at + step])
                spot = pa.array(row + at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[col].astype(np.int32)), batch.column("place").take(spot), batch.column("z").take(spot)],
                    names=["cell", "place", "z"],
                )

    return rows.mapInArrow(run, "cell int, place long, z array<double>")


def _best(found: DataFrame, k: int) -> DataFrame:
    line = Window.partitionBy("place").orderBy("gap", "other")
    return found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)


def nearest_neighbours(points: DataFrame, k: int, key: str = "id", vector: str = "z") -> DataFrame:
    """(key, other, gap, rank): for each point the k others with the smallest squared distance, of equal ones those with
    the smaller key; fewer if there are fewer points. Keys are unique whole numbers; vectors have one length and hold
    finite numbers; a point without a vector is left out. An empty table gives an empty table."""
    rows = points.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("z")).where(F.col(vector).isNotNull())
    # Negative zeros are zeros, and a place is named by its smallest id.
    rows = rows.withColumn("z", F.transform("z", lambda v: v + F.lit(0.0)))
    line = Window.partitionBy("z").orderBy("id")
    firsts = rows.withColumn("nth", F.row_number().over(line)).where(F.col("nth") <= k + 1)
    places = settle(firsts.groupBy("z").agg(F.min("id").alias("place"), F.sort_array(F.collect_list("id")).alias("ids")))  # k + 1 ids at most
    head = places.select(F.size("z").alias("n")).first()
    if head is None:
        return rows.select("id", F.col("id").alias("other"), F.lit(0.0).alias("gap"), F.lit(1).alias("rank")).limit(0)
    dims = head["n"]
    cells = _in_cells(places.select("place", "z"), dims)
    own = settle(_closest(cells.select("cell", "place", "z"), cells, k, dims))
    reach = own.groupBy("place").agg(F.max("gap").alias("reach"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    visits = settle(_visits(cells, reach.select("place", "reach"), _boxes(cells, dims), dims))
    near = settle(_best(own.unionByName(_closest(visits, cells, k, dims)), k))

    # From places to points: neighbours are the other points of the place, then those of the next places.
    known = places.select(F.col("place").alias("other"), F.col("ids").alias("other_ids"))
    itself = places.select("place", F.lit(0.0).alias("gap"), F.col("ids").alias("other_ids"))
    lists = near.join(known, "other").select("place", "gap", "other_ids").unionByName(itself)
    options = lists.select("place", "gap", F.explode("other_ids").alias("other"))
    # k + 1 options are enough: a point itself is one of them at most.
    line = Window.partitionBy("place").orderBy("gap", "other")
    options = options.withColumn("nth", F.row_number().over(line)).where(F.col("nth") <= 2 * k + 1)
    per_place = options.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("gap", "other"))).alias("options"))
    located = places.select("z", "place").join(per_place, "place").select("z", "options")
    chosen = spread_join(rows, located, ["z"], "inner").select("id", F.filter("options", lambda o: o.other != F.col("id")).alias("options"))
    return chosen.select("id", F.posexplode(F.slice("options", 1, k)).alias("at", "o")).select("id", "o.other", "o.gap", (F.col("at") + 1).alias("rank"))
