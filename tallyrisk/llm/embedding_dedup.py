"""Near copies among embeddings: tiled comparison in the order of the principal components.

Vectors are compared within their label. Equal vectors become one node with a number of copies. Unit vectors are turned
to their principal axes, so that the first dimensions hold most of a product; the rest of a product is at most the product of
the norms of the two rests (suffix norms). A tile of products is summed over the first dimensions, then block by block, and
pairs whose sum plus that bound cannot reach the threshold are given up; a tile ends when none is left.

Nodes of one label are ordered by their first coordinate and cut into strips of bounded size. Two unit vectors
with cosine >= t are no further apart than sqrt(2 - 2t) in any coordinate, so strips further apart are never
paired. One task compares one pair of strips, in tiles; it returns one row per node that has a link: the weight of its links
and a node of its component, never a row per pair. Components of the nodes are joined over all tasks afterwards.

The axes change the order of work only: sums within 1e-9 of the threshold are decided by the cosine of the original
vectors in double precision.

Defined cases: a vector that is null, empty or zero, holds null or non-finite components, or has a null label links with
nothing and is its own component; vectors of different lengths do not link; rows count, so equal vectors link
with each other whatever their ids; a null id is never the smallest one, and is the component id only where no id is in the
component (such rows are all kept: null equals null); an empty table gives an empty table. The axes are those of the most
frequent length up to ``MAX_TURNED``; other lengths are compared in their own order of dimensions, with the same result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tallyrisk.llm.common import PerWorker, field_type, map_arrow, spread_lookup, write_out
from tallyrisk.llm.components import components
from tallyrisk.operators.running import ranked

# Nodes of a strip: a task holds two strips, at 64 dimensions 8 MB.
STRIP = 8192
TILE = 512
# Dimensions of a block of products, and of the boxes that rule out tiles.
BLOCK = 16
BOX = 8
# A tile with a smaller share of open pairs goes on pair by pair.
OPEN_SHARE = 0.02
MAX_TURNED = 2048
ROWS_PER_TASK = 100_000
_BAND = 1e-9


def packed_vectors(batch: pa.RecordBatch, at: int) -> list[bytes | None]:
    """Each usable vector of a list column as packed doubles (negative zeros made positive), else none."""
    column = batch.column(at)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0  # nulls become NaN
    ends = column.offsets.to_numpy()
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    full = np.concatenate(([0], np.cumsum(np.nan_to_num(values) != 0)))
    usable = (bad[ends[1:]] == bad[ends[:-1]]) & (full[ends[1:]] > full[ends[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b].tobytes() if good else None for good, a, b in zip(usable, ends[:-1], ends[1:])]


def unit_rows(packed: list[bytes], dims: int) -> np.ndarray:
    rows = np.frombuffer(b"".join(packed), dtype=np.float64).reshape(len(packed), dims)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares neither vanish nor overflow
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def principal_axes(nodes: DataFrame) -> tuple[int, np.ndarray | None]:
    """The most frequent length of ``vec`` and its axes, largest share first. Each task sums products; dims^2 / 2 sums
    come to the driver."""
    common = nodes.groupBy("dims").count().where(F.col("dims") <= MAX_TURNED).orderBy(F.desc("count"), "dims").first()
    if common is None:
        return 0, None
    dims = common["dims"]
    above = np.triu_indices(dims)

    def run(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            unit = unit_rows(batch.column(0).to_pylist(), dims)
            total += unit.T @ unit
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(above[0]))), pa.array(total[above])], names=["cell", "value"])

    cells = nodes.where(F.col("dims") == dims).select("vec").mapInArrow(run, "cell long, value double")
    sums = cells.groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    moments = np.zeros((dims, dims))
    moments[above[0][sums["cell"]], above[1][sums["cell"]]] = sums["value"]
    _, axes = np.linalg.eigh(moments + np.triu(moments, 1).T)
    return dims, np.ascontiguousarray(axes[:, ::-1])


def _turned(unit: np.ndarray, axes: tuple[int, np.ndarray | None]) -> np.ndarray:
    return unit @ axes[1] if unit.shape[1] == axes[0] else unit


class Forest:
    """Union-find over the nodes of one task."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.unique(np.stack((self.root[a], self.root[b])), axis=1)
        for x, y in zip(*pairs.tolist()):
            while self.root[x] != x:
                x = self.root[x]
            while self.root[y] != y:
                y = self.root[y]
            self.root[max(x, y)] = min(x, y)
        while not np.array_equal(above := self.root[self.root], self.root):
            self.root = above

    def link_matrix(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> None:
        """Links between all a and b that ``linked`` marks: each round joins each component to one other."""
        while True:
            open_ = linked & (self.root[a][:, None] != self.root[b][None, :])
            rows, columns = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
            if not len(rows):
                return
            picked = np.concatenate((a[rows], a[open_[:, columns].argmax(axis=0)]))
            self.link(picked, np.concatenate((b[open_[rows].argmax(axis=1)], b[columns])))


def tiles_of(lead: np.ndarray) -> list[np.ndarray]:
    """Places in tiles of at most TILE rows, halved at the median of the widest leading dimension."""
    todo, done = [np.arange(len(lead))], []
    while todo:
        own = todo.pop()
        if len(own) <= TILE:
            done.append(own)
            continue
        widest = int(np.argmax(np.ptp(lead[own], axis=0)))
        order = own[np.argsort(lead[own, widest], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return done


class Comparison:
    """All links among the rows of one strip, or between two strips."""

    def __init__(self, unit: np.ndarray, turned: np.ndarray, copies: np.ndarray, threshold: float):
        self.unit, self.turned, self.copies, self.threshold = unit, turned, copies.astype(np.float64), threshold
        self.ends = list(range(BLOCK, turned.shape[1], BLOCK)) + [turned.shape[1]]
        rest = np.cumsum((turned * turned)[:, ::-1], axis=1)[:, ::-1]
        rest = np.sqrt(np.concatenate((rest, np.zeros((len(turned), 1))), axis=1))
        self.rest = [np.ascontiguousarray(rest[:, e]) for e in self.ends]
        self.weight = np.zeros(len(unit))
        self.forest = Forest(len(unit))
        self.reach = 2 - 2 * threshold + _BAND

    def _tiles(self, rows: np.ndarray) -> list[tuple]:
        lead = self.turned[:, :BOX]
        return [(rows[t], lead[rows[t]].min(axis=0), lead[rows[t]].max(axis=0)) for t in tiles_of(lead[rows])]

    def _decide(self, total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs (a, b) with these products link; those near the threshold by their original vectors."""
        linked = total >= self.threshold
        near = np.flatnonzero(np.abs(total - self.threshold) <= _BAND)
        for at in range(0, len(near), 4096):
            some = near[at : at + 4096]
            linked[some] = np.einsum("ij,ij->i", self.unit[a[some]], self.unit[b[some]]) >= self.threshold
        return linked

    def _compare(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        left, right, total, start = self.turned[a], self.turned[b], 0.0, 0
        for end, rest in zip(self.ends, self.rest):
            total = total + left[:, start:end] @ right[:, start:end].T
            open_ = total + np.outer(rest[a], rest[b]) >= self.threshold - _BAND
            if same:
                open_ = np.triu(open_, 1)
            n_open = int(open_.sum())
            if not n_open:
                return
            start = end
            if n_open <= OPEN_SHARE * open_.size:
                i, j = np.nonzero(open_)
                self._finish_pairs(a[i], b[j], total[i, j], start)
                return
        linked = open_
        i, j = np.nonzero(open_ & (total < self.threshold + _BAND))
        linked[i, j] = self._decide(total[i, j], a[i], b[j])
        weights = linked.astype(np.float64)
        self.weight[a] += weights @ self.copies[b]
        self.weight[b] += self.copies[a] @ weights
        self.forest.link_matrix(a, b, linked)

    def _finish_pairs(self, a: np.ndarray, b: np.ndarray, total: np.ndarray, start: int) -> None:
        for end, rest in zip(self.ends, self.rest):
            if end <= start:
                continue
            total = total + np.einsum("ij,ij->i", self.turned[a, start:end], self.turned[b, start:end])
            open_ = total + rest[a] * rest[b] >= self.threshold - _BAND
            a, b, total, start = a[open_], b[open_], total[open_], end
        linked = self._decide(total, a, b)
        a, b = a[linked], b[linked]
        if len(a):
            np.add.at(self.weight, a, self.copies[b])
            np.add.at(self.weight, b, self.copies[a])
            self.forest.link(a, b)

    def run(self, first: np.ndarray, second: np.ndarray | None) -> None:
        """Compare the rows ``first`` with the rows ``second``, or among themselves."""
        ours = self._tiles(first)
        theirs = ours if second is None else self._tiles(second)
        for k, (a, low, high) in enumerate(ours):
            for b, least, most in theirs[k:] if second is None else theirs:
                gap = np.maximum(0.0, np.maximum(least - high, low - most))
                if gap @ gap <= self.reach:
                    self._compare(a, b, a is b)


def strip_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """(label, dims, a, b) of the strips that can hold linked nodes, a <= b. Strips meet in buckets of their first coordinate
    as wide as linked nodes can be apart; a pair is taken from the later of the two first buckets."""
    reach = math.sqrt(2 - 2 * threshold + _BAND) + _BAND
    strips = nodes.groupBy("label", "dims", "strip").agg(F.min("lead").alias("low"), F.max("lead").alias("high"))
    first, last = F.floor(F.col("low") / reach), F.floor((F.col("high") + reach) / reach)
    strips = write_out(strips.withColumns({"first": first, "last": last}), "embedding-strips")
    placed = strips.withColumn("bucket", F.explode(F.sequence("first", "last")))
    right = placed.select("label", "dims", "bucket", F.col("strip").alias("b"), F.col("low").alias("b_low"), F.col("first").alias("b_first"))
    met = placed.withColumnRenamed("strip", "a").join(right, ["label", "dims", "bucket"]).where(
        (F.col("a") <= F.col("b")) & (F.col("bucket") == F.greatest("first", "b_first")) & (F.col("b_low") <= F.col("high") + reach)
    )
    return met.select("label", "dims", "a", "b")


def node_links(nodes: DataFrame, threshold: float, axes: PerWorker) -> DataFrame:
    """(node, weight, root) for each node with a link in a pair of strips: the copies of the nodes it links with there, and
    a node of its component there."""
    pairs = strip_pairs(nodes, threshold)
    dealt = pairs.withColumn("strip", F.explode(F.array_distinct(F.array("a", "b")))).join(nodes, ["label", "dims", "strip"])

    def run(group: pa.Table) -> pa.Table:
        dims, a, b = (group.column(c)[0].as_py() for c in ("dims", "a", "b"))
        unit = unit_rows(group.column("vec").to_pylist(), dims)
        strip = group.column("strip").to_numpy()
        node = group.column("node").to_numpy()
        own = Comparison(unit, _turned(unit, axes.get()), group.column("copies").to_numpy(), threshold)
        own.run(np.flatnonzero(strip == a), None if a == b else np.flatnonzero(strip == b))
        met = np.flatnonzero(own.weight)
        return pa.table({"node": node[met], "weight": own.weight[met].astype(np.int64), "root": node[own.forest.root[met]]})

    chosen = dealt.select("label", "dims", "a", "b", "strip", "node", "copies", "vec")
    return chosen.groupBy("label", "dims", "a", "b").applyInArrow(run, "node long, weight long, root long")


def _nodes(rows: DataFrame, strip_rows: int) -> tuple[DataFrame, PerWorker]:
    """One row per distinct vector of a label: key, copies, smallest id, strip and a number; and the axes."""
    spark = rows.sparkSession
    usable = rows.where("key is not null")
    distinct = usable.groupBy("key").agg(
        F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id")
    )
    distinct = write_out(distinct.withColumn("dims", (F.octet_length("vec") / 8).cast("int")), "embedding-distinct")
    axes = PerWorker(spark, principal_axes(distinct), lambda axes: axes)

    def lead(batch):
        first = [float(_turned(unit_rows([v], len(v) // 8), axes.get())[0, 0]) for v in batch.column(1).to_pylist()]
        return {"key": batch.column(0), "lead": first}

    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("lead", T.DoubleType())])
    first = write_out(map_arrow(distinct.select("key", "vec"), lead, schema), "embedding-lead")
    placed = ranked(distinct.drop("vec").join(first, "key"), ["lead", "key"], ["label", "dims"])
    share = F.ceil(F.col("group_size") / F.ceil(F.col("group_size") / F.lit(strip_rows)))
    placed = placed.select("key", "lead", F.floor(F.col("position") / share).alias("strip"))
    nodes = distinct.join(placed, "key").withColumn("node", F.monotonically_increasing_id())
    return write_out(nodes, "embedding-nodes"), axes


def near_duplicates(
    vectors: DataFrame, threshold: float, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", strip_rows: int = STRIP
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other rows with the same label and cosine >= threshold),
    component_id (the smallest id that links lead to) and kept (whether the row has that id)."""
    chosen = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))

    def pack(batch):
        return {"vec_id": batch.column(0), "label": batch.column(1), "vec": packed_vectors(batch, 2)}

    schema = T.StructType([
        T.StructField("vec_id", field_type(vectors, vec_id)),
        T.StructField("label", field_type(vectors, label)),
        T.StructField("vec", T.BinaryType()),
    ])
    # The digest of label and vector is null if either is.
    key = F.unhex(F.sha2(F.concat(F.col("label").cast("string").cast("binary"), F.lit("\0").cast("binary"), F.col("vec")), 256))
    rows = write_out(map_arrow(chosen, pack, schema).withColumn("key", key), "embedding-rows")
    nodes, axes = _nodes(rows, strip_rows)
    links = write_out(node_links(nodes, threshold, axes), "embedding-links")

    joined = components(links, "node", "root").withColumnRenamed("root", "component")
    weights = links.groupBy("node").agg(F.sum("weight").alias("weight"))
    known = nodes.select("node", "key", "copies", "least_id").join(joined, "node", "left").join(weights, "node", "left")
    known = write_out(known.withColumn("component", F.coalesce("component", "node")), "embedding-known")
    least = known.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    per_key = spread_lookup(known, least, "component", "members", F.xxhash64("node"), ROWS_PER_TASK).select(
        "key", "copies", (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    per_key = write_out(per_key, "embedding-keys")
    names = ["vec_id", "n_links", "component_id"]
    # Equal rows are dealt out by where they are read, so copies of one row are spread too.
    linked = spread_lookup(rows.where("key is not null").select("vec_id", "key"), per_key, "key", "copies", F.monotonically_increasing_id(), ROWS_PER_TASK)
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.select(names).unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
