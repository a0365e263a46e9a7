"""Gradient-boosted trees that grow leaf by leaf, from histograms of gradients.

Features are cut into bins once; rows are kept in chunks of columns: one byte per feature, label, weight and the score of the trees that
are written. A pass over the rows sums gradients, curvatures and counts per (node, feature, bin): rows of a task are summed before
they are shuffled, and what reaches the driver is bounded by leaves x features x bins, whatever the number of rows. Of
two children the smaller one is summed, the other is the parent less it. The leaf with the largest gain is split next. To
need few passes, a pass sums the children of all leaves that may still be split, and the driver then splits
best first as far as their sums are known: the same trees as with one pass for each split.

Gradients are summed as whole numbers of a fixed fraction, so sums are exact in any order, the difference of two histograms
is exact too, and the same rows give the same trees however they are partitioned.

Defined cases: a missing or NaN value has a bin of its own, and each split sends it to the side with the larger gain; of
equal gains the first feature, then the smaller bin, then missing to the left is taken; rows without a label are not learnt from; with
one class only, or no rows, there is no tree and the score is the (smoothed) share of class 1.
"""

from __future__ import annotations

import heapq
import math
import pickle
import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyrisk.session import settle, shared_dir

# The settings of the boosted model.
LEAVES = 34
STEP = 0.03
ROW_SHARE = 0.85
COLUMN_SHARE = 0.9
L1 = 0.1
L2 = 0.1
MIN_ROWS = 20

# Bins of a feature, 0 for missing values; a bin is one byte.
BINS = 256
# Trees between two writes of the scores; scores of later trees are added up from the bins.
TREES_PER_WRITE = 5
# Every so many trees the rows are also written to disk; in between, rows that are lost are made again from there.
TREES_PER_CHECKPOINT = 20
# The sums of at most this many tasks are added up by the driver (some 30 KB a node and task); those of more are shuffled.
DIRECT_TASKS = 16
# Rows of a chunk, which a task holds at a time, and the most rows that a task goes through.
CHUNK_ROWS = 65_536
TASK_ROWS = 2_000_000


@dataclass(frozen=True)
class Settings:
    rounds: int = 100
    leaves: int = LEAVES
    step: float = STEP
    depth: int = 64
    row_share: float = ROW_SHARE
    column_share: float = COLUMN_SHARE
    l1: float = L1
    l2: float = L2
    min_rows: int = MIN_ROWS
    min_gain: float = 0.0
    patience: int = 0  # trees without a better loss on validation rows before boosting stops; 0: never
    seed: int = 42


@dataclass
class Tree:
    """Nodes as lists; feature -1 is a leaf. A row goes left if its bin is at most ``cut``; bin 0 by ``missing_left``."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for column, start in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column.append(start)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: int, missing_left: bool, left: int, right: int) -> None:
        self.feature[node], self.cut[node], self.missing_left[node], self.left[node], self.right[node] = feature, cut, missing_left, left, right

    def node_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        return Finder(self).node_of(bins)

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return Finder(self).scores(bins)


class Finder:
    """Finds the leaves of rows without walking down the tree. Leaves are bits, from left to right; for each feature and bin a table
    has the leaves that no node on this feature rules out (a row that goes right is in no leaf to the left). What is left by all features
    is looked at from the left: its first leaf is that of the row."""

    def __init__(self, tree: Tree):
        order, span = [], {}  # leaves from left to right; the places of the leaves below a node
        stack = [(0, False)]
        while stack:
            node, done = stack.pop()
            if tree.feature[node] < 0:
                span[node] = (len(order), len(order) + 1)
                order.append(node)
            elif done:
                span[node] = (span[tree.left[node]][0], span[tree.right[node]][1])
            else:
                stack += [(node, True), (tree.right[node], False), (tree.left[node], False)]
        self.leaves, self.values = np.array(order), np.array(tree.value)[order]
        self.words = -(-len(order) // 64)
        self.tables: dict[int, np.ndarray] = {}
        for node, feature in enumerate(tree.feature):
            if feature < 0 or node not in span:
                continue
            own = self.tables.setdefault(feature, np.full((self.words, BINS), np.uint64(2**64 - 1)))
            first, end = span[tree.left[node]]
            right = slice(tree.cut[node] + 1, BINS)
            for k in range(first // 64, -(-end // 64)):
                bits = np.uint64(2**64 - 1 - sum(1 << i - 64 * k for i in range(max(first, 64 * k), min(end, 64 * k + 64))))
                own[k, right] &= bits
                if not tree.missing_left[node]:
                    own[k, 0] &= bits

    def place_of(self, bins: np.ndarray) -> np.ndarray:
        """The place of each row's leaf among the leaves."""
        found = np.zeros(len(bins), dtype=np.int64)
        for k in reversed(range(self.words if self.tables else 0)):
            left = None
            for feature, own in self.tables.items():
                here = own[k][bins[:, feature]]
                left = here if left is None else np.bitwise_and(left, here, out=left)
            lowest = left & (~left + np.uint64(1))
            place = (lowest.astype(np.float64).view(np.int64) >> 52) - 1023 + 64 * k  # the exponent of a power of two
            found = np.where(left != 0, place, found) if self.words > 1 else place
        return found

    def node_of(self, bins: np.ndarray) -> np.ndarray:
        return self.leaves[self.place_of(bins)]

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.values[self.place_of(bins)]


# --- bins ------------------------------------------------------------------------------------------------


def fit_edges(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Upper ends of the bins of each feature, quantiles of all its values; a value above the last is in one more bin."""
    shares = [i / (BINS - 2) for i in range(1, BINS - 2)]
    clean = [F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in features]
    row = df.agg(*[F.approx_percentile(c, F.lit(shares), F.lit(100 * BINS)).alias(f"q{i}") for i, c in enumerate(clean)]).first()
    most = df.agg(*[F.max(c).alias(f"m{i}") for i, c in enumerate(clean)]).first()
    return [np.array(sorted({v for v in row[f"q{i}"] or [] if v < most[f"m{i}"]})) for i in range(len(features))]


def bins_of(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """One byte per feature for rows of doubles (NaN: missing)."""
    out = np.zeros(values.shape, dtype=np.uint8)
    for j, own in enumerate(edges):
        out[:, j] = np.where(np.isnan(values[:, j]), 0, 1 + np.searchsorted(own, values[:, j], side="left"))
    return out


def _doubles(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)


def _feature_array(features: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in features])


@dataclass
class Chunk:
    """Some rows as columns."""

    bins: np.ndarray  # a row per feature
    y: np.ndarray
    w: np.ndarray
    held: np.ndarray
    mix: np.ndarray
    score: np.ndarray | None = None


def _chunks(df: DataFrame, features: Sequence[str], edges: Sequence[np.ndarray], columns: Sequence[Column]) -> RDD:
    """The rows in bins, in chunks; ``columns`` are y, w, held and mix."""
    n = len(features)

    def packed(parts: Sequence[tuple]) -> pa.RecordBatch:
        bins, y, w, held, mix = (np.concatenate(x) for x in zip(*parts))
        chunk = Chunk(np.ascontiguousarray(bins.T), y, w, held, mix)
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(chunk)], pa.binary())], names=["chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if size + batch.num_rows > CHUNK_ROWS and parts:
                yield packed(parts)
                parts, size = [], 0
            y, w, held, mix = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            parts.append((bins_of(_doubles(batch.column(0), n), edges), y.astype(np.int8), w, held.astype(bool), mix))
            size += batch.num_rows
        if parts:
            yield packed(parts)

    rows = settle(df.select(_feature_array(features).alias("x"), *columns).mapInArrow(run, "chunk binary"))
    return rows.rdd.map(lambda r: pickle.loads(r["chunk"]))


def _class_sums(chunk: Chunk) -> tuple[int, float, float, float]:
    """Rows, largest weight, and the weights of each class of the rows that are learnt from."""
    return len(chunk.y), float(np.nanmax(chunk.w)), *(float(np.nansum(chunk.w[~chunk.held & (chunk.y == c)])) for c in (0, 1))


# --- one tree ----------------------------------------------------------------------------------------------


def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_split(sums: np.ndarray, settings: Settings, allowed: Sequence[int], scale: float) -> tuple | None:
    """(gain, feature, cut, missing_left, rows to the left) of a node from its sums (3, features, BINS), or None."""
    best = None
    total = sums[:, allowed[0], :].sum(axis=1)
    worth = lambda g, h: _shrunk(g / scale, settings.l1) ** 2 / (h / scale + settings.l2)
    for feature in allowed:
        own = sums[:, feature, :]
        below = np.cumsum(own[:, 1:], axis=1)
        sides = [below + own[:, :1], below] if own[2, 0] else [below]  # missing left, missing right
        for missing_left, left in zip((True, False), sides):
            right = total[:, None] - left
            fits = (left[2] >= settings.min_rows) & (right[2] >= settings.min_rows)
            if not fits.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fits, worth(left[0], left[1]) + worth(right[0], right[1]) - worth(*total[:2]), -np.inf)
            at = int(np.argmax(gain))
            better = best is None or (gain[at], -feature, -(at + 1), missing_left) > (best[0], -best[1], -best[2], best[3])
            if gain[at] > settings.min_gain and better:
                best = (float(gain[at]), feature, at + 1, missing_left, int(left[2, at]))
    return best


class Growth:
    """A tree that is being grown: ``wanted`` names the nodes whose sums are needed next, ``take`` receives them."""

    def __init__(self, settings: Settings, allowed: Sequence[int], scale: float):
        self.settings, self.allowed, self.scale = settings, allowed, scale
        self.tree = Tree()
        self.sums: dict[int, np.ndarray] = {}
        self.best: dict[int, tuple | None] = {}
        self.depth = {self.tree.add(): 0}
        self.wanted = [0]
        self.pending: dict[int, tuple[int, int]] = {}  # smaller child -> (parent, sibling)
        self.known: set[int] = set()  # nodes that are split, perhaps only to look ahead

    def _judge(self, node: int, sums: np.ndarray) -> None:
        self.sums[node] = sums
        deep = self.depth[node] >= self.settings.depth
        self.best[node] = None if deep else best_split(sums, self.settings, self.allowed, self.scale)

    def take(self, found: Mapping[int, np.ndarray]) -> None:
        for node, sums in found.items():
            if node in self.pending:
                parent, sibling = self.pending.pop(node)
                self._judge(sibling, self.sums[parent] - sums)
            self._judge(node, sums)
        self._look_ahead()

    def _chosen(self) -> tuple[set[int], list[int]]:
        """Nodes split best first, and those among them whose children are not known yet. With none of the latter the tree
        is complete; else the nodes that come after the first of them are split only to look ahead."""
        heap, split, open_ = [(-self.best[0][0], 0)] if self.best[0] else [], set(), []
        while heap and len(split) + 1 < self.settings.leaves:
            _, node = heapq.heappop(heap)
            split.add(node)
            if node not in self.known:
                open_.append(node)
                continue
            for child in (self.tree.left[node], self.tree.right[node]):
                if self.best[child]:
                    heapq.heappush(heap, (-self.best[child][0], child))
        return split, open_

    def _look_ahead(self) -> None:
        split, open_ = self._chosen()
        self.wanted = []
        if not open_:
            self._finish(split)
        for node in open_:
            _, feature, cut, missing_left, n_left = self.best[node]
            left, right = self.tree.add(), self.tree.add()
            self.depth[left] = self.depth[right] = self.depth[node] + 1
            self.tree.split(node, feature, cut, missing_left, left, right)
            self.known.add(node)
            n = int(self.sums[node][2, self.allowed[0]].sum())
            small, other = (left, right) if 2 * n_left <= n else (right, left)
            self.pending[small] = (node, other)
            self.wanted.append(small)

    def _finish(self, split: set[int]) -> None:
        """The tree of the nodes that are really split, numbered anew, with the values of its leaves."""
        old, new, order = self.tree, Tree(), [0]
        new.add()
        for at in range(2 * len(split) + 1):
            node = order[at]
            if node in split:
                left, right = new.add(), new.add()
                new.split(at, old.feature[node], old.cut[node], old.missing_left[node], left, right)
                order += [old.left[node], old.right[node]]
            else:
                g, h, _ = self.sums[node][:, self.allowed[0], :].sum(axis=1) / self.scale
                new.value[at] = float(-_shrunk(g, self.settings.l1) / (h + self.settings.l2) * self.settings.step) if h else 0.0
        self.tree = new


def _kept(mix: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Rows that a tree learns from: the same for a recomputed task."""
    x = mix.view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return (x ^ x >> np.uint64(31)) < np.uint64(min((1 << 64) - 1, int(share * 2.0**64)))


def _totals(cell: np.ndarray, parts: Sequence[tuple[np.ndarray, int]], size: int) -> np.ndarray:
    """Sums of whole numbers per cell; ``parts`` are doubles that add up to them, with the power of two that each is short of."""
    return sum(np.bincount(cell, values, size).astype(np.int64) << power for values, power in parts)


def _exact_parts(values: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Whole numbers as doubles whose sums are exact: as they are if no sum can reach 2^53, or cut in two at 26 bits."""
    if float(np.abs(values).max(initial=0)) * len(values) < 2.0**53:
        return [(values.astype(np.float64), 0)]
    return [((values >> 26).astype(np.float64), 26), ((values & (1 << 26) - 1).astype(np.float64), 0)]


def node_sums(bins: np.ndarray, place: np.ndarray, n_places: int, g: np.ndarray, h: np.ndarray, allowed: Sequence[int] | None = None) -> np.ndarray:
    """(places, 3, features, BINS) sums of whole numbers, below 2^62 in all, over at most a chunk of rows (of features); those of the allowed features."""
    out = np.zeros((n_places, 3, len(bins), BINS), dtype=np.int64)
    parts, first = [_exact_parts(g), _exact_parts(h)], place * BINS
    for j in range(len(bins)) if allowed is None else allowed:
        cell = first + bins[j]
        for part, own in enumerate(parts):
            out[:, part, j] = _totals(cell, own, n_places * BINS).reshape(n_places, BINS)
        out[:, 2, j] = np.bincount(cell, minlength=n_places * BINS).reshape(n_places, BINS)
    return out


def gradients(y: np.ndarray, w: np.ndarray, score: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-np.clip(score, -700, 700)))
    return np.rint(w * (p - y) * scale).astype(np.int64), np.rint(w * p * (1 - p) * scale).astype(np.int64)


def _scored(score: np.ndarray, bins: np.ndarray, recent: Sequence[Finder]) -> np.ndarray:
    return score + sum((t.scores(bins) for t in recent), np.zeros(len(score)))


def _pass(rows: RDD, n: int, recent: Sequence[Tree], growth: Growth, settings: Settings, seed: int, judged: bool) -> tuple[dict, int]:
    """Sums of the wanted nodes, and, if asked for, the loss of the validation rows (in the same fractions)."""
    tree, wanted, scale, allowed = growth.tree, list(growth.wanted), growth.scale, growth.allowed

    def run(chunks: Iterator[Chunk]) -> Iterator[tuple[np.ndarray, int]]:
        total, loss = np.zeros((len(wanted), 3, n, BINS), dtype=np.int64), 0
        written, finder = [Finder(t) for t in recent], Finder(tree)
        place_of = np.full(len(tree.feature), -1)
        place_of[wanted] = np.arange(len(wanted))
        place_of = place_of[finder.leaves]
        for c in chunks:
            if judged and c.held.any():
                score = _scored(c.score[c.held], c.bins.T[c.held], written)
                margin = np.where(c.y[c.held] == 1, score, -score)
                loss += int(np.rint(c.w[c.held] * np.logaddexp(0, -margin) * scale).astype(np.int64).sum())
            place = place_of[finder.place_of(c.bins.T)]
            used = np.flatnonzero((place >= 0) & ~c.held)
            used = used[_kept(c.mix[used], seed, settings.row_share)]
            bins = c.bins[:, used]
            g, h = gradients(c.y[used], c.w[used], _scored(c.score[used], bins.T, written), scale)
            total += node_sums(bins, place[used], len(wanted), g, h, allowed)
        yield total, loss

    def added(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> tuple[np.ndarray, int]:
        return a[0] + b[0], a[1] + b[1]

    found = rows.mapPartitions(run)
    if rows.getNumPartitions() <= DIRECT_TASKS:
        parts = found.collect()
        sums, loss = sum(p[0] for p in parts), sum(p[1] for p in parts)
    else:
        sums, loss = found.treeReduce(added)
    return dict(zip(wanted, sums)), loss


def _advanced(rows: RDD, trees: Sequence[Tree], stored: bool) -> RDD:
    """The rows with the scores of some trees added."""

    def run(chunks: Iterator[Chunk]) -> Iterator[Chunk]:
        finders = [Finder(t) for t in trees]
        for c in chunks:
            yield Chunk(c.bins, c.y, c.w, c.held, c.mix, _scored(c.score, c.bins.T, finders))

    return _held(rows.mapPartitions(run), stored, rows)


def _held(rows: RDD, stored: bool, before: RDD | None = None) -> RDD:
    """The rows held by the executors, and in a checkpoint if they are to be stored; those before them are let go."""
    rows.persist(StorageLevel.MEMORY_AND_DISK)
    if stored:
        rows.checkpoint()
    rows.count()
    if before is not None:
        before.unpersist()
    return rows


# --- the model -----------------------------------------------------------------------------------------------


@dataclass
class LeafwiseModel:
    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]
    losses: list[float] = field(default_factory=list)  # of the validation rows before each tree

    def transform(self, df: DataFrame, name: str = "probability_1") -> DataFrame:
        """Adds the probability of class 1."""
        n, spot = len(self.features), len(df.columns)
        schema = df.select("*", F.lit(0.0).alias(name)).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finders = [Finder(t) for t in self.trees]
            for batch in batches:
                bins = np.asfortranarray(bins_of(_doubles(batch.column(spot), n), self.edges))
                score = self.base + sum((t.scores(bins) for t in finders), np.zeros(len(bins)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:spot], pa.array(1.0 / (1.0 + np.exp(-np.clip(score, -700, 700))))], names=schema.names)

        return df.select("*", _feature_array(self.features).alias("__x")).mapInArrow(run, schema)

    def importances(self) -> dict[str, int]:
        """How often each feature splits."""
        used = [f for t in self.trees for f in t.feature if f >= 0]
        return {c: used.count(i) for i, c in enumerate(self.features)}

    def table(self, spark: SparkSession) -> DataFrame:
        """The trees as rows; tree -1 holds the base score."""
        rows = [(-1, 0, None, None, None, None, None, self.base)]
        for i, t in enumerate(self.trees):
            for node, f in enumerate(t.feature):
                split = (self.features[f], float(self.threshold(f, t.cut[node])), t.missing_left[node], t.left[node], t.right[node], None)
                rows.append((i, node, *(split if f >= 0 else (None, None, None, None, None, t.value[node]))))
        return spark.createDataFrame(rows, "tree INT, node INT, feature STRING, threshold DOUBLE, missing_left BOOLEAN, left_node INT, right_node INT, value DOUBLE")

    def threshold(self, feature: int, cut: int) -> float:
        """The largest value of the bins up to ``cut`` (infinite beyond the last edge)."""
        return self.edges[feature][cut - 1] if cut <= len(self.edges[feature]) else math.inf


def score_sql(rows: Sequence) -> str:
    """The probability of class 1 as one SQL expression, from the rows of a stored model (``LeafwiseModel.table``)."""
    nodes = {(r["tree"], r["node"]): r for r in rows}

    def branch(tree: int, node: int) -> str:
        r = nodes[tree, node]
        if r["feature"] is None:
            return f"CAST({r['value']!r} AS DOUBLE)"
        bound = "CAST('Infinity' AS DOUBLE)" if math.isinf(r["threshold"]) else f"CAST({r['threshold']!r} AS DOUBLE)"
        left = f"coalesce({r['feature']} <= {bound}, {str(r['missing_left']).lower()})"
        return f"CASE WHEN {left} THEN {branch(tree, r['left_node'])} ELSE {branch(tree, r['right_node'])} END"

    trees = sorted({t for t, _ in nodes})
    return f"1 / (1 + exp(-({' + '.join(branch(t, 0) for t in trees)})))"


def fit_leafwise(
    df: DataFrame, features: Sequence[str], label: str = "label", weight: str | None = None, validation: str | None = None, settings: Settings = Settings()
) -> LeafwiseModel:
    """Train on the labelled rows; ``validation`` flags rows that are only judged by (never learnt from)."""
    features = list(features)
    n = len(features)
    usable = df.where(F.col(label).isin(0, 1))
    held = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    edges = fit_edges(usable.where(~held), features)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    mix = F.xxhash64(*[F.col(f"`{c}`") for c in features], F.col(label), F.lit(settings.seed))
    columns = [F.col(label).cast("double").alias("y"), w.alias("w"), held.alias("held"), mix.alias("mix")]
    shared_dir(df.sparkSession)
    chunks = _chunks(usable, features, edges, columns)
    sizes = chunks.map(_class_sums).collect()
    size, (w0, w1) = sum(s[0] for s in sizes), (math.fsum(s[i] for s in sizes) for i in (2, 3))
    if not w0 or not w1:
        share = (w1 + 1) / (w0 + w1 + 2)
        return LeafwiseModel(features, edges, math.log(share / (1 - share)), [])
    base = math.log(w1 / w0)
    # The largest sum stays below 2^62; a score is at most 40 from a row's label in effect.
    scale = 2.0 ** math.floor(62 - math.log2(size * max(s[1] for s in sizes) * 64))
    scale = min(scale, 2.0**40)
    cores = max(1, df.sparkSession.sparkContext.defaultParallelism)
    tasks = max(cores * max(1, DIRECT_TASKS // cores), -(-size // TASK_ROWS))
    if chunks.getNumPartitions() > tasks:
        chunks = chunks.coalesce(tasks)
    rows = _held(chunks.map(lambda c: Chunk(c.bins, c.y, c.w, c.held, c.mix, np.full(len(c.y), base))), True)
    trees, recent, losses, best = [], [], [], (math.inf, 0)
    for i in range(settings.rounds):
        rng = random.Random(settings.seed * 1_000_003 + i)
        allowed = sorted(rng.sample(range(n), max(1, round(settings.column_share * n))))
        growth = Growth(settings, allowed, scale)
        while growth.wanted:
            found, loss = _pass(rows, n, recent, growth, settings, settings.seed + i, len(losses) == i)
            if len(losses) == i:
                losses.append(loss / scale)
            growth.take(found)
        if losses[i] < best[0]:
            best = (losses[i], i)
        if validation and settings.patience and i - best[1] >= settings.patience:
            break
        trees.append(growth.tree)
        recent.append(growth.tree)
        if len(recent) == TREES_PER_WRITE:
            rows, recent = _advanced(rows, recent, len(trees) % TREES_PER_CHECKPOINT == 0), []
    rows.unpersist()
    if validation and settings.patience:
        trees = trees[: best[1]]  # the loss of a place is that of the trees before it
    return LeafwiseModel(features, edges, base, trees, losses)


@dataclass(frozen=True)
class Leafwise:
    """What a fit needs, with the ``fit`` that estimators have."""

    features: Sequence[str]
    label: str = "label"
    weight: str | None = None
    settings: Settings = Settings()

    def fit(self, df: DataFrame) -> LeafwiseModel:
        return fit_leafwise(df, self.features, self.label, self.weight, settings=self.settings)
