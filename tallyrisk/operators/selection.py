"""Exact quantiles by selection: no ordering of all values, and none of them written down.

Three scans for any number of columns and quantiles at once:

1. a mergeable sketch (KLL, some ten KB) per group and column gives two bounds around each wanted rank;
2. the values below and within the bounds are counted, so it is known, not assumed, that the ranks lie within;
3. only the values within the bounds, about 2 * MARGIN of the rows, are counted per value, shuffled and ordered.

The result is exact whatever the sketch says: bounds that miss a rank are opened, which costs time alone. A group and
column of at most ``in_one_task`` values has open bounds from the start and needs no counting scan. More than that many values within bounds
are ordered by distributed prefix sums instead of a window.

Defined cases: null and NaN are no values; rows with a null group are left out; a column without values in a group gives no row;
a table without rows gives none; ties, infinite values and repeated rows count as they stand, and -0 equals 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyrisk.operators.joins import LOOKUP_ROWS, spread_join
from tallyrisk.operators.running import at_rank, running_totals
from tallyrisk.session import settle

SKETCH = 2048
# Share of the rows to either side of a wanted rank that the bounds leave room for. The sketch's error at this size is
# stated as 0.14 % with a probability of 99 %.
MARGIN = 0.004
# Values of one group and column that a task may order.
IN_ONE_TASK = 1_000_000
# From this many columns on, medians are taken from rows that are read as arrays: an aggregate or a struct per column takes
# longer to describe and to plan than to run.
MANY_COLUMNS = 64
# Cells that are looked at in one step, cells that need no bounds, values per point that bounds are taken from, and the share
# of the rows to either side of the median that the bounds leave room for.
STEP_CELLS = 2_000_000
OPEN_CELLS = 2_000_000
POINT_VALUES = 64
MANY_MARGIN = 0.01


def _sketched(rows: DataFrame, n_columns: int, quantiles: Sequence[float], groups: Sequence[str], in_one_task: int) -> DataFrame:
    """(groups, __f, __total, __bounds): an array with the two bounds of each quantile, by the number of the column."""
    shares = ", ".join(f"{max(0.0, p - MARGIN)!r}D, {min(1.0, p + MARGIN)!r}D" for p in quantiles)
    ends = ", ".join("double('-Infinity'), double('Infinity')" for _ in quantiles)
    made = rows.groupBy(*groups).agg(
        *[F.expr(a) for i in range(n_columns) for a in (f"count(__v{i}) AS __n{i}", f"kll_sketch_agg_double(__v{i}, {SKETCH}) AS __s{i}")]
    )
    # The lowest and the highest share stand for open ends: nothing lies outside them.
    cells = [
        f"struct({i} AS __f, __n{i} AS __total, CASE WHEN __n{i} > {in_one_task} "
        f"THEN kll_sketch_get_quantile_double(__s{i}, array({shares})) ELSE array({ends}) END AS __bounds)"
        for i in range(n_columns)
    ]
    found = made.select(*groups, F.expr(f"inline(array({', '.join(cells)}))")).where("__total > 0")
    opened = [
        part
        for j, p in enumerate(quantiles)
        for part in (
            "double('-Infinity')" if p - MARGIN <= 0 else f"__bounds[{2 * j}]",
            "double('Infinity')" if p + MARGIN >= 1 else f"__bounds[{2 * j + 1}]",
        )
    ]
    return found.withColumn("__bounds", F.expr(f"array({', '.join(opened)})"))


def _checked(cells: DataFrame, bounds: DataFrame, quantiles: Sequence[float], keys: Sequence[str], in_one_task: int) -> DataFrame:
    """``bounds`` with ``__below`` and ``__within``, the counted values for each quantile; bounds that miss their rank are opened."""
    counts = [
        f"count_if(value {test}) AS __{name}{j}"
        for j in range(len(quantiles))
        for name, test in (("b", f"< __bounds[{2 * j}]"), ("w", f"BETWEEN __bounds[{2 * j}] AND __bounds[{2 * j + 1}]"))
    ]
    counted = cells.where(F.col("__total") > in_one_task).groupBy(*keys).agg(*[F.expr(c) for c in counts])
    joined = bounds.join(counted, keys, "left")
    state = []
    for j, p in enumerate(quantiles):
        spot = f"{p!r}D * (__total - 1)"
        holds = f"coalesce(__b{j} <= floor({spot}) AND ceil({spot}) < __b{j} + __w{j}, false)"
        state.append((
            f"if({holds}, __bounds[{2 * j}], double('-Infinity'))",
            f"if({holds}, __bounds[{2 * j + 1}], double('Infinity'))",
            f"if({holds}, __b{j}, 0L)",
            f"if({holds}, __w{j}, __total)",
        ))
    return joined.select(
        *keys,
        "__total",
        F.expr(f"array({', '.join(f'{low}, {high}' for low, high, _, _ in state)})").alias("__bounds"),
        F.expr(f"array({', '.join(b for _, _, b, _ in state)})").alias("__below"),
        F.expr(f"array({', '.join(w for _, _, _, w in state)})").alias("__within"),
    )


def selected_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    quantiles: Mapping[str, float],
    groups: Sequence[str] = (),
    method: str = "linear",
    in_one_task: int = IN_ONE_TASK,
) -> DataFrame:
    """One row per group and column with values: the groups, ``feature`` and a column per named quantile.

    ``linear`` interpolates between the two neighbours; ``lower`` takes the value at rank floor(p * (n - 1))."""
    groups, names, shares = list(groups), list(quantiles), [float(p) for p in quantiles.values()]
    keys = [*groups, "__f"]
    number = [F.col(c).cast("double") for c in columns]
    rows = reduce(lambda kept, g: kept.where(F.col(g).isNotNull()), groups, df)
    rows = rows.select(*groups, *[F.when(~F.isnan(v), v).alias(f"__v{i}") for i, v in enumerate(number)])

    bounds = settle(_sketched(rows, len(columns), shares, groups, in_one_task))
    facts = bounds.agg(F.count(F.lit(1)).alias("rows"), F.max("__total").alias("largest")).first()

    def with_bounds(table: DataFrame) -> DataFrame:
        structs = ", ".join(f"struct({i} AS __f, __v{i} AS value)" for i in range(len(columns)))
        cells = rows.select(*groups, F.expr(f"inline(array({structs}))")).where("value IS NOT NULL")
        return cells.join(F.broadcast(table), keys) if facts["rows"] <= LOOKUP_ROWS else spread_join(cells, table, keys, "inner")

    widest = facts["largest"] or 0
    if widest > in_one_task:
        bounds = settle(_checked(with_bounds(bounds), bounds, shares, keys, in_one_task))
        widest = bounds.agg(F.max(F.array_max("__within"))).first()[0]
    else:
        bounds = bounds.withColumn("__below", F.array_repeat(F.lit(0).cast("long"), len(names)))

    inside = ", ".join(
        f"if(value BETWEEN __bounds[{2 * j}] AND __bounds[{2 * j + 1}], struct({j} AS __q, __below[{j}] AS __skip), NULL)" for j in range(len(names))
    )
    held = with_bounds(bounds).select(*keys, "__total", "value", F.expr(f"inline(array_compact(array({inside})))"))
    spots = [*keys, "__q"]
    counts = held.groupBy(*spots, "value").agg(F.count(F.lit(1)).alias("n"), F.max("__total").alias("__total"), F.max("__skip").alias("__skip"))
    if widest > in_one_task:
        ordered = running_totals(counts, ["value"], ["n"], spots)
    else:
        earlier = Window.partitionBy(*spots).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        ordered = counts.withColumn("n_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    ordered = ordered.withColumn("n_before", F.col("n_before") + F.col("__skip"))

    picks = []
    for j, p in enumerate(shares):
        spot = F.lit(p) * (F.col("__total") - 1)
        own = F.col("__q") == j
        low, high = at_rank(F.floor(spot), own), at_rank(F.ceil(spot), own)
        picks.append((low if method == "lower" else low + (high - low) * F.max(spot - F.floor(spot))).alias(names[j]))
    feature = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("__f") + 1).alias("feature")
    return ordered.groupBy(*keys).agg(*picks).select(*groups, feature, *names)


def medians_of_many(df: DataFrame, columns: Sequence[str], open_cells: int = OPEN_CELLS, margin: float = MANY_MARGIN, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """(feature, median) of many columns, exact, the same as ``selected_quantiles`` gives.

    The rows are read as arrays of all columns. Tasks give every 64th value of each column in order, from which two bounds around
    its median are taken, then count what lies below and above and give the values between with their numbers of rows. Bounds that
    turn out to miss are opened and their columns counted again. Tables of at most ``open_cells`` cells have open bounds from the start."""
    low, high = np.full(len(columns), -np.inf), np.full(len(columns), np.inf)
    rows = _as_arrays(df, columns)
    if df.count() * len(columns) > open_cells:
        shares = f"array({max(0.0, 0.5 - margin)!r}D, {min(1.0, 0.5 + margin)!r}D)"
        for r in _points(rows, len(columns)).groupBy("f").agg(F.expr(f"approx_percentile(value, {shares}, 10000) AS ends")).collect():
            low[r["f"]], high[r["f"]] = r["ends"]
    counts, facts = _counted(rows, np.arange(len(columns)), low, high)
    missed = np.array([f for f, (below, within, above) in facts.items() if not _holds(below, within, above)], dtype=int)
    if len(missed):
        ends = np.full(len(missed), np.inf)
        again, found = _counted(_as_arrays(df, [columns[f] for f in missed]), missed, -ends, ends)
        counts = counts.where(~F.col("f").isin(missed.tolist())).unionByName(again)
        facts |= found
    facts = {f: (below, below + within + above, within) for f, (below, within, above) in facts.items()}
    spark = df.sparkSession
    sums = spark.createDataFrame([(f, below, total) for f, (below, total, _) in facts.items()], "f INT, skip LONG, total LONG")
    held = counts.where("part = 0").select("f", "value", "n")
    if max((within for _, _, within in facts.values()), default=0) > in_one_task:
        ordered = running_totals(held, ["value"], ["n"], ["f"])
    else:
        earlier = Window.partitionBy("f").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        ordered = held.withColumn("n_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    ordered = ordered.join(F.broadcast(sums), "f").withColumn("n_before", F.col("n_before") + F.col("skip"))
    spot = F.lit(0.5) * (F.col("total") - 1)
    first, last = at_rank(F.floor(spot)), at_rank(F.ceil(spot))
    names = spark.createDataFrame([*enumerate(columns)], "f INT, feature STRING")
    medians = ordered.groupBy("f").agg((first + (last - first) * F.max(spot - F.floor(spot))).alias("median"))
    return medians.join(F.broadcast(names), "f").select("feature", "median")


def _holds(below: int, within: int, above: int) -> bool:
    last = below + within + above - 1
    return below <= last // 2 and (last + 1) // 2 < below + within


def _as_arrays(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = ", ".join(f"CAST(`{c.replace('`', '``')}` AS DOUBLE)" for c in columns)
    return df.select(F.expr(f"array({cells}) AS v"))


def _points(rows: DataFrame, n: int) -> DataFrame:
    """(f, value): of each column the middle of every 64 values in order, taken step by step."""
    step, each = max(1, STEP_CELLS // n), POINT_VALUES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                x = batch.column(0).slice(at, step).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
                x = np.sort(x, axis=0)  # NaN come last
                held = len(x) - np.isnan(x).sum(axis=0)
                spots = np.arange(0, len(x), each)[:, None]
                spots = np.where(spots < held, np.minimum(spots + each // 2, (spots + held) // 2), -1)
                i, f = np.nonzero(spots >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(x[spots[i, f], f])], names=["f", "value"])

    return rows.mapInArrow(run, "f int, value double")


def _counted(rows: DataFrame, numbers: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[DataFrame, dict[int, tuple[int, int, int]]]:
    """(f, part, value, n), written down: the values within the bounds (part 0) with their rows, and the rows below (-1) and above (1);
    and the rows of the three parts by column. ``numbers`` are those of the columns in the arrays."""
    n = len(numbers)
    step = max(1, STEP_CELLS // n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(f, part, value, count):
            cells = [pa.array(f.astype(np.int32)), pa.array(np.full(len(f), part, dtype=np.int32)), pa.array(value, pa.float64()), pa.array(count.astype(np.int64))]
            return pa.RecordBatch.from_arrays(cells, names=["f", "part", "value", "n"])

        below, above = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                x = batch.column(0).slice(at, step).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
                below += (x < low).sum(axis=0)
                above += (x > high).sum(axis=0)
                x = x.T + 0.0  # a negative zero becomes zero
                inside = (x >= low[:, None]) & (x <= high[:, None])
                f, value = np.nonzero(inside)[0], x[inside]
                order = np.lexsort((value, f))
                f, value = f[order], value[order]
                new = np.flatnonzero(np.append(True, (f[1:] != f[:-1]) | (value[1:] != value[:-1]))[: len(f)])
                yield out(numbers[f[new]], 0, value[new], np.diff(np.append(new, len(f))))
        yield out(numbers, -1, np.full(n, np.nan), below)
        yield out(numbers, 1, np.full(n, np.nan), above)

    counts = settle(rows.mapInArrow(run, "f int, part int, value double, n long").groupBy("f", "part", "value").agg(F.sum("n").alias("n")))
    sums = counts.groupBy("f").agg(*[F.expr(f"coalesce(sum(n) FILTER (WHERE part = {part}), 0) AS n{i}") for i, part in enumerate((-1, 0, 1))])
    return counts, {r["f"]: (r["n0"], r["n1"], r["n2"]) for r in sums.collect() if r["n0"] + r["n1"] + r["n2"]}
