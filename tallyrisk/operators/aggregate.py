"""Aggregates per key: stat lists, category shares, slices, group statistics, profiles."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyrisk.functions.scalar import clean_name
from tallyrisk.operators.joins import LOOKUP_ROWS, NULL_SPREAD, ROWS_PER_TASK, fold_by_key, hot_keys, mixer, spread_join
from tallyrisk.operators.running import exact_quantiles, long_form
from tallyrisk.operators.selection import selected_quantiles
from tallyrisk.session import settle

Spec = Mapping[str, Sequence[str]]


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in set(without)
    ]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def out_name(prefix: str, column: str, stat: str) -> str:
    return f"{prefix}{clean_name(column)}_{stat}".upper()


# Aggregates are written as SQL text: a wide table has hundreds, and text costs one call to the
# JVM each. A sum over nulls only is 0.
_STATS = {
    "min": "min({c})",
    "max": "max({c})",
    "mean": "avg({c})",
    "sum": "coalesce(sum({c}), 0)",
    "var": "var_samp({c})",
    "std": "stddev_samp({c})",
    "count": "count({c})",
    "size": "count(1)",
    "nunique": "count(DISTINCT {c})",
}


def stat_column(column: str, stat: str, name: str, order: Column | None = None) -> Column:
    """One aggregate of the stat vocabulary. ``first``/``last`` skip nulls and need an order."""
    if stat in ("first", "last"):
        if order is None:
            raise ValueError("first/last need an order")
        pick = F.min_by if stat == "first" else F.max_by
        return pick(F.col(column), F.when(F.col(column).isNotNull(), order)).alias(name)
    return F.expr(f"{_STATS[stat].format(c=f'`{column}`')} AS `{name}`")


def build_aggs(spec: Spec, prefix: str = "", order: Column | None = None) -> list[Column]:
    return [
        stat_column(column, stat, out_name(prefix, column, stat), order)
        for column, stats in spec.items()
        for stat in stats
        if stat != "median"
    ]


def aggregate_by(df: DataFrame, key: str, spec: Spec, prefix: str = "", order: Column | None = None) -> DataFrame:
    """Map-driven aggregate per key. Null keys are dropped. Medians are exact and spread over
    tasks by value, so a hot key does not fill one task's memory."""
    rows = df.where(F.col(key).isNotNull())
    result = rows.groupBy(key).agg(*build_aggs(spec, prefix, order))
    medians = [c for c, stats in spec.items() if "median" in stats]
    if medians:
        long = long_form(rows, medians, [key])
        found = exact_quantiles(long, "value", {"median": 0.5}, [key, "feature"])
        wide = found.groupBy(key).pivot("feature", medians).agg(F.first("median"))
        wide = wide.select(key, *[F.col(c).alias(out_name(prefix, c, "median")) for c in medians])
        result = result.join(wide, key, "left")
    return result


def aggregate_all_numeric(
    df: DataFrame, key: str, prefix: str, stats: Sequence[str] = ("mean", "std", "min", "max", "sum")
) -> DataFrame:
    """Every numeric column with every stat, and the row count as ``<prefix>COUNT``."""
    spec = {c: stats for c in numeric_columns(df, without=[key])}
    rows = df.where(F.col(key).isNotNull())
    return rows.groupBy(key).agg(*build_aggs(spec, prefix), F.count(F.lit(1)).alias(f"{prefix}COUNT".upper()))


# --- categories ---------------------------------------------------------------------------


# A column with more values than this is no category: it must be given a vocabulary or be left out by the caller.
MAX_CATEGORIES = 1000


def vocabularies(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> dict[str, list[str]]:
    """Sorted distinct values of each column. With a ``limit``, columns with more values are left out; without one
    all values are taken, and a column above MAX_CATEGORIES is an error that names it. Values are made distinct and
    counted (one row per column) before anything is collected."""
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    distinct = df.select(F.inline(cells)).where("value IS NOT NULL").distinct()
    sizes = {r["column"]: r["count"] for r in distinct.groupBy("column").count().collect()}
    too_many = sorted(c for c, n in sizes.items() if n > MAX_CATEGORIES)
    if limit is None and too_many:
        raise ValueError(f"more than {MAX_CATEGORIES} values in {', '.join(too_many)}: give a vocabulary")
    taken = [c for c, n in sizes.items() if limit is None or n <= limit]
    found: dict[str, list[str]] = {}
    for r in distinct.where(F.col("column").isin(taken)).collect():
        found.setdefault(r["column"], []).append(r["value"])
    return {c: sorted(v) for c, v in found.items()}


def indicator(column: str, value: str | None) -> Column:
    """1.0 where the column equals the value (null matches null), else 0.0."""
    return F.col(column).eqNullSafe(F.lit(value)).cast("double")


def share_aggs(vocab: Mapping[str, Sequence[str]], prefix: str = "", with_null: bool = True) -> list[Column]:
    """Share of each category among the rows of the group, optionally with a null category."""
    out = []
    for column, values in vocab.items():
        for value in [*values, *([None] if with_null else [])]:
            name = out_name(prefix, f"{column}_{'nan' if value is None else value}", "mean")
            out.append(F.avg(indicator(column, value)).alias(name))
    return out


def category_shares(df: DataFrame, key: str, vocab: Mapping[str, Sequence[str]], prefix: str = "", with_null: bool = True) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*share_aggs(vocab, prefix, with_null))


# --- slices -------------------------------------------------------------------------------


def slice_aggregate(
    df: DataFrame, key: str, slices: Mapping[str, Column], aggs: Sequence[Column], names: Sequence[str]
) -> DataFrame:
    """The same aggregates for several overlapping row subsets in one shuffle.

    Each row is repeated once per subset it belongs to, grouped by (key, subset) - the partial
    aggregate folds the copies before the shuffle - and the subsets are turned into columns
    ``<SLICE>_<NAME>``. A key without rows in a subset gets null there. ``names`` are the
    aliases of ``aggs``."""
    member = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in slices.items()]))
    rows = df.where(F.col(key).isNotNull()).withColumn("__slice", F.explode(member))
    # One struct per (key, subset) keeps the pivot to a single column per subset. Each subset holds
    # one struct per key, so ``first`` has nothing to choose.
    cells = rows.groupBy(key, "__slice").agg(*aggs)
    packed = cells.select(key, "__slice", F.struct(*names).alias("__cell"))
    wide = packed.groupBy(key).agg(
        *[F.expr(f"first(IF(__slice = '{name}', __cell, NULL), true) AS __{i}") for i, name in enumerate(slices)]
    )
    return wide.selectExpr(
        key, *[f"__{i}.`{n}` AS `{name}_{n}`" for i, name in enumerate(slices) for n in names]
    )


def sliced_stats(
    df: DataFrame,
    key: str,
    slices: Mapping[str, Column],
    spec: Spec,
    vocab: Mapping[str, Sequence[str]] | None = None,
    with_null: bool = True,
    folded: bool = False,
    counted: DataFrame | None = None,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Stat lists and category shares for each subset; column names are ``<SLICE>_<COL>_<STAT>``.

    The rows are brought together by key and every subset is taken in the same pass (``slice_columns``): no row is copied and
    nothing wide is shuffled. Keys above ``limit`` rows are folded from copies before their shuffle. ``folded`` folds all keys
    before the shuffle and without copies, for keys with many rows in few combinations of subsets that lie in few tasks.
    Statistics that cannot be merged (distinct counts) are taken the first way all the same."""
    vocab = vocab or {}
    if folded and all(stat in MERGED for stats in spec.values() for stat in stats):
        return folded_stats(df, key, slices, spec, vocab, with_null)
    # Known before the rows are: the rows that are folded have the same columns.
    columnwise = len(slices) * len(_stat_names(spec, vocab, with_null)) >= WIDE and foldable(df, key, spec)

    def fold(rows: DataFrame) -> DataFrame:
        marked, aggs = slice_columns(rows, slices, spec, vocab, with_null)
        inside = at_least_one(marked, slices)
        if columnwise:
            return fold_columns(inside, key, len(slices), spec, sum(len(v) + with_null for v in vocab.values()), inside.groupBy(key).agg(*aggs).schema)
        return inside.groupBy(key).agg(*aggs)

    def spread(rows: DataFrame) -> DataFrame:
        aggs = [*build_aggs(spec), *share_aggs(vocab, with_null=with_null)]
        return slice_aggregate(rows, key, slices, aggs, _stat_names(spec, vocab, with_null))

    return fold_by_key(df, key, fold, spread, counted=counted, limit=min(limit, COLUMN_ROWS) if columnwise else limit)


def _inside(i: int) -> str:
    return f"__in{i}"


def at_least_one(marked: DataFrame, slices: Mapping[str, Column]) -> DataFrame:
    """Rows of ``slice_columns`` that are in a subset: a key without any has no row in the result."""
    return marked.where(" OR ".join(_inside(i) for i in range(len(slices))))


def slice_columns(
    df: DataFrame, slices: Mapping[str, Column], spec: Spec, vocab: Mapping[str, Sequence[str]], with_null: bool = True
) -> tuple[DataFrame, list[Column]]:
    """The rows with a flag per subset, and the aggregates of all subsets over them, for rows that are already together by key.

    A condition that is null does not hold, and a key without rows in a subset gets null there."""
    values = [(c, v) for c, own in vocab.items() for v in [*own, *([None] if with_null else [])]]
    marked = df.withColumns(
        {
            **{_inside(i): F.coalesce(cond, F.lit(False)) for i, cond in enumerate(slices.values())},
            **{f"__is{j}": indicator(c, v) for j, (c, v) in enumerate(values)},
        }
    )
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, T.FractionalType)}
    names, aggs = _stat_names(spec, vocab, with_null), []
    for i, name in enumerate(slices):
        inside = _inside(i)
        found = [_within(column, stat, inside, column in floating) for column, stats in spec.items() for stat in stats]
        found += [f"avg(IF({inside}, __is{j}, NULL))" for j in range(len(values))]
        aggs += [F.expr(f"{text} AS `{name}_{n}`") for text, n in zip(found, names)]
    return marked, aggs


def _within(column: str, stat: str, inside: str, floating: bool) -> str:
    """One statistic over the rows that a flag marks; a distinct count keeps the values of one key."""
    if stat == "size":
        return f"nullif(count_if({inside}), 0)"
    own = f"IF({inside}, `{column}`, NULL)"
    if stat == "nunique":
        # Adding zero makes a negative zero the same value as zero.
        text = f"size(collect_set(IF({inside}, `{column}`{' + 0' if floating else ''}, NULL)))"
        return f"IF(count_if({inside}) > 0, CAST({text} AS BIGINT), NULL)"
    text = _STATS[stat].replace("{c}", own)
    return f"IF(count_if({inside}) > 0, {text}, NULL)" if stat in ("sum", "count") else text


def _stat_names(spec: Spec, vocab: Mapping[str, Sequence[str]], with_null: bool) -> list[str]:
    names = [out_name("", c, s) for c, stats in spec.items() for s in stats]
    for column, values in vocab.items():
        names += [out_name("", f"{column}_{value}", "mean") for value in [*values, *(["nan"] if with_null else [])]]
    return names


# From so many aggregates a key on, rows are folded a column at a time, and a key may have so many rows there.
WIDE = 100
COLUMN_ROWS = 500_000
# What ``fold_columns`` can take: statistics, and types of columns and of the key.
_FOLDED = {"min", "max", "mean", "sum", "var", "count", "size"}
_FOLDED_TYPES = (T.DoubleType, T.LongType, T.IntegerType)


def foldable(df: DataFrame, key: str, spec: Spec) -> bool:
    kinds = [df.schema[c].dataType for c in [key, *spec]]
    return all(isinstance(k, _FOLDED_TYPES) for k in kinds) and not isinstance(kinds[0], T.DoubleType) and all(s in _FOLDED for own in spec.values() for s in own)


def fold_columns(marked: DataFrame, key: str, n_slices: int, spec: Spec, n_shares: int, schema: T.StructType) -> DataFrame:
    """The aggregates of ``slice_columns`` over rows that are sorted by key, a column at a time: hundreds of aggregates a row are
    more code than a core's cache holds. Rows of the last key of a batch wait for the next batch."""
    flags, shares = [_inside(i) for i in range(n_slices)], [f"__is{j}" for j in range(n_shares)]
    columns, kinds = list(spec), [pa_type(f.dataType) for f in schema.fields]

    def folded(table: pa.Table) -> pa.RecordBatch:
        keys = table.column(0).to_numpy()
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        lengths = np.diff(np.append(starts, len(keys)))
        values = []
        for i in range(1 + n_slices, len(table.columns)):
            own = table.column(i).combine_chunks()
            known = own.is_valid().to_numpy(zero_copy_only=False)
            values.append((own.fill_null(0).to_numpy(zero_copy_only=False), None if known.all() else known))
        out: list[tuple[np.ndarray, np.ndarray | None]] = [(keys[starts], None)]
        with np.errstate(all="ignore"):
            for i in range(n_slices):
                inside = table.column(1 + i).to_numpy()
                size = np.add.reduceat(inside, starts, dtype=np.int64)
                for (value, known), stats in zip(values, spec.values()):
                    used = inside if known is None else inside & known
                    out += [_folded(value, used, stat, starts, lengths, size) for stat in stats]
                for value, _ in values[len(columns) :]:
                    out.append((np.add.reduceat(np.where(inside, value, 0.0), starts) / size, size == 0))
        arrays = [pa.array(v, mask=missing).cast(kind) for (v, missing), kind in zip(out, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column(0)[batch.num_rows - 1].as_py()
            if waiting and waiting[-1].column(0)[0].as_py() == last:
                waiting.append(batch)
                continue
            first = int(np.argmax(batch.column(0).to_numpy(zero_copy_only=False) == last))
            whole = [b for b in (*waiting, batch.slice(0, first)) if b.num_rows]
            if whole:
                yield folded(pa.Table.from_batches(whole))
            waiting = [batch.slice(first)]
        if waiting:
            yield folded(pa.Table.from_batches(waiting))

    cells = [f"`{c}`" for c in (key, *flags, *columns, *shares)]
    return marked.selectExpr(*cells).mapInArrow(run, schema)


def pa_type(kind: T.DataType) -> pa.DataType:
    return {T.DoubleType: pa.float64(), T.LongType: pa.int64(), T.IntegerType: pa.int32()}[type(kind)]


def _folded(value: np.ndarray, used: np.ndarray, stat: str, starts: np.ndarray, lengths: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """One statistic per key, and where it is missing. NaN is the largest value, as in SQL."""
    if stat == "size":
        return size, size == 0
    n = np.add.reduceat(used, starts, dtype=np.int64)
    if stat == "count":
        return n, size == 0
    if stat in ("min", "max"):
        if value.dtype.kind == "f":
            low = stat == "min"
            fold = np.fmin if low else np.maximum
            return fold.reduceat(np.where(used, value, np.nan if low else -np.inf), starts), n == 0
        ends, fold = np.iinfo(value.dtype), np.minimum if stat == "min" else np.maximum
        return fold.reduceat(np.where(used, value, ends.max if stat == "min" else ends.min), starts), n == 0
    if stat == "sum":
        near = _in_turn(np.where(used, value, 0), lengths)
        if value.dtype.kind == "f":
            return near, size == 0
        if (np.abs(near) >= 2.0**63).any():
            raise OverflowError("a sum of whole numbers is beyond 64 bits")
        return np.add.reduceat(np.where(used, value, 0).astype(np.int64, copy=False), starts), size == 0
    mean = _in_turn(np.where(used, value, 0), lengths) / n
    if stat == "mean":
        return mean, n == 0
    off = np.where(used, value - np.repeat(mean, lengths), 0.0)
    return _in_turn(off * off, lengths) / (n - 1), n < 2


def _in_turn(value: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of doubles per key, added in the order of the rows as an aggregate does."""
    return np.bincount(np.repeat(np.arange(len(lengths)), lengths), value, len(lengths))


# Statistics of overlapping subsets that follow from those of disjoint cells, from the merged parts of column i.
MERGED = {
    "min": "__low{i}",
    "max": "__high{i}",
    "mean": "__sum{i} / nullif(__n{i}, 0)",
    "sum": "coalesce(__total{i}, 0)",
    "var": "IF(__m{i}.n > 1, __m{i}.m2 / (__m{i}.n - 1), NULL)",
    "std": "IF(__m{i}.n > 1, sqrt(__m{i}.m2 / (__m{i}.n - 1)), NULL)",
    "count": "__n{i}",
    "size": "__rows",
}
# Parts of a cell by the statistic that needs them: how one is made of rows, how two are merged. ``m`` holds number, mean and
# sum of squared distances from the mean; these are merged pair by pair, so nothing large is subtracted.
_PARTS = {
    "low": ("min({c})", "min({p})"),
    "high": ("max({c})", "max({p})"),
    "n": ("count({c})", "sum({p})"),
    "sum": ("sum({d})", "sum({p})"),
    "total": ("sum({c})", "sum({p})"),
    "m": (
        "named_struct('n', count({c}), 'mean', coalesce(avg({d}), 0D), 'm2', coalesce(var_pop({d}) * count({c}), 0D))",
        "aggregate(collect_list({p}), named_struct('n', 0L, 'mean', 0D, 'm2', 0D), (a, b) -> IF(b.n = 0, a, named_struct('n', a.n + b.n, "
        "'mean', a.mean + (b.mean - a.mean) * b.n / (a.n + b.n), 'm2', a.m2 + b.m2 + (b.mean - a.mean) * (b.mean - a.mean) * a.n * b.n / (a.n + b.n))))",
    ),
}
_NEEDS = {"min": ["low"], "max": ["high"], "mean": ["n", "sum"], "sum": ["total"], "var": ["m"], "std": ["m"], "count": ["n"], "size": []}
# Subsets that a mask of one long can tell apart.
_MASK_BITS = 62


def folded_stats(
    df: DataFrame, key: str, slices: Mapping[str, Column], spec: Spec, vocab: Mapping[str, Sequence[str]], with_null: bool = True
) -> DataFrame:
    """``sliced_stats`` without copies of rows. Rows of a key that are in the same subsets are one cell, marked by a mask with
    a bit per subset; each row is folded into its cell once, before the shuffle. The cells of a key, at most one for each
    combination of subsets that occurs, are then merged to the overlapping subsets in the tasks that hold the key.

    A row in no subset counts nowhere, a condition that is null does not hold, and a key without rows in a subset gets null there."""
    if len(slices) > _MASK_BITS:
        raise ValueError(f"more than {_MASK_BITS} subsets")
    bits = [F.when(cond, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, cond in enumerate(slices.values())]
    rows = df.where(F.col(key).isNotNull()).withColumn("__mask", sum(bits[1:], bits[0])).where("__mask <> 0")

    parts = {"__rows": ("count(1)", "sum(__rows)")}
    result = []
    for i, (column, stats) in enumerate(spec.items()):
        plain = f"`{column}`"
        exact = isinstance(df.schema[column].dataType, T.DecimalType)
        fields = {"c": plain, "d": plain if exact else f"double({plain})"}
        for stat in stats:
            for part in _NEEDS[stat]:
                made, merged = _PARTS[part]
                use = {**fields, "d": f"double({plain})"} if part == "m" else fields
                parts[f"__{part}{i}"] = (made.format(**use), merged.format(p=f"__{part}{i}"))
            result.append(MERGED[stat].format(i=i))
    values = [(c, v) for c, own in vocab.items() for v in [*own, *([None] if with_null else [])]]
    rows = rows.withColumns({f"__is{j}": indicator(c, v).cast("long") for j, (c, v) in enumerate(values)})
    for j in range(len(values)):
        parts[f"__has{j}"] = (f"sum(__is{j})", f"sum(__has{j})")
        result.append(f"__has{j} / __rows")

    cells = rows.groupBy(key, "__mask").agg(*[F.expr(f"{made} AS {name}") for name, (made, _) in parts.items()])
    # Cells meet by key, so neither the merge nor the subsets that become columns need another shuffle.
    members = ", ".join(f"IF((__mask & {1 << i}L) <> 0, {i}, NULL)" for i in range(len(slices)))
    dealt = cells.repartition(key).withColumn("__slice", F.expr(f"explode(array_compact(array({members})))"))
    merged = dealt.groupBy(key, "__slice").agg(*[F.expr(f"{merge} AS {name}") for name, (_, merge) in parts.items()])
    # Types are those that the statistics have without cells.
    plain_types = df.groupBy(key).agg(*build_aggs(spec), F.lit(0)).schema.fields[1:-1]
    types = [*(f.dataType.simpleString() for f in plain_types), *["double"] * (len(result) - len(plain_types))]
    names = _stat_names(spec, vocab, with_null)
    cell = ", ".join(f"'{name}', CAST({value} AS {kind})" for name, value, kind in zip(names, result, types))
    packed = merged.selectExpr(f"`{key}`", "__slice", f"named_struct({cell}) AS __cell")
    wide = packed.groupBy(key).agg(*[F.expr(f"first(IF(__slice = {i}, __cell, NULL), true) AS __{i}") for i in range(len(slices))])
    return wide.selectExpr(f"`{key}`", *[f"__{i}.`{n}` AS `{name}_{n}`" for i, name in enumerate(slices) for n in names])


# --- statistics brought back to rows --------------------------------------------------------


def group_stats(df: DataFrame, groups: Sequence[str], spec: Spec) -> DataFrame:
    """Statistics of several grouping columns in one pass: rows (group, group_value, stats)."""
    cells = F.array(*[F.struct(F.lit(g).alias("group"), F.col(g).cast("string").alias("group_value")) for g in groups])
    rows = df.select(F.explode(cells).alias("__g"), *spec).select("__g.*", *spec).where("group_value IS NOT NULL")
    result = rows.groupBy("group", "group_value").agg(*build_aggs(spec))
    medians = [c for c, stats in spec.items() if "median" in stats]
    if medians:
        keys = ["group", "group_value"]
        found = selected_quantiles(rows, medians, {"median": 0.5}, keys)
        wide = found.groupBy(*keys).pivot("feature", medians).agg(F.first("median"))
        result = result.join(wide.select(*keys, *[F.col(c).alias(out_name("", c, "median")) for c in medians]), keys, "left")
    return result


def with_group_stats(df: DataFrame, groups: Sequence[str], spec: Spec, prefix: str = "GRP_") -> DataFrame:
    """Group statistics on every row as ``<prefix><GROUP>_<COL>_<STAT>``; a null group gets null.

    Aggregate and left join instead of a window: a window would pull all rows of a hot group into
    one task."""
    if not groups:
        return df
    return apply_group_stats(df, settle(group_stats(df, groups, spec)), groups, prefix)


def apply_group_stats(df: DataFrame, stats: DataFrame, groups: Sequence[str], prefix: str = "GRP_") -> DataFrame:
    """Look up statistics that were fitted before, on these or on other rows (a written table, it is read once per group);
    a null or unknown group gets null."""
    small = stats.count() <= LOOKUP_ROWS
    names = [c for c in stats.columns if c not in ("group", "group_value")]
    for g in groups:
        own = stats.where(F.col("group") == g).select(
            F.col("group_value").alias("__value"), *[F.col(c).alias(f"{prefix}{g}_{c}".upper()) for c in names]
        )
        keyed = df.withColumn("__value", F.col(g).cast("string"))
        df = (keyed.join(F.broadcast(own), "__value", "left") if small else spread_join(keyed, own, ["__value"])).drop("__value")
    return df


def with_group_total(df: DataFrame, keys: Sequence[str], column: str, name: str, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Sum of ``column`` per key list on every row (null sums count as 0, a missing key has no sum).

    Groups of up to ``limit`` rows are summed where their rows are; with larger ones it is an aggregate and a join."""
    keys = list(keys)
    if not hot_keys(df, keys, limit).isEmpty():
        totals = df.groupBy(*keys).agg(F.coalesce(F.sum(column), F.lit(0)).alias(name))
        return spread_join(df, totals, keys, limit=limit).select(*df.columns, name)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    # Rows with a missing key need not meet: they are dealt out.
    own = Window.partitionBy(*keys, F.when(~whole, F.pmod(mixer(df.select(*keys, column)), F.lit(NULL_SPREAD))))
    return df.withColumn(name, F.when(whole, F.coalesce(F.sum(column).over(own), F.lit(0))))


def ratio_of_sums(numerator: str, denominator: str) -> Column:
    return F.try_divide(F.coalesce(F.sum(numerator), F.lit(0.0)), F.coalesce(F.sum(denominator), F.lit(0.0)))


# --- profiles -----------------------------------------------------------------------------


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, data_type, n_rows, n_null, pct_null) for every column, one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(t).alias("data_type"),
                F.col("n").alias("n_rows"),
                (F.col("n") - F.col(f"c{i}")).alias("n_null"),
            )
            for i, (c, t) in enumerate(df.dtypes)
        ]
    )
    long = counts.select(F.inline(cells))
    share = F.coalesce(F.try_divide(F.col("n_null"), F.col("n_rows")), F.lit(0.0))
    return long.withColumn("pct_null", F.lit(100.0) * share).orderBy(F.desc("n_null"), "column_name")


def type_profile(df: DataFrame) -> dict[str, int]:
    kinds = [t for _, t in df.dtypes]
    return {t: kinds.count(t) for t in sorted(set(kinds))}


def duplicate_profile(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and duplicates (null equals null); copies fold before the shuffle."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_duplicates"),
    )


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table as scalar subqueries (evaluated once, no join)."""
    return df.withColumns({c: one_row.select(c).scalar() for c in one_row.columns})


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Count and percentage per class, largest to smallest ratio, negatives per positive."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))

    def size_of(value: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("label") == value, F.col("n"))), F.lit(0))

    whole = counts.agg(
        F.sum("n").alias("total"),
        (F.max("n") / F.min("n")).alias("imbalance_ratio"),
        (size_of(0) / F.greatest(size_of(1), F.lit(1))).alias("scale_pos_weight"),
    )
    share = F.lit(100.0) * F.col("n") / F.col("total")
    return with_scalars(counts, whole).select("label", "n", share.alias("pct"), "imbalance_ratio", "scale_pos_weight")


def value_shares(df: DataFrame, column: str, null_label: str = "UNKNOWN") -> DataFrame:
    """Count and share per value; null is reported under a label."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(null_label)).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)))
