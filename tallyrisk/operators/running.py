"""Running totals and exact quantiles without putting a whole ordering into one task.

The input is one row per (groups, order value), i.e. counts that were aggregated before. The rows
are range-partitioned by (groups, order), the partition number is written down with the rows (a
reliable checkpoint, so a lost executor cannot move a row to another chunk), and the running total
is the total inside the chunk plus the totals of the earlier chunks of the same group. A group of
any size is thereby spread over as many tasks as its distinct values need.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyrisk.session import settle

_CHUNK = "__chunk"


def in_chunks(df: DataFrame, order: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Range-partition by (groups, order) and fix the partition number as a column."""
    placed = df.repartitionByRange(*groups, *order).withColumn(_CHUNK, F.spark_partition_id())
    return settle(placed)


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    sums: Sequence[str],
    groups: Sequence[str] = (),
    next_of: str | None = None,
) -> DataFrame:
    """Add ``<c>_before`` (sum over smaller order values of the group) and ``<c>_total``.
    ``next_of`` also adds ``<c>_next``, the following value in the group (null for the last)."""
    placed = in_chunks(df, order, groups)
    keys = [*groups, _CHUNK]

    # At most (number of chunks + number of groups) rows: each group covers adjacent chunks.
    per_chunk = placed.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums], *([F.min(next_of).alias("__first")] if next_of else [])
    )
    group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = group.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(
        *keys,
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{c}_offset") for c in sums],
        *[F.sum(c).over(group).alias(f"{c}_total") for c in sums],
        *([F.lead("__first").over(group.orderBy(_CHUNK)).alias("__next_chunk")] if next_of else []),
    )

    inside = Window.partitionBy(*keys).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns(
        {
            **{f"__{c}_local": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums},
            **({f"__{next_of}_next": F.lead(next_of).over(inside)} if next_of else {}),
        }
    )
    joined = local.join(offsets, keys)
    return joined.select(
        *df.columns,
        *[(F.col(f"__{c}_local") + F.col(f"__{c}_offset")).alias(f"{c}_before") for c in sums],
        *[f"{c}_total" for c in sums],
        *([F.coalesce(f"__{next_of}_next", "__next_chunk").alias(f"{next_of}_next")] if next_of else []),
    )


def ranked(df: DataFrame, order: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """0-based ``position`` of each row and ``group_size``; the order must be unique in the group."""
    run = running_totals(df.withColumn("__one", F.lit(1).cast("long")), order, ["__one"], groups)
    return run.select(*df.columns, F.col("__one_before").alias("position"), F.col("__one_total").alias("group_size"))


def long_form(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """(groups, feature, value) rows for numeric columns, null and NaN values left out."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(*groups, F.inline(cells))
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def at_rank(rank: Column, among: Column | None = None) -> Column:
    """The value whose rows hold the rank, of the rows (value, n, n_before) that ``among`` allows."""
    hit = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
    return F.max(F.when(hit if among is None else hit & among, F.col("value")))


def exact_quantiles(
    df: DataFrame,
    value: str,
    quantiles: Mapping[str, float],
    groups: Sequence[str] = (),
    method: str = "linear",
) -> DataFrame:
    """One row per group with a column per named quantile.

    ``linear`` interpolates between the two neighbours; ``lower`` takes the value at
    rank floor(p * (n - 1)). Rows with a null or NaN value or a null group are left out.
    Without groups the values are selected from, not ordered (see ``selection``); one row, nulls if there are no values."""
    from tallyrisk.operators.selection import selected_quantiles

    if not groups:
        found = selected_quantiles(df, [value], quantiles, method=method)
        return found.agg(*[F.max(name).alias(name) for name in quantiles])
    usable = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    for g in groups:
        usable = usable & F.col(g).isNotNull()
    counts = (
        df.where(usable)
        .groupBy(*groups, F.col(value).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return quantiles_of_counts(counts, quantiles, groups, method)


def quantiles_of_counts(
    counts: DataFrame, quantiles: Mapping[str, float], groups: Sequence[str] = (), method: str = "linear"
) -> DataFrame:
    """Quantiles of rows that are given as (groups, value, n), one row per value."""
    run = running_totals(counts, ["value"], ["n"], groups)
    picks = []
    for name, p in quantiles.items():
        spot = F.lit(float(p)) * (F.col("n_total") - 1)
        picks.append(at_rank(F.floor(spot)).alias(f"__{name}_low"))
        if method == "linear":
            picks.append(at_rank(F.ceil(spot)).alias(f"__{name}_high"))
            picks.append(F.max(spot - F.floor(spot)).alias(f"__{name}_part"))
    found = run.groupBy(*groups).agg(*picks)
    low = {name: F.col(f"__{name}_low") for name in quantiles}
    if method == "linear":
        result = {
            name: low[name] + (F.col(f"__{name}_high") - low[name]) * F.col(f"__{name}_part") for name in quantiles
        }
    else:
        result = low
    return found.select(*groups, *[c.alias(name) for name, c in result.items()])


def column_medians(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """(feature, median) for numeric columns; exact, or ``approx_percentile`` if an accuracy is given."""
    from tallyrisk.operators.selection import MANY_COLUMNS, medians_of_many, selected_quantiles

    if accuracy:
        long = long_form(df, columns)
        return long.groupBy("feature").agg(F.approx_percentile("value", F.lit(0.5), F.lit(accuracy)).alias("median"))
    if len(columns) >= MANY_COLUMNS:
        return medians_of_many(df, columns)
    return selected_quantiles(df, columns, {"median": 0.5})


def fit_medians(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> dict[str, float]:
    """Medians as plain numbers, one per column (all-null columns are absent)."""
    return {r["feature"]: r["median"] for r in column_medians(df, columns, accuracy).collect()}
