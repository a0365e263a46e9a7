"""Join shapes: child aggregates onto the client row, chains, membership, key pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyrisk.session import settle

# A key with more rows than this is spread over several tasks.
ROWS_PER_TASK = 4_000_000
# A table with at most this many rows is small enough to broadcast (rows are a key and some numbers).
LOOKUP_ROWS = 200_000
NULL_SPREAD = 1024
# Keys are counted by this many hash buckets first; only buckets above the limit can hold a hot key.
_BUCKETS = 65_536


def attach_children(client: DataFrame, children: Sequence[DataFrame], key: str) -> DataFrame:
    """Left join of tables that all have one row per key; see ``spread_joins`` for raw client rows."""
    return reduce(lambda left, right: left.join(right, key, "left"), children, client)


def join_chain(frames: Sequence[DataFrame], keys: str | Sequence[str | list[str]], how: str = "inner") -> DataFrame | None:
    """Join the frames from left to right, on one shared key or on one key (list) per step.
    Null keys never match (SQL rule)."""
    if not frames:
        return None
    result = frames[0]
    for step, frame in enumerate(frames[1:]):
        result = result.join(frame, keys if isinstance(keys, str) else keys[step], how)
    return result


def mixer(df: DataFrame) -> Column:
    """Number that spreads rows: the same again for a recomputed task, different for copies of a
    row in different input partitions."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in plain])


def hot_keys(rows: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows and the number of tasks they need; at most
    count(rows) / limit of them. Rows are counted per hash bucket first, which shuffles some numbers a task, and per key
    only in the buckets that hold more than the limit."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(_BUCKETS))
    full = rows.groupBy(bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
    buckets = [r["__bucket"] for r in full.select("__bucket").collect()]
    rows = rows.where(bucket.isin(buckets) if buckets else F.lit(False))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
    return settle(counts.select(*keys, F.ceil(F.col("__n") / F.lit(limit)).cast("int").alias("__parts")))


def spread_joins(
    rows: DataFrame,
    tables: Sequence[DataFrame],
    keys: Sequence[str],
    how: str = "left",
    limit: int = ROWS_PER_TASK,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join rows to tables with one row per key (``left``, ``inner`` or ``left_semi``), whatever
    share of the rows a key holds.

    AQE does not split such a join: the aggregate that makes the table shares its shuffle with the
    join. So the hot keys are found first (the bound on their number bounds the broadcast), their
    rows are dealt out to salts, and their table row is repeated once per salt. Rows with a null key
    are dealt out as well. ``counted`` may name a cheaper table with at least the same keys."""
    keys = list(keys)
    hot = hot_keys(counted if counted is not None else rows, keys, limit)
    if hot.isEmpty():
        return reduce(lambda left, right: left.join(right, keys, how), tables, rows)
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    salt = F.when(no_key, F.pmod(mixer(rows), F.lit(NULL_SPREAD))).otherwise(
        F.coalesce(F.pmod(mixer(rows), F.col("__parts")), F.lit(0))
    )
    result = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt.cast("int")).drop("__parts")
    last = F.coalesce(F.col("__parts"), F.lit(1)) - 1
    for per_key in tables:
        copies = per_key.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), last)))
        result = result.join(copies.drop("__parts"), [*keys, "__salt"], how)
    return result.drop("__salt")


def spread_join(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "left", limit: int = ROWS_PER_TASK) -> DataFrame:
    return spread_joins(rows, [per_key], keys, how, limit)


def fold_by_key(
    df: DataFrame,
    key: str,
    fold: Callable[[DataFrame], DataFrame],
    spread: Callable[[DataFrame], DataFrame],
    order: Sequence[Column] = (),
    counted: DataFrame | None = None,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row per key from its rows; rows without a key are left out.

    The rows themselves are shuffled, not what has been made of them, and are sorted by key (and ``order``), so a wide
    aggregate in ``fold`` holds one key at a time and is not shuffled at all. That pays where a key's rows lie in many tasks
    or are few, so that folding before the shuffle folds nothing. Keys with more than ``limit`` rows go through ``spread``
    instead, which has to fold before its shuffle. ``counted`` may name a cheaper table with the same keys."""
    rows = df.where(F.col(key).isNotNull())
    hot = hot_keys((counted if counted is not None else df).where(F.col(key).isNotNull()).select(key), [key], limit)

    def in_order(part: DataFrame) -> DataFrame:
        return part.repartition(key).sortWithinPartitions(F.col(key).asc(), *order)

    if hot.isEmpty():
        return fold(in_order(rows))
    few = F.broadcast(hot.select(key))
    cold, warm = rows.join(few, key, "left_anti"), rows.join(few, key, "left_semi")
    return fold(in_order(cold)).unionByName(spread(warm))


def lookup_join(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``spread_join`` for a table that is usually small: it is written once and counted, and
    broadcast if it has at most ``LOOKUP_ROWS`` rows."""
    stored = settle(per_key)
    if stored.count() <= LOOKUP_ROWS:
        return rows.join(F.broadcast(stored), list(keys), how)
    return spread_join(rows, stored, keys, how)


def members_of(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_semi")


def pairs_with(df: DataFrame, pair: Sequence[str], per_item: DataFrame, item: str) -> DataFrame:
    """Distinct key pairs with the aggregates of one of the keys."""
    return spread_join(df.select(*pair).distinct(), per_item, [item])


def union_tables(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
