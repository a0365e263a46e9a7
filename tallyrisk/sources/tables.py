"""Reading and writing raw tables, with optional sources and a preference chain."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_csv(spark: SparkSession, path: str, schema: str, cap: int | None = None, order: str | Sequence[str] | None = None) -> DataFrame:
    """CSV with a header and a given schema. ``cap`` keeps the first rows by ``order`` (files have
    no row order in Spark, so a cap without an order is refused)."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    if cap is None:
        return df
    if order is None:
        raise ValueError("a row cap needs an order")
    keys = [order] if isinstance(order, str) else list(order)
    return df.orderBy(*keys).limit(cap)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def optional(read: Callable[[], DataFrame]) -> DataFrame | None:
    """The table, or None if its path does not exist. Other faults are raised."""
    try:
        return read()
    except AnalysisException as fault:
        if fault.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
            return None
        raise


def required(name: str, read: Callable[[], DataFrame]) -> DataFrame:
    table = optional(read)
    if table is None:
        raise FileNotFoundError(f"required table is missing: {name}")
    return table


def read_raw_csv(spark: SparkSession, folder: str, files: Mapping[str, str], schemas: Mapping[str, str], needed: Sequence[str]) -> dict[str, DataFrame]:
    """All raw tables found in a folder; ``needed`` ones must exist, others are skipped."""
    found = {}
    for name, file in files.items():
        def read(file=file, name=name):
            return read_csv(spark, f"{folder}/{file}", schemas[name])

        table = required(name, read) if name in needed else optional(read)
        if table is not None:
            found[name] = table
    return found


def ingest(df: DataFrame, path: str, key: str, buckets: int | None = None, table: str | None = None) -> None:
    """One-time conversion to Parquet. With a table name and a bucket number the rows are bucketed
    and sorted by the key, so that later aggregates and joins on it need no shuffle."""
    if table and buckets:
        df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    else:
        df.write.mode("overwrite").parquet(path)


def first_source(spark: SparkSession, schema: str, table: str | None = None, json_path: str | None = None) -> DataFrame:
    """The table if it exists and has rows, else the JSON Lines path, else an empty frame."""
    if table and spark.catalog.tableExists(table):
        stored = spark.table(table)
        if not stored.isEmpty():
            return stored
    if json_path:
        lines = optional(lambda: spark.read.schema(schema).json(json_path))
        if lines is not None:
            return lines
    return spark.createDataFrame([], schema)


def csv_pair_features(df: DataFrame, names: Sequence[str], medians: Mapping[str, float], columns: str = "columns_csv", values: str = "row_csv") -> DataFrame:
    """Rows kept as two CSV strings (names and values) to one number per model feature. Blank or
    unreadable values take the median, features without a median 0."""

    def cells(c: str):
        # Quoted cells may hold commas: split only at commas outside quotes.
        parts = F.split(F.trim(F.col(c)), ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
        return F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), '""', '"'))

    heads, body = cells(columns), cells(values)
    shorter = F.least(F.size(heads), F.size(body))
    pairs = F.arrays_zip(F.slice(heads, 1, shorter).alias("k"), F.slice(body, 1, shorter).alias("v"))
    # On a repeated name the last value counts: sorted by name and place, it is the one that another name follows.
    placed = F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v")))
    found = F.col("__pairs")
    last = F.filter(found, lambda p, i: ~p["k"].eqNullSafe(F.get(found, i + 1)["k"]))
    named = F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))))
    # One pass over the text of the map fills all wanted names; a lookup for each would walk through the map each time.
    wanted = T.StructType([T.StructField(n, T.StringType()) for n in names])
    once = df.withColumn("__pairs", F.array_sort(placed)).withColumn("__cells", F.from_json(F.to_json(named), wanted))
    return once.select(
        *[c for c in df.columns if c not in (columns, values)],
        *[F.coalesce(F.col("__cells").getField(n).try_cast("double"), F.lit(float(medians.get(n, 0.0)))).alias(n) for n in names],
    )


def ensure_reference(pairs: DataFrame, path: str, names: Sequence[str], medians: Mapping[str, float]) -> DataFrame:
    """The reference table at ``path``. If there is none yet, the rows kept as pairs of CSV strings are turned into model
    features and written there as CSV with a header."""
    found = optional(lambda: read_reference(pairs.sparkSession, path))
    if found is not None:
        return found
    csv_pair_features(pairs, names, medians).select(*names).write.option("header", True).csv(path)
    return read_reference(pairs.sparkSession, path)


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """A wide CSV with a header as numbers; a cell that is no number is null. All columns are kept: which of them can be
    compared is decided when both sides are known."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(f"`{c}`").try_cast("double").alias(c) for c in raw.columns])


def median_payload(medians: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row with a map feature -> median; features without a median get 0."""
    wanted = F.explode(F.lit(list(names)))
    spark = medians.sparkSession
    model = spark.range(1).select(wanted.alias("feature"))
    filled = model.join(medians, "feature", "left").select("feature", F.coalesce("median", F.lit(0.0)).alias("median"))
    # The number of model features bounds this list.
    return filled.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", "median")))).alias("features"))
