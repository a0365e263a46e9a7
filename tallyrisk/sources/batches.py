"""The event log and the run history kept by batch: a batch that is repeated replaces itself.

Each batch has a folder of its own below the table's path. Spark's writer publishes a folder's files when the whole job is
done, so an attempt that was killed shows no rows; the repeated one writes the same folder anew. A row's id is the number of
its batch times 2^40 plus its place in the batch, so ids are unique without a counter and grow with the batches. What is
appended is written from one settled copy: the number returned, the rows checked and the rows stored are the same rows.

Defined cases: an empty batch is an empty folder; equal rows are rows of their own; null columns are kept but for those that
``with_defaults`` fills; a table without batches is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyrisk.session import settle
from tallyrisk.sources.event_log import split_lines, with_defaults
from tallyrisk.sources.schemas import API_CALL_COLUMNS, API_CALLS, MONITORING_RUNS
from tallyrisk.sources.tables import optional

ROW_BITS = 40  # rows of a batch: up to 2^40


def _folder(path: str, batch: int) -> str:
    if not 0 <= batch < 1 << (63 - ROW_BITS):
        raise ValueError(f"batch number out of range: {batch}")
    return f"{path.rstrip('/')}/batch={batch}"


def numbered(rows: DataFrame, batch: int, column: str = "id") -> DataFrame:
    """The rows with ids of the batch, without gaps. Rows stay where they are: the partitions' sizes (one small row each) are
    summed up, and each row adds its place in its partition."""
    # The number that Spark gives a row is its partition times 2^33 plus its place.
    placed = settle(rows.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [0] * (max(sizes, default=-1) + 1), 0
    for k in range(len(starts)):
        starts[k], total = total, total + sizes.get(k, 0)
    first = F.get(F.lit(starts or [0]).cast("array<long>"), part)
    return placed.withColumn(column, F.lit(batch << ROW_BITS) + first + place).drop("__at")


def write_events(events: DataFrame, path: str, batch: int) -> int:
    """Store events as the given batch and return their number."""
    ready = numbered(with_defaults(events).select(*API_CALL_COLUMNS), batch)
    return _replace(ready.select("id", *API_CALL_COLUMNS), _folder(path, batch))


def backfill_lines(spark: SparkSession, source: str, path: str, batch: int) -> int:
    """Load a JSON Lines file as one batch and return the number of its events. The lines are read and parsed once; a malformed
    one stops the load before anything is written, blank ones and values that are no object are left out."""
    lines = split_lines(spark.read.text(source)).withColumn("event", F.from_json("value", API_CALLS))
    parsed = settle(lines.where("kind IN ('event', 'malformed')").select("kind", "event"))
    if not parsed.where("kind = 'malformed'").isEmpty():
        raise ValueError(f"malformed log line in {source}")
    return write_events(parsed.select("event.*"), path, batch)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, API_CALLS)


def write_run(summary: DataFrame, path: str, batch: int) -> int:
    """Store one monitoring run (``operational`` and ``drift`` structs) under the number of its batch, which is its id."""
    now = F.current_timestamp()
    documents = [F.coalesce(F.to_json(c), F.lit("{}")).alias(c) for c in ("operational", "drift")]
    return _replace(settle(summary.select(F.lit(batch).cast("long").alias("id"), now.alias("run_at"), *documents)), _folder(path, batch))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, MONITORING_RUNS)


def _replace(rows: DataFrame, folder: str) -> int:
    rows.write.mode("overwrite").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder).count()


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches, with the column ``batch``; an empty table if there are none."""
    whole = f"{schema}, batch BIGINT"
    found = optional(lambda: spark.read.schema(whole).parquet(path))
    return spark.createDataFrame([], whole) if found is None else found
