"""Helpers that several operators share: table access, Arrow mapping, scratch tables, spread joins."""

from __future__ import annotations

import gc
import hashlib
import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyrisk.session import scratch_path, shared_dir, tune

# Rows per Arrow batch: with texts of 100 KB a batch stays near 50 MB in a Python worker.
BATCH_ROWS = 500
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Session settings the operators count on; the checkpoint folder is read from the session."""
    tune(spark)
    shared_dir(spark)
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, Sequence]], schema: T.StructType) -> DataFrame:
    """Apply ``fn`` (batch to columns by name) to each Arrow batch."""
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, schema)


class PerWorker:
    """An object that each Python worker makes once in a stage from what the driver read, and keeps over the tasks of
    that stage. Equal sources and makers are one object, whoever asks; objects that the stage at hand has not asked for are
    dropped, so a worker that outlives a stage does not hold what earlier ones made.
    The source is broadcast; it must have a bound that does not grow with the data."""

    def __init__(self, spark: SparkSession, source, make: Callable):
        packed = cloudpickle.dumps((source, make))
        self.key = hashlib.sha256(packed).hexdigest()
        self.packed = spark.sparkContext.broadcast(packed)

    def get(self):
        kept = sys.__dict__.setdefault("_tallyrisk_llm", {})
        task = TaskContext.get()
        stage = task.stageId() if task else -1
        if self.key in kept:
            made = kept[self.key][1]
        else:
            for key in [k for k, (last, _) in kept.items() if last != stage]:
                del kept[key]
            gc.collect()
            source, make = cloudpickle.loads(self.packed.value)
            made = make(source)
        kept[self.key] = (stage, made)
        return made


def write_out(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: smaller than a checkpoint, and
    later reads see exactly these rows, also after an executor is lost."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(doc_id, text: str | None) -> bytes:
    """128 bits that tell rows apart by id and text, so that repeated and missing ids do no harm; a null text is empty."""
    own = "-" if doc_id is None else str(doc_id)
    return xxhash.xxh3_128_digest(f"{-1 if doc_id is None else len(own)}:{own}:{text or ''}".encode("utf-8", "surrogatepass"))


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of steps whose results are written: it acts when the driver's
    JVM collects its garbage, which may otherwise be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread_lookup(rows: DataFrame, per_key: DataFrame, key: str | list[str], copies: str, salt: F.Column, share: int) -> DataFrame:
    """Inner join of many rows to a table with one row per key, whatever share of the rows a key
    holds: a key with more than ``share`` rows (column ``copies`` of the table) has its table row
    repeated, and its rows are dealt out by ``salt``. The number of such keys is at most
    count(rows) / share, so the salted part of the table never has more rows than the table plus that."""
    key = [key] if isinstance(key, str) else key
    parts = F.greatest(F.lit(1), F.ceil(F.col(copies) / F.lit(share))).cast("int")
    hot = per_key.where(F.col(copies) > share).select(*key, parts.alias("__parts"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn(
        "__salt", F.coalesce(F.pmod(salt, F.col("__parts")), F.lit(0)).cast("int")
    )
    repeated = per_key.withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("__parts").join(repeated, [*key, "__salt"]).drop("__salt")
