"""Session settings, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Settings that can be changed on a live session. Skewed join partitions are split by AQE,
# also where that costs one more shuffle, so that a hot key never ends up in a single task.
# The JVM does not compile methods above 8000 bytes of bytecode: the wide aggregates run faster
# without whole-stage code than as one interpreted method. Rows that are sorted by key are aggregated in that order,
# in one step and one key at a time, instead of in two hash maps.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.replaceHashWithSortAgg": "true",
}

# Set when a session is built: call sites are not recorded for every column expression, which would
# take most of the time needed to describe a table of a thousand columns.
START_CONF = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set what is unset; a setting that the user chose stays as it is."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "tallyrisk", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **START_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tallyrisk-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: later reads see exactly these rows,
    also after an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Rows of one task in a fit. A tree's row with its draws takes some 600 bytes in memory.
FIT_ROWS = 200_000


def settle_evenly(df: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """``settle`` for rows that are read again and again by a fit: if a partition has more than ``most`` rows, they are
    dealt out evenly, so that the memory of a task is bounded and all cores have work."""
    rows = settle(df)
    sizes = rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("largest")).first()
    if (sizes["largest"] or 0) <= most:
        return rows
    return settle(rows.repartition(-(-sizes["n"] // most)))
