"""Registry, table access, and the number format both engines are compared in."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, types as T

from tallyrisk.session import shared_dir, tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Sums of doubles differ in the last bits with the order of addition. Both sides therefore keep
# single precision (24 bits), and rests of a subtraction below TINY count as zero. Queries without SQL return what they computed.
TINY = "1e-9"


def tidy(df: DataFrame) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    if not doubles:
        return df
    return df.selectExpr(
        *[
            f"CASE WHEN abs(`{c}`) < {TINY} THEN 0D ELSE CAST(CAST(`{c}` AS FLOAT) AS DOUBLE) END AS `{c}`" if c in doubles else f"`{c}`"
            for c in df.columns
        ]
    )


def tidy_sql(sql: str, doubles: Sequence[str]) -> str:
    """Wrap a SELECT so that the named columns are rounded like ``tidy`` does."""
    if not doubles:
        return sql
    cells = [
        f'CASE WHEN abs("{c}") < {TINY} THEN 0::DOUBLE ELSE CAST(CAST(CAST("{c}" AS DOUBLE) AS FLOAT) AS DOUBLE) END AS "{c}"'
        for c in doubles
    ]
    return f"SELECT * REPLACE ({', '.join(cells)}) FROM ({sql}) AS raw_result"


def query(name: str, sql: str | None = None, doubles: str | Sequence[str] = ()) -> Callable[[Query], Query]:
    """Register a query and, if given, its SQL; ``doubles`` names the SQL's floating-point columns."""

    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            shared_dir(spark)
            found = fn(spark, sf_dir)
            return found if sql is None else tidy(found)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = tidy_sql(sql.strip(), doubles.split() if isinstance(doubles, str) else doubles)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
