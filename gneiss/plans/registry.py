"""The register of queries, and access to the tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 250
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """t.orders is the Parquet table orders of the folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        # Rows that Python holds at once: whole texts are long.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def standard(df: DataFrame) -> DataFrame:
    """Whole numbers as long, others as double: the types that results are compared in."""
    wide = {"tinyint": "long", "smallint": "long", "int": "long", "float": "double"}
    return df.select(*(F.col(f"`{n}`").cast(wide[k] if k in wide else "double").alias(n) if k in wide or k.startswith("decimal") else F.col(f"`{n}`") for n, k in df.dtypes))


def query(name: str, sql: str | None = None):
    """Registers fn(tables) -> DataFrame under a name, with the SQL that gives the same rows."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: standard(fn(Tables(spark, sf_dir)))
        if sql:
            ORACLES[name] = sql
        return fn

    return add
