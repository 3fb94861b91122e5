"""Streams over folders of Parquet files, run with the availableNow trigger: what is there is read once, a checkpoint
remembers it, and the next run goes on from there."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.windows import first_per
from gneiss.shared import scratch


def folder(spark: SparkSession, path: str, pattern: str, schema, files_per_batch: int = 100) -> DataFrame:
    """The files of a folder whose names fit, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(path)


def table(spark: SparkSession, path: str, name: str, schema, files_per_batch: int = 100) -> DataFrame:
    """The Parquet table `name` of a folder as a stream, whether it is one file or a folder of part files."""
    # A pattern, as a stream over a plain path takes folders only, and pathGlobFilter looks at the names of part files.
    at = re.sub(r"([\[\]{}*?\\])", r"\\\1", path.rstrip("/"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{at}/{{{name}}}.parquet")


def bursts(events: DataFrame, key: str, at: str, quiet: str, late: str) -> DataFrame:
    """Events of a key with pauses under `quiet` as one burst; rows later than `late` behind the newest are dropped by the watermark."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, quiet)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("closes"), "n")


def run_complete(stream: DataFrame, name: str) -> DataFrame:
    """Runs an aggregating stream over what is there; its whole result, replaced with every batch, as a table in the shared folder."""
    spark = stream.sparkSession
    out = scratch(spark, f"stream-{name}")
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/data")  # what there is if no batch comes
    query = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/data")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def run_ingest(stream: DataFrame, key: list[str], order: str, name: str, target: str | None = None, state: str | None = None) -> DataFrame:
    """Of each key of a stream the first row in order, as a table; batch by batch those rows are appended whose key is new
    or that come before what is there. A batch that is run again adds nothing. target and state resume an earlier run."""
    spark = stream.sparkSession
    base = scratch(spark, f"ingest-{name}")
    target, state = target or f"{base}/data", state or f"{base}/state"
    none = spark.createDataFrame([], stream.schema)
    none.write.mode("append").parquet(target)

    def first(rows: DataFrame) -> DataFrame:
        return first_per(rows, key, [F.col(order)])

    def add(batch: DataFrame, _: int) -> None:
        old = batch.sparkSession.read.schema(batch.schema).parquet(target)
        had = old.groupBy(*key).agg(F.min(order).alias("_had"))
        kept = first(batch).join(had, key, "left").filter(F.col("_had").isNull() | (F.col(order) < F.col("_had")))
        kept.select(batch.columns).write.mode("append").parquet(target)

    stream.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return first(spark.read.schema(stream.schema).parquet(target))
