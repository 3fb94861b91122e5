"""JSON lines, CSV catalogues, bundles with checksums, guides with a JSON payload, WebVTT captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.text import seconds_of


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; a line that is none is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_catalogue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; quotes may span lines; a byte order mark is not part of the first name."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', enforceSchema=True)


def write_atomic(df: DataFrame, path: str, kind: str) -> None:
    """Replaces path as a whole by Spark's commit protocol."""
    df.write.mode("overwrite").format(kind).save(path)


def bundle_faults(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, fault) of files(path, content) against manifest(path, sha256): missing, unlisted, or of another checksum."""
    have = files.select("path", F.sha2("content", 256).alias("_have"))
    both = have.join(manifest.select("path", F.col("sha256").alias("_want")), "path", "full_outer")
    fault = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unlisted").when(F.col("_have") != F.col("_want"), "checksum")
    return both.select("path", fault.alias("fault")).filter("fault IS NOT NULL")


def dangling(rows: DataFrame, column: str, targets: DataFrame, key: str) -> DataFrame:
    """Rows whose reference meets no target."""
    return rows.filter(F.col(column).isNotNull()).join(targets.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def guide_payload(markdown: Column, schema: str) -> Column:
    """The object in the one fenced JSON block of a guide; null without one, with several, or if it breaks the schema."""
    fences = F.regexp_extract_all(markdown, F.lit(r"(?s)```json\n(.*?)\n```"), F.lit(1))
    return F.when(F.size(fences) == 1, F.from_json(F.get(fences, F.lit(0)), schema))


def captions(vtt: Column) -> Column:
    """Segments (start, end, text) of a WebVTT text in order: tags dropped, lines joined, only those that end after they start."""
    stamp = r"((?:[0-9]+:)?[0-9]+:[0-9]+[.,][0-9]+)"
    blocks = F.split(vtt, r"\n[ \t]*\n")
    timed = F.filter(blocks, lambda b: b.rlike(stamp + r"\s*-->\s*" + stamp))

    def one(b: Column) -> Column:
        times = lambda i: seconds_of(F.regexp_extract(b, stamp + r"\s*-->\s*" + stamp, i))
        body = F.regexp_replace(F.regexp_extract(b, r"(?s)-->[^\n]*\n(.*)$", 1), r"<[^>]*>", "")
        return F.struct(times(1).alias("start"), times(2).alias("end"), F.trim(F.regexp_replace(body, r"\s+", " ")).alias("text"))

    return F.filter(F.transform(timed, one), lambda s: (s["end"] > s["start"]) & (s["text"] != ""))
