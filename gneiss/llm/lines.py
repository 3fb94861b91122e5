"""Operator 11, line de-duplication, with DataFrame functions only.

Rows are written once with their lines and the hash of each normalised line. The hashes are exploded and the distinct
documents of each are counted (partial sums by hash and document first, so a line of every third row stays spread out);
lines of the hashes over the threshold come back to their rows as positions, and the others are put together again by
position. Only hashes and positions are shuffled for the search; texts move once, to meet their positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import hot_join, table, written

#: Documents from which a line goes, and code points from which a normalised line counts.
MIN_DOCUMENTS, MIN_CHARS = 10, 1
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_keys(lines: Column, min_chars: int) -> Column:
    """For each line a 128-bit hash of it, stripped and with A-Z lower-cased; null for one that is too short."""
    normal = F.transform(lines, lambda x: F.translate(F.btrim(x, F.lit(_BLANK)), _UPPER, _LOWER))
    return F.transform(normal, lambda x: F.when(F.length(x) >= min_chars, F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))))


def split_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs as a written table: id (a number of the row), row (its columns but text), blank (null text), lines, keys."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    rows = docs.select(F.monotonically_increasing_id().alias("id"), row.alias("row"), F.col("text").isNull().alias("blank"), lines.alias("lines"), line_keys(lines, min_chars).alias("keys"))
    return written(rows, "lines")


def common_places(rows: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(id, places): for rows that hold lines of at least min_documents different doc_ids, the positions of those lines."""
    lines = rows.select("id", F.struct("row.doc_id").alias("doc"), F.posexplode("keys").alias("pos", "key")).filter("key is not null").select("id", "doc", "pos", "key.a", "key.b")
    counted = lines.groupBy("a", "b").agg(F.count_distinct("doc").alias("documents"), F.count(F.lit(1)).alias("n"))
    common = written(counted.filter(F.col("documents") >= min_documents).select("a", "b", "n"), "common-lines")
    return hot_join(lines.drop("doc"), common, ["a", "b"], "n").groupBy("id").agg(F.collect_list("pos").alias("places"))


def without_common_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row, blank, n_lines, n_dropped, kept) of every row of docs(doc_id, text): row has its columns but text, kept the
    lines that stay, joined by a newline.

    A line's key is the line without blanks (space, tab, newline, \\v, \\f, \\r) at its ends and with A-Z lower-cased. A key
    of min_chars code points or more that min_documents different doc_ids hold loses all its lines everywhere. Null and
    empty texts are one empty line (blank tells null ones). Repeats of a line in a document count once, rows of one
    doc_id are one document, and so are rows without a doc_id; each row has its own result. An empty table gives no
    rows. Texts of any length are split whole. Other columns may have any names.
    """
    rows = split_rows(docs, min_chars)
    placed = rows.drop("keys").join(common_places(rows, min_documents), "id", "left").withColumn("places", F.coalesce("places", F.array().cast("array<int>")))
    n = F.size("lines")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("places"))
    kept = F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n")
    return placed.select("row", "blank", n.cast("long").alias("n_lines"), F.size("places").cast("long").alias("n_dropped"), kept.alias("kept"))


def drop_common_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the common lines of without_common_lines cut from text, and n_chars, if there is one, set anew where
    lines went. A null text stays null; columns, order of columns and number of rows stay as they are."""
    cut = F.col("n_dropped") > 0

    def column(c: str) -> Column:
        if c == "text":
            return F.when(~F.col("blank"), F.col("kept")).alias(c)
        old = F.col("row").getField(c)
        return (F.when(cut, F.length("kept").cast(docs.schema[c].dataType)).otherwise(old) if c == "n_chars" else old).alias(c)

    return without_common_lines(docs, min_documents, min_chars).select(*map(column, docs.columns))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document; edge cases as in without_common_lines."""
    found = without_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
