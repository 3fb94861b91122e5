"""Texts to chunks: fixed slices, article chunks, token-bounded packing, line packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from gneiss.functions.text import token_count


def fixed_slices(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, chunk_index, body, start_char, end_char): consecutive slices of size characters; empty texts have none."""
    n = F.ceil(F.length(text) / size).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    i = F.col("chunk_index")
    return df.select(key, F.col(text).alias("_t"), F.explode(at).alias("chunk_index")).select(
        key, "chunk_index", F.substring("_t", i * size + 1, F.lit(size)).alias("body"), (i * size).alias("start_char"), F.least((i + 1) * size, F.length("_t")).alias("end_char")
    )


def article_chunks(df: DataFrame, key: str, text: str, title: str, size: int = 1200) -> DataFrame:
    """Chunk 0 is title and lead (the first non-blank line, at most size characters), the rest fixed slices of what follows.

    A text without anything gets one chunk "[empty]".
    """
    lead = F.substring(F.regexp_extract(text, r"^\s*([^\n]*)", 1), 1, size)
    start = F.length(F.regexp_extract(text, r"^(\s*)", 1)) + F.length(lead)
    base = df.select(key, F.col(title).alias("_title"), F.col(text).alias("_t"), lead.alias("_lead"), start.alias("_start"))
    head = base.select(key, F.lit(0).alias("chunk_index"), F.when(F.col("_lead") == "", F.lit("[empty]")).otherwise(F.concat_ws("\n", F.concat(F.lit("Title: "), "_title"), F.concat(F.lit("Lead: "), "_lead"))).alias("body"), F.lit("title_lead").alias("kind"))
    rest = fixed_slices(base.select(key, F.substring("_t", F.col("_start") + 1, F.length("_t")).alias("_rest")), key, "_rest", size)
    return head.unionByName(rest.select(key, (F.col("chunk_index") + 1).alias("chunk_index"), "body", F.lit("body").alias("kind")))


def comment_chunks(df: DataFrame, key: str, text: str, context: Column, size: int = 1200) -> DataFrame:
    """Fixed slices; the text to embed starts with the thread's context; later slices are marked as continued."""
    cut = fixed_slices(df.withColumn("_c", context), key, text, size)
    return cut.join(df.select(key, context.alias("_c")), key).select(
        key, "chunk_index", F.when(F.col("chunk_index") == 0, "comment_contextual").otherwise("comment_continued").alias("kind"), F.concat_ws("\n", "_c", "body").alias("embed_text")
    )


def chunk_metadata(df: DataFrame, embed_text: str) -> DataFrame:
    return df.withColumn("token_count", token_count(F.col(embed_text))).withColumn("embed_hash", F.sha2(F.col(embed_text), 256))


def packed(parts: Column, limit: int, joiner: str = " ") -> Column:
    """Greedy packing of an array of strings, in order, into strings of at most limit characters; longer parts stay alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def add(state: Column, part: Column) -> Column:
        grown = F.concat(state["open"], F.lit(joiner), part)
        fits = F.length(grown) <= limit
        return F.struct(
            F.when(state["open"].isNull() | fits, state["done"]).otherwise(F.array_append(state["done"], state["open"])).alias("done"),
            F.when(state["open"].isNull(), part).when(fits, grown).otherwise(part).alias("open"),
        )

    return F.aggregate(parts, start, add, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def sentences(c: Column) -> Column:
    """Breaks at line ends and after . ! or ? with a space."""
    return F.filter(F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\n"), r"\n+"), lambda s: F.trim(s) != "")


def newline_slices(df: DataFrame, key: list[str], text: str, size: int) -> DataFrame:
    """(key, part, body): pieces of at most size characters, cut after the last line end of a piece's second half, else at size."""

    def cut(s: pd.Series) -> pd.Series:
        out = []
        for body in s:
            pieces, start = [], 0
            while body and start < len(body):
                end = start + size
                if end < len(body):
                    at = body.rfind("\n", start + size // 2, end)
                    end = at + 1 if at >= 0 else end
                pieces.append(body[start:end])
                start = end
            out.append(pieces)
        return pd.Series(out)

    pieces = F.pandas_udf(cut, ArrayType(StringType()))
    return df.select(*key, F.posexplode(pieces(text)).alias("part", "body"))
