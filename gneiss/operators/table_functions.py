"""Chunkers as table functions: called with a table and names of its columns, dealt by a key, one row a chunk."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, Row, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from gneiss.shared import ship


class ArticleChunks:
    """article_chunks(TABLE(..), key => 'id', text => 'text', title => 'title', size => 1200).

    Each row's title and lead (its first line that is not blank, cut at size) are chunk 0, then slices of size characters
    of what follows; a text without anything has one chunk "[empty]". The result's first column is the key, named and
    typed as in the table; rows come dealt by it.
    """

    def __init__(self):
        self.size = 1200

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, text: AnalyzeArgument, title: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument must be a table")
        fields = {f.name: f for f in table.dataType.fields}
        for a in (key, text, title):
            if not a.isConstantExpression or a.value not in fields:
                raise ValueError(f"the table has no column {a.value}")
        if not size.isConstantExpression or int(size.value) < 1:
            raise ValueError("size must be a whole number over 0")
        schema = StructType([fields[key.value]]).add("chunk_index", IntegerType()).add("body", StringType()).add("kind", StringType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(key.value)])

    def eval(self, table: Row, key: str, text: str, title: str, size: int) -> Iterator[tuple]:
        body, name, whose = table[text], table[title], table[key]
        if body is None:
            return
        start = len(body) - len(body.lstrip(" \t\n\x0b\x0c\r"))
        lead = body[start:].split("\n", 1)[0][:size]
        head = [f"Title: {name}"] if name is not None else []
        yield whose, 0, "\n".join([*head, f"Lead: {lead}"]) if lead else "[empty]", "title_lead"
        rest = body[start + len(lead) :]
        for i in range(0, len(rest), size):
            yield whose, i // size + 1, rest[i : i + size], "body"


def register(spark: SparkSession) -> None:
    """Makes the chunker known to SQL as article_chunks."""
    ship(spark)
    spark.udtf.register("article_chunks", udtf(ArticleChunks))


def article_chunks(df: DataFrame, key: str, text: str, title: str, size: int = 1200) -> DataFrame:
    """The table function over a DataFrame."""
    spark = df.sparkSession
    register(spark)
    return spark.sql("SELECT * FROM article_chunks({rows}, key => {key}, text => {text}, title => {title}, size => {size})".replace("{rows}", "TABLE({rows})"), rows=df.select(key, text, title), key=key, text=text, title=title, size=size)
