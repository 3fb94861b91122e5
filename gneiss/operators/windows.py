"""Ranking, diversification, running budgets and neighbours by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.packing import timed_groups
from gneiss.shared import written


def first_per(df: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def round_robin(df: DataFrame, key: list[str], order: list[Column], limit: int) -> DataFrame:
    """Best row of each key, then second rows, and so on, up to limit: pass and rank of the rows kept."""
    passes = df.withColumn("pass", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    kept = passes.filter(F.col("pass") <= limit).orderBy("pass", *order).limit(limit)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy("pass", *order)))


def running_offset(df: DataFrame, key: list[str], order: list[str], length: Column, name: str) -> DataFrame:
    """Sum of the lengths before each row of its key."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long"))


def within_budget(df: DataFrame, key: list[str], order: list[Column], cost: Column, budget: float) -> DataFrame:
    """Rows of each key in order as long as their costs sum to no more than the budget."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w)).filter(F.col("spent") <= budget)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the place of each row in the order of all rows, from 1, without one task that sorts them all: range
    partitions are ranked each, and the numbers of rows before them (a row a partition) added."""
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_nth", local).join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")


def interleaved(a: DataFrame, b: DataFrame, id_: str, order: list[Column]) -> DataFrame:
    """Ids of two ranked lists in turn, first list first; an id that both hold keeps its first place."""
    listed = lambda df, side: ranked(df, order, "_i").select(id_, "_i", F.lit(side).alias("_side"))
    both = listed(a, 0).unionByName(listed(b, 1))
    first = both.groupBy(id_).agg(F.min(F.struct("_i", "_side")).alias("_p")).select(id_, "_p._i", "_p._side")
    return ranked(first, [F.col("_i"), F.col("_side")], "place").select(id_, "place")


def around(df: DataFrame, key: list[str], order: list[str], text: str, n: int = 500) -> DataFrame:
    """The beginnings of the texts before and after each row, joined by a newline."""
    w = Window.partitionBy(*key).orderBy(*order)
    part = lambda c: F.substring(c, 1, n)
    return df.withColumn("context", F.concat_ws("\n", part(F.lag(text).over(w)), part(F.lead(text).over(w))))


def bounded_groups(df: DataFrame, key: list[str], start: str, end: str, text: str, most_chars: int, most_span: float) -> DataFrame:
    """Consecutive timed segments of a key in groups: a new one begins where text or time would grow too long."""
    return timed_groups(df, key, start, end, text, most_chars, most_span)
