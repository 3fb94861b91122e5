"""Counts, rates, merges and reconciliation by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b)


def f1_by_scopes(df: DataFrame, scopes: list[str], tp: str, fp: str, fn: str) -> DataFrame:
    """Micro precision, recall and F1 over everything ("all") and by each scope column, in one pass."""
    sets = F.explode(F.array(F.struct(F.lit("all").alias("scope"), F.lit("").alias("value")), *(F.struct(F.lit(s).alias("scope"), F.col(s).cast("string").alias("value")) for s in scopes)))
    g = df.withColumn("_s", sets).groupBy("_s.scope", "_s.value").agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"))
    return g.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def voted(df: DataFrame, key: Column, variant: str, kind: str) -> DataFrame:
    """Per key: the variant most often seen (then with a capital, longer, first in order) and the commonest kind."""
    v = df.groupBy(key.alias("key"), variant).agg(F.count("*").alias("n"))
    best = v.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("a"), (~F.col(variant).rlike("[A-Z]")).alias("b"), (-F.length(variant)).alias("c"), F.col(variant).alias("d"))).alias("_b"), F.sum("n").alias("n"))
    k = df.groupBy(key.alias("key"), kind).agg(F.count("*").alias("m")).groupBy("key").agg(F.min(F.struct((-F.col("m")).alias("a"), F.col(kind).alias("b"))).alias("_k"))
    return best.join(k, "key").select("key", F.col("_b.d").alias("display"), F.col("_k.b").alias("kind"), "n")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with their surplus in a (positive) or b (negative); none if both hold the same rows as often.

    One aggregation of the signed rows; nothing is joined.
    """
    both = a.withColumn("_w", F.lit(1)).unionByName(b.withColumn("_w", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("_w").alias("surplus")).filter("surplus <> 0")


def shares(df: DataFrame, key: list[str], value: Column, name: str) -> DataFrame:
    """Sum of value by key and its part of the whole."""
    g = df.groupBy(*key).agg(F.sum(value).alias(name))
    return g.withColumn("share", ratio(F.col(name), F.sum(name).over(Window.partitionBy())))
