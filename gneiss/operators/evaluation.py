"""Predicted relations against gold ones: levels of agreement, totals by scope, and a report over several systems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What has to agree at each level, from the plainest to the fullest.
LEVELS = ["endpoint_pair", "triple", "assertion", "qualified"]


def _keys(symmetric: list[str]) -> dict[str, Column]:
    """The key of a relation at each level. Ends of a pair, and of a symmetric predicate, have no order."""
    ends = F.array_sort(F.array("subject", "object"))
    ordered = F.when(F.col("predicate").isin(symmetric), ends).otherwise(F.array("subject", "object")) if symmetric else F.array("subject", "object")
    triple = [ordered, F.col("predicate")]
    return {"endpoint_pair": F.to_json(F.struct(ends)), "triple": F.to_json(F.struct(*triple)), "assertion": F.to_json(F.struct(*triple, "assertion")), "qualified": F.to_json(F.struct(*triple, "assertion", "qualifiers"))}


def matches(gold: DataFrame, predicted: DataFrame, symmetric: list[str] = ()) -> DataFrame:
    """(system, case, level, predicate, tp, fp, fn) of predicted(system, case, subject, predicate, object, assertion,
    qualifiers) against gold (the same without system).

    Equal predictions of a case count once. At a level each gold relation matches at most one prediction with its key
    and the other way round; as agreement is equality of keys, the largest matching has the lesser number of each key.
    A prediction's misses count under its predicate, a gold one's under its own. Systems are those that predict
    anything; a case that a system has nothing for counts as missed.
    """
    keys = _keys(list(symmetric))
    relation = ["case", "subject", "predicate", "object", "assertion", "qualifiers"]
    systems = predicted.select("system").distinct()
    # Some systems against all gold relations: each system has to answer for each of them. Relations are dealt by case
    # once, before they have a key at each level: copies are found, and keys counted and compared, where they are.
    sides = predicted.select("system", *relation, F.lit(1).alias("p")).unionByName(gold.select(*relation, F.lit(0).alias("p")).join(F.broadcast(systems)))
    dealt = sides.repartition("case")
    same = dealt.groupBy("system", "case", "p", keys["qualified"].alias("_same")).agg(F.first(F.struct(*relation[1:])).alias("r"), F.count("*").alias("n")).select("system", "case", "p", "r.*", F.when(F.col("p") == 1, 1).otherwise(F.col("n")).alias("n"))
    listed = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), k.alias("key")) for n, k in keys.items()))).alias("k")
    side = lambda p, c: F.when(F.col("p") == p, F.col(c))
    both = same.select("system", "case", "predicate", "p", "n", listed).select("system", "case", "k.level", "k.key", "predicate", "p", "n").groupBy("system", "case", "level", "key").agg(
        F.coalesce(F.sum(side(1, "n")), F.lit(0)).alias("p"), F.coalesce(F.sum(side(0, "n")), F.lit(0)).alias("g"), F.min(side(1, "predicate")).alias("pp"), F.min(side(0, "predicate")).alias("gp")
    )
    tp = F.least("p", "g")
    return both.select("system", "case", "level", F.coalesce("gp", "pp").alias("predicate"), tp.alias("tp"), (F.col("p") - tp).alias("fp"), (F.col("g") - tp).alias("fn"))


def report(counts: DataFrame, cases: DataFrame) -> DataFrame:
    """(system, scope, name, level, tp, fp, fn, precision, recall, f1, place) of counts over all, by language of
    cases(case, language), and by predicate; place orders the systems of a scope by f1, then name. Ratios without a
    denominator are null and come last."""
    told = counts.join(cases.select("case", "language"), "case")
    scope = lambda s, c: told.groupBy("system", F.lit(s).alias("scope"), c.alias("name"), "level").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")))
    summed = reduce(DataFrame.unionByName, [scope("overall", F.lit("")), scope("language", F.col("language")), scope("predicate", F.col("predicate"))])
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    scored = summed.select("*", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("scope", "name", "level").orderBy(F.desc_nulls_last(F.round("f1", 9)), "system")))
