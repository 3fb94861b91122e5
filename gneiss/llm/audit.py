"""Operator 13, audit of how filters interact.

Each row has a flag for each filter that it fails. Rows are counted by flags and part; a cube over the flags and the
part then has, for each subset of filters, the row in which all flags of the subset are false: the subset's survivors.
A step of an order of filters goes from one subset to the next, so it is a join of two survivor counts; nothing after
the first count depends on the number of rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm.common import hot_join, table, text_or_empty, written

FILTERS = "ABCDE"
#: A: least words; B: least distinct words in 100; C: most capitals in 100 code points; D: characters not to be in a text.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 200, 50, 3, "#$%&*|"
#: Filters whose orders are still listed (720 orders).
MOST_FILTERS = 6
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions A to D under which a text fails."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, _CAPITALS, ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
        "C": 100 * capitals > MAX_CAPITALS * F.length(text),
        "D": text.rlike(f"[{SYMBOLS}]"),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For every row of docs(doc_id, text, lang): part, flags A to E, and good and toxic as labels(doc_id, quality,
    toxic) say (of repeated labels any 1 counts; none: 0).

    E: the text is that of a row with a smaller doc_id, wherever in the table; rows that share the smallest doc_id are
    no copies of each other, rows without a doc_id are copies of none and make none. Null texts are empty ones, a null
    lang the part "". Texts are read whole, other columns ignored; an empty table gives no rows. Result: a written table.
    """
    text = text_or_empty()
    flags = [c.alias(n) for n, c in text_failures(text).items()]
    slim = written(docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("hash"), *flags), "audit-rows")
    copies = written(slim.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n > 1"), "audit-copies")
    marked = hot_join(slim, copies, ["hash"], "n", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("hash", "first")
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    return marked.join(known, "doc_id", "left").fillna(0, ["good", "toxic"])


def survivors(flagged: DataFrame, filters: str, weights: list[str]) -> DataFrame:
    """(part, subset, n, *weights): rows of a part, and sums of their weights, that pass every filter of a subset, whose
    filters are bits in the order of filters; one row for every part and subset, zeros included. part null: all rows."""
    names = list(filters)
    counted = flagged.groupBy(*names, "part").agg(F.count(F.lit(1)).alias("n"), *(F.sum(w).alias(w) for w in weights))
    chosen = [1 - F.grouping(x).cast("int") for x in names]
    subset = sum((c * (1 << i) for i, c in enumerate(chosen)), F.lit(0))
    cube = counted.cube(*names, "part").agg(F.sum("n").alias("n"), *(F.sum(w).alias(w) for w in weights), subset.alias("subset"), F.grouping("part").alias("whole"))
    passed = cube.filter(" AND ".join(f"({x} IS NULL OR NOT {x})" for x in names)).select("part", "subset", "whole", "n", *weights)
    found = written(passed, "survivors")
    every = found.filter("subset = 0").select("part", "whole", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))).alias("subset"))
    same = [F.col("e.part").eqNullSafe(F.col("f.part")), F.col("e.whole") == F.col("f.whole"), F.col("e.subset") == F.col("f.subset")]
    return every.alias("e").join(found.alias("f"), same, "left").select("e.part", "e.subset", *(F.coalesce(F.col(f"f.{c}"), F.lit(0)).alias(c) for c in ("n", *weights)))


def steps(spark: SparkSession, filters: str) -> DataFrame:
    """filter_order, step, and the subsets before and after it, of its filter alone, of all others, and of all."""
    rows, whole = [], (1 << len(filters)) - 1
    for order in permutations(filters):
        before = 0
        for k, x in enumerate(order, 1):
            bit = 1 << filters.index(x)
            rows.append(("".join(order), k, before, before | bit, bit, whole ^ bit, whole))
            before |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, before int, after int, own int, others int, whole int")


def audit(flagged: DataFrame, filters: str = FILTERS, weights: dict[str, str] | None = None, total: bool = False) -> DataFrame:
    """One row for every part, order of filters and step: kept, removed, redundant (fails the step's filter, removed
    earlier), unique_fails (fails it only), one lost count for each of weights (result name -> 0/1 column of flagged),
    and shapley (removed by the filter, summed over all orders, at any step).

    flagged has part and a boolean column for each letter of filters (null: passes). total adds the rows of all parts
    together, with part null. No rows give no parts.
    """
    if not 0 < len(filters) <= MOST_FILTERS or len(set(filters)) < len(filters):
        raise ValueError(f"filters must be 1 to {MOST_FILTERS} different letters")
    weights = weights or {}
    columns = list(weights.values())
    clean = flagged.select(F.coalesce("part", F.lit("")).alias("part"), *(F.coalesce(F.col(x), F.lit(False)).alias(x) for x in filters), *columns)
    counts = written(survivors(clean, filters, columns), "subsets")
    counts = counts if total else counts.filter("part IS NOT NULL")
    # Orders of a few filters: at most 720 * 6 rows, whatever the input.
    found = F.broadcast(steps(flagged.sparkSession, filters)).withColumn("none", F.lit(0))
    for name in ("before", "none", "after", "own", "others", "whole"):
        side = counts.select(F.col("part").alias("p"), F.col("subset").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("n", *columns)))
        if name == "before":
            found = found.join(side, name).withColumnRenamed("p", "part")
        else:
            found = found.join(side, [found[name] == side[name], found["part"].eqNullSafe(side["p"])]).drop(side[name]).drop("p")
    removed = F.col("before_n") - F.col("after_n")
    result = found.select(
        "part", "filter_order", "step", "own", F.col("after_n").alias("kept"), removed.alias("removed"), (F.col("none_n") - F.col("own_n") - removed).alias("redundant"),
        (F.col("others_n") - F.col("whole_n")).alias("unique_fails"), *((F.col(f"before_{c}") - F.col(f"after_{c}")).alias(name) for name, c in weights.items()),
    )
    return result.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """audit of the filters A to E over all documents by lang, with labelled losses; edge cases as in failures."""
    flagged = failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(flagged, FILTERS, {"good_lost": "good", "toxic_lost": "toxic"})
