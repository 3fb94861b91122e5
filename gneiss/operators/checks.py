"""Checks that give problems as rows: answers, extractions, footnotes, misses of a gold standard, replayed responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.packing import running
from gneiss.shared import written


def plain_range(c: Column) -> Column:
    """A range as text without blanks, its signs written plainly."""
    c = F.regexp_replace(c, r"\s+", "")
    for a, b in (("＜", "<"), ("＞", ">"), ("≥", ">="), ("≤", "<=")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def answer_problems(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """(key, kind, fact, missing) for answers(key, answer, sources) and facts(key, fact, patterns, range).

    missing_citations: no number in brackets; invalid_citation: a number that no source has; missing_condition: a fact
    of which a pattern does not match the answer, or whose range (null: none) is not in it; missing lists them.
    """
    numbers = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("long"))
    said = answers.select("key", "answer", "sources", numbers.alias("n"))
    none = F.array().cast("array<string>")
    cited = said.select("key", F.explode(F.array_compact(F.array(F.when(F.size("n") == 0, "missing_citations"), F.when(F.exists("n", lambda i: (i < 1) | (i > F.col("sources"))), "invalid_citation")))).alias("kind"))
    lacks = F.filter("patterns", lambda p: ~F.regexp_like("answer", F.concat(F.lit("(?i)"), p)))
    range_ = F.when(F.col("range").isNotNull() & ~F.contains(plain_range(F.col("answer")), plain_range(F.col("range"))), F.array(F.concat(F.lit("range "), "range"))).otherwise(none)
    told = facts.join(said, "key").select("key", F.lit("missing_condition").alias("kind"), "fact", F.concat(lacks, range_).alias("missing")).filter(F.size("missing") > 0)
    return cited.select("key", "kind", F.lit(None).cast(dict(facts.dtypes)["fact"]).alias("fact"), none.alias("missing")).unionByName(told)


def extraction_problems(chunks: DataFrame, entities: DataFrame, relations: DataFrame, places: list[str]) -> DataFrame:
    """(chunk, problem, key) of entities(chunk, key, surface) and relations(chunk, key, subject, predicate, object, quote)
    against chunks(chunk, text): a key that comes twice, a surface or quote that the text lacks, an end that is no
    entity, and a relation of a place whose quote does not name its object. Blanks and case do not matter for quotes."""
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    text = chunks.select("chunk", flat(F.col("text")).alias("_text"))
    twice = entities.groupBy("chunk", "key").count().filter("count > 1").select("chunk", F.lit("repeated key").alias("problem"), "key")
    lost = entities.join(text, "chunk").filter(~F.contains("_text", flat(F.col("surface")))).select("chunk", F.lit("surface not in text").alias("problem"), "key")
    unquoted = relations.join(text, "chunk").filter(~F.contains("_text", flat(F.col("quote")))).select("chunk", F.lit("quote not in text").alias("problem"), "key")
    known = entities.groupBy("chunk", F.col("key").alias("_key")).agg(F.first("surface").alias("_surface"))
    ends = relations.select("chunk", "key", F.explode(F.array("subject", "object")).alias("_key"))
    loose = ends.join(known, ["chunk", "_key"], "left_anti").select("chunk", F.lit("unknown end").alias("problem"), "key").distinct()
    placed = relations.filter(F.col("predicate").isin(places)).join(known, (relations["chunk"] == known["chunk"]) & (F.col("object") == F.col("_key"))).filter(~F.contains(flat(F.col("quote")), flat(F.col("_surface"))))
    unnamed = placed.select(relations["chunk"], F.lit("place not in quote").alias("problem"), "key")
    return reduce(DataFrame.unionByName, [twice, lost, unquoted, loose, unnamed])


def bound_footnotes(parameters: DataFrame, reach: int = 3) -> DataFrame:
    """(doc, place, owner, note, binding) of parameters(doc, place, section, value, notes): a parameter has its own notes,
    and those of a parameter of its section at most `reach` places further on whose marker (*, †, ‡ or a number in
    brackets) its value holds. An equality on document, section and place."""
    marker = F.regexp_extract("note", r"^\s*([*†‡]+|\[\d+\])", 1)
    notes = parameters.select("doc", F.col("place").alias("owner"), "section", F.explode("notes").alias("note")).withColumn("marker", marker)
    own = notes.select("doc", F.col("owner").alias("place"), "owner", "note", F.lit("own").alias("binding"))
    near = notes.filter("marker <> ''").withColumn("place", F.explode(F.sequence(F.col("owner") - reach, F.col("owner") - 1)))
    shared = near.join(parameters.select("doc", "place", "section", "value"), ["doc", "place", "section"]).filter(F.contains("value", F.col("marker")))
    return own.unionByName(shared.select("doc", "place", "owner", "note", F.lit("shared marker").alias("binding")))


def misses(gold: DataFrame, predicted: DataFrame, refused: DataFrame) -> DataFrame:
    """(case, gold, predicted, category) of what predicted(case, id, name, type, owner, mention) and gold (the same) do not
    share: "type" for the same name under another type, "owner" for the same mention under another owner if the only
    one, "selection" for a gold name that refused(case, name) holds, "review" for the rest of both sides.

    Names are compared folded; each row is paired once, with the least id.
    """
    low = lambda c: F.lower(F.trim(c))
    fold = lambda df: df.select("case", "id", low(F.col("name")).alias("name"), "type", "owner", low(F.col("mention")).alias("mention"))
    g, p = fold(gold), fold(predicted)
    exact = ["case", "name", "type"]
    number = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(*exact).orderBy("id")))
    left = written(number(g).join(number(p).select(*exact, "_n"), [*exact, "_n"], "left_anti").drop("_n"), "missed")
    extra = written(number(p).join(number(g).select(*exact, "_n"), [*exact, "_n"], "left_anti").drop("_n"), "extra")

    def pairs(a: DataFrame, b: DataFrame, key: list[str], category: str, other: str, alone: bool) -> DataFrame:
        x = a.select("case", *key, F.col("id").alias("gold"), F.col(other).alias("_x"))
        y = b.select("case", *key, F.col("id").alias("predicted"), F.col(other).alias("_y"))
        met = x.join(y, ["case", *key]).filter(F.col("_x") != F.col("_y"))
        if alone:
            met = met.withColumn("_options", F.count("*").over(Window.partitionBy("case", "gold"))).filter("_options = 1")
        met = met.withColumn("_i", F.row_number().over(Window.partitionBy("case", "gold").orderBy("predicted"))).filter("_i = 1")
        met = met.withColumn("_j", F.row_number().over(Window.partitionBy("case", "predicted").orderBy("gold"))).filter("_j = 1")
        return written(met.select("case", "gold", "predicted", F.lit(category).alias("category")), category)

    typed = pairs(left, extra, ["name"], "type", "type", False)
    less = lambda df, found, side: df.join(found.select("case", F.col(side).alias("id")), ["case", "id"], "left_anti")
    left1, extra1 = less(left, typed, "gold"), less(extra, typed, "predicted")
    owned = pairs(left1.filter("owner IS NOT NULL"), extra1.filter("owner IS NOT NULL"), ["mention"], "owner", "owner", True)
    left2, extra2 = less(left1, owned, "gold"), less(extra1, owned, "predicted")
    no = refused.select("case", low(F.col("name")).alias("name"), F.lit(1).alias("_no")).distinct()
    rest = left2.join(no, ["case", "name"], "left").select("case", F.col("id").alias("gold"), F.lit(None).cast(dict(predicted.dtypes)["id"]).alias("predicted"), F.when(F.col("_no") == 1, "selection").otherwise("review").alias("category"))
    more = extra2.select("case", F.lit(None).cast(dict(gold.dtypes)["id"]).alias("gold"), F.col("id").alias("predicted"), F.lit("review").alias("category"))
    return reduce(DataFrame.unionByName, [typed, owned, rest, more])


def replayed(cache: DataFrame, requests: DataFrame, compute) -> tuple[DataFrame, DataFrame]:
    """(id, response, replayed) of requests(id, body), and the cache(key, response, digest) after them.

    A request's key is the digest of its body. A cached response counts if its digest is its own; a damaged one is
    dropped and computed anew, as is what the cache lacks: once for each body, for the request of the least id, the
    others replay it. compute is a function from a Column of bodies to one of responses.
    """
    asked = requests.withColumn("key", F.sha2("body", 256))
    good = cache.filter(F.sha2("response", 256) == F.col("digest")).select("key", F.col("response").alias("_had"))
    first = asked.groupBy("key").agg(F.min("id").alias("_first"), F.first("body").alias("body"))
    missing = first.join(good, "key", "left_anti")
    fresh = written(missing.select("key", "_first", compute(F.col("body")).alias("response")), "responses")
    known = good.select("key", F.col("_had").alias("response"), F.lit(None).cast(dict(requests.dtypes)["id"]).alias("_first")).unionByName(fresh.select("key", "response", "_first"))
    out = asked.join(known, "key").select("id", "response", F.coalesce(F.col("id") != F.col("_first"), F.lit(True)).alias("replayed"))
    kept = good.select("key", F.col("_had").alias("response")).unionByName(fresh.select("key", "response"))
    return out, kept.select("key", "response", F.sha2("response", 256).alias("digest"))


def ingested(candidates: DataFrame, existing: DataFrame, target: int, most_pages: int) -> DataFrame:
    """(search, page, place, url, outcome) of the candidates(search, page, place, url, works) that a run of each search
    meets: pages in order, most_pages at most, until `target` of them succeeded.

    A URL that existing(url) has, or that the search met before, is a duplicate and counts for nothing; what does not
    work has failed. A page is asked for only while the target is not reached, and left once it is.
    """
    order = [F.col("page"), F.col("place")]
    some = candidates.filter(F.col("page") < most_pages).join(existing.select("url", F.lit(1).alias("_old")).distinct(), "url", "left")
    nth = F.row_number().over(Window.partitionBy("search", "url").orderBy(*order))
    judged = some.withColumn("outcome", F.when(F.col("_old").isNotNull() | (nth > 1), "duplicate").when(F.col("works"), "success").otherwise("failed"))
    counted = running(judged.withColumn("_won", (F.col("outcome") == "success").cast("long")), ["search"], order, _sum=("sum", "_won"))
    return counted.filter(F.col("_sum") - F.col("_won") < target).select("search", "page", "place", "url", "outcome")
