"""Joins beyond plain equality: top-1 per row, bands, intervals, quotes, as-of, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.shared import written


def top_one(left: DataFrame, right: DataFrame, on: str, order: list[Column], columns: list[str]) -> DataFrame:
    """left with columns of the first row of right in order, null where there is none (a lateral join with limit 1)."""
    w = Window.partitionBy(on).orderBy(*order)
    best = right.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(on, *columns)
    return left.join(best, on, "left")


def neighbours(hits: DataFrame, rows: DataFrame, key: str, place: str, reach: int = 1) -> DataFrame:
    """Rows at most `reach` places from a hit with the same key, each once. An equality on each place near the hit."""
    near = hits.select(key, F.explode(F.sequence(F.col(place) - reach, F.col(place) + reach)).alias(place)).distinct()
    return rows.join(near, [key, place], "left_semi")


def overlapping(a: DataFrame, b: DataFrame, key: str, a_span: tuple[str, str], b_span: tuple[str, str], cell: float) -> DataFrame:
    """Pairs of one key whose half-open spans overlap, with the common part (lo, hi).

    Both sides are listed under the cells of width `cell` that they touch, which makes an equality of the range
    predicate; a pair is kept in the cell where its common part begins. cell should be about a usual span's length.
    """
    touched = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.greatest(F.floor(F.col(lo) / cell), F.ceil(F.col(hi) / cell) - 1)))
    x, y = a.withColumn("_cell", touched(*a_span)), b.withColumn("_cell", touched(*b_span))
    lo, hi = F.greatest(a_span[0], b_span[0]), F.least(a_span[1], b_span[1])
    return x.join(y, [key, "_cell"]).filter((F.col(a_span[0]) < F.col(b_span[1])) & (F.col(b_span[0]) < F.col(a_span[1])) & (F.floor(lo / cell) == F.col("_cell"))).withColumn("lo", lo).withColumn("hi", hi).drop("_cell")


def _inner_words(c: Column) -> Column:
    """Hash of the second to fifth word of a quote: whole words of any text that holds it."""
    return F.xxhash64(F.array_join(F.slice(F.split(c, r"\s+"), 2, 4), " "))


#: Quotes of under three words that are looked for in one pass over the texts.
SHORT_BLOCK = 500


def quoted_in(docs: DataFrame, text: str, quotes: DataFrame, quote: str) -> DataFrame:
    """Pairs of rows where the text holds the quote.

    A quote's inner words are whole words of a text that holds it. Quotes of six words and more meet texts by a hash of
    four of them, those of three to five by one; texts list hashes only, without the text, and only what meets is
    fetched and compared. Quotes of one or two words are a set that is looked for in blocks, a pass for each.
    """
    size = F.size(F.split(quote, r"\s+"))
    w, then = F.split(text, r"\s+"), lambda a, b: F.concat(a, F.lit(" "), b)
    four = w
    for i in (2, 3, 4):
        four = F.zip_with(four, F.slice(w, i, F.greatest(F.size(w), F.lit(1))), then)
    row = docs.withColumns({"_r1": F.xxhash64(*docs.columns), "_r2": F.xxhash64(F.lit(1), *docs.columns)})
    held = F.col(text).contains(F.col(quote))

    def met(some: DataFrame, hashes: Column, key: Column) -> DataFrame:
        named = some.withColumn("_key", key)
        listed = row.select("_r1", "_r2", F.explode(F.array_distinct(F.transform(F.filter(hashes, lambda x: x.isNotNull()), lambda x: F.xxhash64(x)))).alias("_key"))
        near = listed.join(named.select("_key").distinct(), "_key", "left_semi").distinct()
        return row.join(near, ["_r1", "_r2"]).join(named, "_key").filter(held).drop("_key", "_r1", "_r2")

    out = met(quotes.filter(size >= 6), four, _inner_words(F.col(quote))).unionByName(met(quotes.filter((size >= 3) & (size < 6)), w, F.xxhash64(F.element_at(F.split(quote, r"\s+"), 2))))
    short, block = quotes.filter(size < 3), []
    for x in [r[0] for r in short.select(quote).distinct().toLocalIterator()]:
        block.append(x)
        if len(block) == SHORT_BLOCK:
            out, block = out.unionByName(_each_in(docs, text, short, quote, block)), []
    return out.unionByName(_each_in(docs, text, short, quote, block)) if block else out


def _each_in(docs: DataFrame, text: str, quotes: DataFrame, quote: str, block: list[str]) -> DataFrame:
    found = docs.withColumn(quote, F.explode(F.filter(F.array(*map(F.lit, block)), lambda x: F.contains(F.col(text), x))))
    return found.join(quotes, quote).select(*docs.columns, *quotes.columns)


def carried(df: DataFrame, key: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null value at or before each row of its key (as-of, carried forward)."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, columns: list[str]) -> DataFrame:
    """left with columns of the latest right row of its key at or before it: both sides in one order, values carried."""
    l = left.select(key, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(_struct(right, columns)).alias("_r"))  # noqa: E741
    r = right.select(key, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(_struct(left, left.columns)).alias("_l"), F.struct(*columns).alias("_r"))
    both = carried(l.unionByName(r), [key], ["_at", "_side"], F.col("_r"), "_now")
    return both.filter("_side = 1").select("_l.*", *(F.col(f"_now.{c}").alias(c) for c in columns))


def _struct(df: DataFrame, columns: list[str]) -> str:
    kinds = dict(df.dtypes)
    return f"struct<{','.join(f'`{c}`:{kinds[c]}' for c in columns)}>"


def without_covered(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Spans that lie in no longer span of their key: in order of start, a span is covered if one before it ends as late."""
    w = Window.partitionBy(key).orderBy(F.col(start), F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max(end).over(w)).filter(F.col("_reach").isNull() | (F.col("_reach") < F.col(end))).drop("_reach")


def differing_pairs(df: DataFrame, key: list[str], id_: str, value: str) -> DataFrame:
    """Pairs (a, b) of ids of one key, a before b, whose values differ. Values are collected first: equal ones never pair."""
    x = df.groupBy(*key, F.col(value)).agg(F.min(id_).alias("_id"))
    a, b = x.select(*key, F.col("_id").alias("a"), F.col(value).alias("value_a")), x.select(*key, F.col("_id").alias("b"), F.col(value).alias("value_b"))
    return a.join(b, key).filter("a < b")


def named_in(texts: DataFrame, id_: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """Pairs (id, name) where the text names the name: its words stand there one after the other, whatever case and marks.

    A name meets the texts that hold its longest word, which is an equality; only what meets is compared. A name
    without letters or digits is never named.
    """
    word = lambda c: F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != "")
    asked = texts.select(id_, word(F.col(text)).alias("_t"))
    known = names.select(name).distinct().withColumn("_n", word(F.col(name))).filter(F.size("_n") > 0)
    longest = F.array_sort(F.transform("_n", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))[0]["w"]
    held = asked.select(id_, F.explode(F.array_distinct("_t")).alias("_w"), F.concat(F.lit(" "), F.array_join("_t", " "), F.lit(" ")).alias("_text"))
    met = held.join(known.withColumn("_w", longest), "_w")
    return met.filter(F.contains("_text", F.concat(F.lit(" "), F.array_join("_n", " "), F.lit(" ")))).select(id_, name).distinct()


def nearest_later(rows: DataFrame, key: str, id_: str, value: str, n: int) -> DataFrame:
    """(a, b, apart, place): for each row a the n rows b of its key with a greater id whose values are nearest, ties by id.

    Rows of a key lie in order of value; each looks at so many places to either side, and those that cannot be sure of
    their n nearest yet at twice as many, up to the whole key. So pairs are listed near each other only.
    """
    order = Window.partitionBy(key).orderBy(value, id_)
    placed = written(rows.select(key, id_, F.col(value).cast("double").alias("_v"), F.row_number().over(order).alias("_p"), F.count("*").over(Window.partitionBy(key)).alias("_n")), "placed")
    other = placed.select(key, F.col(id_).alias("b"), F.col("_v").alias("_w"), F.col("_p").alias("_q"))
    open_, done, reach = placed, None, 2 * n
    while True:
        near = open_.withColumn("_q", F.explode(F.sequence(F.greatest(F.col("_p") - reach, F.lit(1)), F.least(F.col("_p") + reach, F.col("_n")))))
        met = near.join(other, [key, "_q"]).withColumn("apart", F.abs(F.col("_v") - F.col("_w")))
        # Beyond the places that were looked at nothing is nearer than the farther end of either side that has one.
        edge = F.least(F.when(F.col("_p") - reach > 1, F.max(F.when(F.col("_q") == F.col("_p") - reach, F.col("apart"))).over(Window.partitionBy(key, id_))), F.when(F.col("_p") + reach < F.col("_n"), F.max(F.when(F.col("_q") == F.col("_p") + reach, F.col("apart"))).over(Window.partitionBy(key, id_))))
        later = met.withColumn("_edge", edge).withColumn("_later", F.col("b") > F.col(id_))
        place = F.row_number().over(Window.partitionBy(key, id_).orderBy(F.desc("_later"), "apart", "b"))
        best = written(later.withColumn("place", place).filter(F.col("place") <= n), "near")
        # A tie with the edge could still be beaten by a lesser id beyond it.
        sure = best.groupBy(key, F.col(id_).alias("_a")).agg(F.max("_edge").alias("_edge"), F.count_if("_later").alias("_found"), F.max(F.when(F.col("_later"), F.col("apart"))).alias("_far"))
        ended = sure.filter(F.col("_edge").isNull() | ((F.col("_found") == n) & (F.col("_far") < F.col("_edge")))).select(key, F.col("_a").alias(id_))
        found = best.filter("_later").join(ended, [key, id_], "left_semi").select(F.col(id_).alias("a"), "b", "apart", "place")
        done = found if done is None else done.unionByName(found)
        open_ = written(open_.join(ended, [key, id_], "left_anti"), "open")
        if open_.isEmpty():
            return done
        reach *= 2


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of boxes (x0, y0, x1, y1); 0 if neither has an area."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))
