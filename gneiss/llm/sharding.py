"""Operator 9, sharding by sampled splitters, with DataFrame functions only.

A size-weighted sample of the keys gives splitters at equal quantiles of the bytes; records are range-partitioned by
them; ranges that come out overfull are subdivided. Exact sums of the ranges then turn a running sum within each range
into a running sum over the whole order, and a record's place in it into its shard and slot.

The key is the text's hash, so equal texts are neighbours. Groups of equal texts that are large against a shard (a few
dozen a shard at most) get a shard of their own choice first, whole; the others run past them into what room is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm.common import cut, table, text_or_empty

SHARDS = 40
#: Bytes that a record counts besides its text.
OVERHEAD = 16
#: Ranges for each shard, and the rows after which there are more ranges.
RANGES_PER_SHARD, ROWS_PER_RANGE = 8, 1_000_000
#: Sampled keys for each range.
SAMPLES_PER_RANGE = 64
#: A range of more than this many times the mean rows is subdivided.
OVERFULL = 4
#: Groups of equal texts of more than this part of a shard are placed before all else (there are fewer than shards by it).
WHOLE_GROUP = 0.02


def _splitters(keyed: DataFrame, total: int, ranges: int) -> DataFrame:
    """(bucket, below, inside): quantile boundaries of a sample in which a record's chance follows its size, by the
    leading bits of the key, with the number of boundaries below the bucket. Its rows follow the number of ranges."""
    chance = F.col("size") * F.lit(float(ranges * SAMPLES_PER_RANGE) / max(total, 1))
    drawn = F.pmod(F.xxhash64("key", "doc_id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    placed = keyed.filter(drawn < chance).select("key", F.row_number().over(Window.orderBy("key")).alias("nth"))
    bounds = placed.filter(F.col("nth") % SAMPLES_PER_RANGE == 0).select("key").distinct()
    bits = _bits(ranges)
    inside = bounds.groupBy(F.shiftright("key", 64 - bits).alias("bucket")).agg(F.sort_array(F.collect_list("key")).alias("inside"))
    every = keyed.sparkSession.range(-(1 << (bits - 1)), 1 << (bits - 1)).select(F.col("id").alias("bucket"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    full = every.join(inside, "bucket", "left").withColumn("inside", F.coalesce("inside", F.array().cast("array<bigint>")))
    return full.withColumn("below", F.coalesce(F.sum(F.size("inside")).over(before), F.lit(0)))


def _bits(ranges: int) -> int:
    return max(1, (4 * ranges).bit_length())


def _homes(sizes: list[tuple[int, int]], shards: int, total: int) -> tuple[dict[int, int], list[float]]:
    """Shards for groups (key, bytes), largest first, each to where there is most room; a group that no shard has room
    for gets none. And the room that is left in each shard."""
    room = [total / shards] * shards
    homes = {}
    for key, size in sorted(sizes, key=lambda g: (-g[1], g[0])):
        best = max(range(shards), key=lambda s: (room[s], -s))
        if room[best] >= size:
            homes[key] = best
            room[best] -= size
    return homes, room


def _marks(spark: SparkSession, keys: list[int], homes: dict[int, int]) -> DataFrame:
    """(key, home, split) of the large groups."""
    long = lambda k: f"{k}L" if k != -(1 << 63) else "(-9223372036854775807L - 1L)"
    rows = ", ".join(f"({long(k)}, {homes.get(k, 'NULL')}, {str(k not in homes).lower()})" for k in keys)
    return spark.sql(f"SELECT key, CAST(home AS INT) AS home, split FROM VALUES {rows or '(0L, 0, false)'} AS t(key, home, split){'' if keys else ' WHERE false'}")


def shard_by_size(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Deals every row of docs(doc_id, text) into `shards` shards of near equal bytes.

    Result: doc_id, size, text_crc32, law, shard, slot, grown_shard, group_split. Rows go in the order (hash of the
    text, doc_id), so copies lie together. A group of equal texts lies in one shard as long as a shard has room for it;
    only the rows of a group that none has room for (group_split) may lie in several. Null and empty texts count as "",
    a null doc_id as a row like any other, repeated rows keep a slot each, an empty table gives no rows; other columns
    are ignored. Shards hold the same bytes up to a record, or a group of WHOLE_GROUP of a shard, at each end.
    """
    text = text_or_empty()
    keyed = cut(docs.select(F.col("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")))
    whole = keyed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    total = max(whole["b"], 1)
    ranges = max(RANGES_PER_SHARD * shards, -(-whole["n"] // ROWS_PER_RANGE))
    # Fewer than shards / WHOLE_GROUP groups, whatever the input.
    groups = keyed.groupBy("key").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).filter((F.col("b") > int(WHOLE_GROUP * total / shards)) & (F.col("n") > 1))
    wide = {r["key"]: r["b"] for r in groups.select("key", "b").collect()}
    homes, room = _homes(list(wide.items()), shards, total)
    marked = keyed.join(F.broadcast(_marks(docs.sparkSession, list(wide), homes)), "key", "left").withColumn("split", F.coalesce("split", F.lit(False)))
    lookup = F.broadcast(_splitters(keyed, total, ranges))
    ranged = marked.withColumn("bucket", F.shiftright("key", 64 - _bits(ranges))).join(lookup, "bucket").withColumn("range", F.col("below") + F.size(F.filter("inside", lambda x: x <= F.col("key"))))
    # A group with a home is a range of its own. An overfull range is subdivided by key, so that equal texts stay
    # together; rows of a group that may or need not be together in the order are dealt by doc_id.
    ranged = ranged.withColumn("range", F.when(F.col("home").isNull(), F.col("range").cast("string")).otherwise(F.concat(F.lit("g"), "key")))
    most = max(1.0, OVERFULL * whole["n"] / ranges)
    parts = ranged.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).alias("parts"))
    dealt_by = F.when(F.col("split") | F.col("home").isNotNull(), F.xxhash64("doc_id", F.lit(11))).otherwise(F.xxhash64("key", F.lit(11)))
    ranged = ranged.join(F.broadcast(parts), "range").withColumn("part", F.pmod(dealt_by, F.col("parts"))).drop("bucket", "below", "inside", "parts")
    before = Window.partitionBy("home").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = ranged.groupBy("range", "part", "home").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).select("range", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"))
    cell = Window.partitionBy("range", "part")
    order = cell.orderBy("key", "doc_id", "size", "text_crc32")
    placed = (
        ranged.join(F.broadcast(cells), ["range", "part"])
        .withColumn("rank", F.col("rows_before") + F.row_number().over(order) - 1)
        .withColumn("end", F.col("bytes_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("group_end", F.col("bytes_before") + F.sum("size").over(cell.orderBy("key").rangeBetween(Window.unboundedPreceding, 0)))
        .withColumn("group_size", F.sum("size").over(Window.partitionBy("range", "part", "key")))
    )
    middle = F.when(~F.col("split"), F.col("group_end") - F.col("group_size") / 2).otherwise(F.col("end") - F.col("size") / 2)
    ends, at = [], 0.0
    for r in room[:-1]:
        at += r
        ends.append(at)
    run_on = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= middle)) if ends else F.lit(0)
    placed = placed.withColumn("shard", F.coalesce("home", run_on).cast("int"))
    first = placed.filter("home IS NULL").groupBy("shard").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("run_on"))
    # Rows that run on come first in their shard, in order; then those of groups that are at home there.
    slot = F.when(F.col("home").isNull(), F.col("rank") - F.col("first")).otherwise(F.col("rank") + F.coalesce("run_on", F.lit(0)))
    return placed.join(F.broadcast(first), "shard", "left").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("split").alias("group_split")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard_by_size of all documents; edge cases as there."""
    return shard_by_size(table(spark, sf_dir, "documents"))
