"""State against new input: reconciliation, change detection, upserts, watermarks by id, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile(expected: DataFrame, existing: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """key and action: new, stale (a compared column differs), same, obsolete (no longer expected; never deleted)."""
    e = expected.select(*key, F.struct(*compare).alias("_e"))
    x = existing.select(*key, F.struct(*compare).alias("_x"))
    action = F.when(F.col("_x").isNull(), "new").when(F.col("_e").isNull(), "obsolete").when(F.col("_e") == F.col("_x"), "same").otherwise("stale")
    return e.join(x, key, "full_outer").select(*key, action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], immutable: list[str] = ()) -> DataFrame:
    """old with rows of new put in by key; immutable columns keep their first value."""
    others = [c for c in old.columns if c not in key]
    a, b = old.select(*key, F.struct(*others).alias("_o")), new.select(*key, F.struct(*others).alias("_n"))
    pick = lambda c: F.when(F.col("_n").isNull() | (F.lit(c in immutable) & F.col("_o").isNotNull()), F.col(f"_o.{c}")).otherwise(F.col(f"_n.{c}")).alias(c)
    return a.join(b, key, "full_outer").select(*key, *(pick(c) for c in others)).select(old.columns)


def insert_absent(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """old and those rows of new whose key it lacks; of several new rows of a key the first in order."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")
    return old.unionByName(first.join(old, key, "left_anti").select(old.columns))


def changed(state: DataFrame, now: DataFrame, key: list[str], fingerprint: str) -> DataFrame:
    """Rows of now whose fingerprint is new or differs from the state's."""
    return now.join(state.select(*key, F.col(fingerprint).alias("_was")), key, "left").filter(~F.col("_was").eqNullSafe(F.col(fingerprint))).drop("_was")


def gone(state: DataFrame, snapshot: DataFrame, key: list[str]) -> DataFrame:
    """Keys of the state that a complete snapshot lacks."""
    return state.join(snapshot, key, "left_anti").select(*key).distinct()


def beyond_watermark(rows: DataFrame, id_: str, watermark: int, limit: int | None = None) -> DataFrame:
    """Rows above an id watermark, newest first; with a limit one page of them."""
    found = rows.filter(F.col(id_) > watermark).orderBy(F.desc(id_))
    return found if limit is None else found.limit(limit)


def sessions(rows: DataFrame, key: list[str], at: str, quiet_s: int, most_s: int | None = None) -> DataFrame:
    """Bursts of a key with pauses of under quiet_s: first and last time, number, and whether one ran as long as most_s."""
    w = Window.partitionBy(*key).orderBy(at)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    starts = rows.withColumn("_s", seconds).withColumn("_new", F.coalesce((F.col("_s") - F.lag("_s").over(w) >= quiet_s).cast("int"), F.lit(1)))
    numbered = starts.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(*key, "session").agg(F.count("*").alias("n"), F.min("_s").alias("first_s"), F.max("_s").alias("last_s"))
    return out if most_s is None else out.withColumn("full", F.col("last_s") - F.col("first_s") >= most_s)


def cascade_delete(parents: DataFrame, children: DataFrame, key: str, removed: DataFrame, shared: str) -> tuple[DataFrame, DataFrame]:
    """Parents without the removed ones, and children that go with them: those whose shared id no other parent uses."""
    kept = parents.join(removed, key, "left_anti")
    theirs = children.join(removed, key, "left_semi")
    others = children.join(removed, key, "left_anti").select(shared).distinct()
    return kept, theirs.join(others, shared, "left_anti")


def retarget(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """A foreign key moved by mapping(old, new); keys without a mapping stay."""
    return rows.join(mapping.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def sync_chunks(state: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Chunks by logical key against a state(key, chunk_id, hash, place, obsolete): key, chunk_id, action.

    Ids are stable: a known key keeps its own, a new one gets the hash of its key. An obsolete chunk that is back is
    revived, one that only changed its place is moved; what is no longer there becomes obsolete and is never deleted.
    """
    s = state.select(key, "chunk_id", F.struct("hash", "place", "obsolete").alias("_s"))
    n = now.select(key, F.struct("hash", "place").alias("_n"))
    both = s.join(n, key, "full_outer")
    here = F.when(F.col("_s").isNull(), "new").when(F.col("_s.obsolete"), "revived").when(F.col("_s.hash") != F.col("_n.hash"), "stale").when(F.col("_s.place") != F.col("_n.place"), "moved").otherwise("same")
    action = F.when(F.col("_n").isNotNull(), here).when(F.col("_s.obsolete"), "gone").otherwise("obsolete")
    return both.select(key, F.coalesce("chunk_id", F.sha2(F.col(key), 256)).alias("chunk_id"), action.alias("action"))


def republished(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, build: str) -> tuple[DataFrame, DataFrame]:
    """A graph store after one build was published again: nodes(id, data) and edges(id, build, start, end, data).

    The build's own edges are replaced as a whole, those of other builds stay. New nodes are merged by id, the new
    content wins; of several new rows of an id the least content counts. A node that no edge needs any more stays, as
    other stores may name it; an edge whose ends are no nodes is not published.
    """
    once = new_nodes.groupBy("id").agg(F.min("data").alias("data"))
    merged = nodes.join(once.select("id"), "id", "left_anti").select("id", "data").unionByName(once)
    ids = merged.select("id")
    sound = new_edges.dropDuplicates(["id"]).join(ids.withColumnRenamed("id", "start"), "start", "left_semi").join(ids.withColumnRenamed("id", "end"), "end", "left_semi")
    kept = edges.filter(F.col("build") != build)
    return merged, kept.unionByName(sound.withColumn("build", F.lit(build)).select(kept.columns))
