"""Operator 5, document fingerprints by winnowing.

Every run of K code points has a rolling hash; of each window of W neighbouring hashes the least one is chosen, the
rightmost on ties, and kept with its position. Any passage of K + W - 1 code points that two texts share gives both
at least one hash in common.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import lean, prepare, table, text_or_empty

K, W = 16, 15
#: An odd multiplier of the rolling hash and the mixing steps' constants (fixed values).
BASE = np.array([0x9E3779B97F4A7C15], np.uint64)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Low bits that hold a place, and windows of one piece.
PLACES, PIECE = np.uint64((1 << 20) - 1), 1 << 19
#: Rows of a range of doc_ids, about.
RANGE_ROWS = 100_000
#: Ranges at least, and at most.
LEAST_RANGES, MOST_RANGES = 48, 10_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of every k neighbours by doubling: h(2n) at i is h(n) at i times BASE^n plus h(n) at i + n."""
    n = len(points)
    if n < k:
        return np.zeros(0, np.uint64)
    h, width, power = (points.astype(np.uint64) + np.uint64(1)) * MIX[0], 1, BASE
    out, done = None, 0
    while True:
        if k & width:
            if out is None:
                out, done = h, width
            else:
                m = n - done - width + 1
                out, done = out[:m] * power + h[done : done + m], done + width
        if done == k:
            return _mix(out)
        m = n - 2 * width + 1
        h, power, width = h[:m] * power + h[width : width + m], power * power, 2 * width


def window_least(h: np.ndarray, w: int = 97) -> np.ndarray:
    """Positions of the rightmost least value of each window of w, without repeats, ascending.

    Value (44 bits) and place from the right share a word, so that one sliding minimum settles ties; texts of more
    than 2^19 windows are done in pieces whose windows overlap.
    """
    n, chosen = len(h), []
    for a in range(0, max(n - w, 0) + 1, PIECE):
        part = h[a : a + PIECE + w - 1]
        m = len(part)
        if m == 0:
            break
        least, width = (part & ~PLACES) | (PLACES - np.arange(m, dtype=np.uint64)), 1
        whole = min(w, m)
        while 2 * width <= whole:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < whole:
            more = whole - width
            least = np.minimum(least[:-more], least[more:])
        at = (PLACES - (least & PLACES)).astype(np.int64) + a
        chosen.append(at[np.flatnonzero(np.diff(at, prepend=-1))])
    out = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
    return out[np.flatnonzero(np.diff(out, prepend=-1))] if len(chosen) > 1 else out


def fingerprint(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes (32 bits) and their positions, in code points; a text of under k is one gram, an empty one none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    h = gram_hashes(points, min(k, len(points)))
    at = window_least(h, w)
    return (h[at] >> np.uint64(32)).astype(np.uint32), at


def as_string(hashes: np.ndarray, at: np.ndarray) -> str:
    """'hash:position' in hexadecimal, comma-joined, by position."""
    return ",".join(f"{h:08x}:{p:x}" for h, p in zip(hashes.tolist(), at.tolist()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of the sets of chosen hashes; two empty fingerprints are alike."""
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _place(c: Column, bounds: list[int]) -> Column:
    """How many bounds are at most c, looked up in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    upto = lambda array: F.size(F.filter(array, lambda b: b <= c))
    coarse = upto(F.lit([p[0] for p in parts[1:]])) if len(parts) > 1 else F.lit(0)
    return coarse * step + upto(F.element_at(F.array(*map(F.lit, parts)), coarse + 1))


def _with_next(docs: DataFrame) -> DataFrame:
    """docs in ranges of doc_id, each range with the first row of the next one (head); the last range's next is the first.

    One shuffle of the texts. Splitters and range heads are a few bytes a range, and ranges are MOST_RANGES at most: beyond
    that they hold more rows, which a task sorts with spilling and streams through.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("h"))
    n = docs.count()
    ranges = max(LEAST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-n // RANGE_ROWS), MOST_RANGES))
    at = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, at)), F.lit(max(10_000, 20 * ranges))).alias("b")).first()["b"] or []))
    number = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_place(F.col("doc_id"), bounds)).cast("int")
    # Every head row is the least (doc_id, text hash) of its range; one of equal rows stands for all.
    heads = ids.withColumn("range", number).groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), F.col("doc_id"), F.col("h"))).alias("s")).orderBy("range").collect()
    to = {(r["s"]["doc_id"], r["s"]["h"]): heads[i - 1]["range"] for i, r in enumerate(heads)}
    table_ = spark.createDataFrame([(i, h, r) for (i, h), r in to.items()], "head_id long, head_hash long, goes_to int")
    base = docs.select("doc_id", text_or_empty().alias("text")).withColumn("range", number)
    own = base.withColumn("head", F.lit(False))
    sent = base.withColumn("h", F.xxhash64("text")).join(F.broadcast(table_), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_hash"))).select("doc_id", "text", F.col("goes_to").alias("range"), F.lit(True).alias("head"))
    # A range is a partition: hashed range numbers would put several of them into one task.
    return own.unionByName(sent).repartitionById(ranges, "range").sortWithinPartitions("range", "head", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))


def compare_edits(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): fingerprint of the text, of its edited text, and likeness to that and the next.

    Rows are in the order of (doc_id, text hash), null doc_ids first, so repeated doc_ids are each other's neighbours;
    a lone row is its own next. Null texts count as ""; an empty text has the fingerprint "" and is alike to "" only;
    an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next is awaited: range, doc_id, text, hashes, positions
        out: list[tuple] = []
        for b in batches:
            for i, text, rng, head in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "range", "head"))):
                if held is not None and held[0] != rng:
                    held = None  # answered by its range's head, or never opened
                if held is None and head:
                    continue  # a head without rows before it, or a repeated head row
                now = fingerprint(text)
                if held is not None:
                    _, hid, htext, hh, hp = held
                    changed = edited(htext, text)
                    eh, ep = fingerprint(changed)
                    out.append((hid, len(htext), hashlib.sha256(changed.encode()).hexdigest(), as_string(hh, hp), as_string(eh, ep), likeness(hh, eh), likeness(hh, now[0])))
                held = None if head else (rng, i, text, *now)
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return _with_next(docs).mapInArrow(lean(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").select(names)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compare_edits of all documents; edge cases as there."""
    return compare_edits(table(spark, sf_dir, "documents"))
