"""Operator 2, substring de-duplication with suffix automata.

A window is L consecutive words of one document; every word under a window whose words also start elsewhere goes.

The reference is the corpus itself, which no broadcast may hold, so its shards are dealt by content: a window's anchor
is the least hash of the runs of A words in it. Equal windows have equal anchors, so neighbouring windows of one anchor
value form a segment, segments that share their value with no other one are settled, and the rest go to the shard of
their value. A shard's task builds the suffix automaton of the distinct segments of a value, with the number of times
each occurs, and streams the segments through it for matching statistics cut at L words: a match that ends in a state
of two or more occurrences is a repeated window. Values with very many distinct segments (text around a line that is
everywhere) are dealt anew, window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import hot_join, lean, map_batches, positional, prepare, table, written
from gneiss.llm.winnow import gram_hashes

WINDOW, ANCHOR = 35, 8
#: Distinct segments of an anchor value from which it is dealt window by window.
HOT = 2000
#: Words between UTF-8 bytes that are these.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240202).integers(0, 1 << 63, 256, np.uint64)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the longest text so far."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1 << 15), np.uint64)
        have[1:] = np.uint64(base)
        have = _POWERS[base] = np.cumprod(have)
    return have[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _prefix_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end], from prefix sums."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers(_STEP, len(values)))))
    return _mixed((sums[ends] - sums[starts]) * _powers(_BACK, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word of text, all at once."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return _prefix_hash(_BYTE[raw], edge[::2], edge[1::2])


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    least, width = h, 1
    while 2 * width <= w:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    return np.minimum(least[: len(least) - (w - width)], least[w - width :]) if width < w else least


def segments_of(text: bytes | None, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...] | None:
    """Of one text: anchor value, hash of the words, first and last window, and weight of each segment.

    The weight is 2 if the value occurs twice in the segment, which may then repeat a window of its own, else 1.
    """
    if not text or len(text) < 2 * window - 1:
        return None
    words = word_hashes(text)
    if len(words) < window:
        return None
    grams = gram_hashes(words, anchor)
    span = window - anchor + 1
    least = sliding_least(grams, span)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    last = np.append(first[1:], len(least)) - 1
    weight = np.ones(len(first), np.int32)
    ordered = np.sort(grams)
    if (ordered[1:] == ordered[:-1]).any():
        again = np.zeros(len(grams) + 1, np.int64)
        for d in range(1, span + 1):
            if d < len(grams):
                again[d + 1 :] |= grams[d:] == grams[:-d]
        again = np.cumsum(again)
        weight += again[np.minimum(last + span, len(grams))] > again[first]
    return least[first].view(np.int64), _prefix_hash(words, first, last + window).view(np.int64), first, last, weight


def repeated_windows(texts: list[list[bytes]], counts: list[int], window: int = WINDOW) -> list[list[list[int]]]:
    """Spans [start, end) of words of each text that windows cover which the texts, each so many times, hold twice or more."""
    arcs: list[dict] = [{}]
    link, length, seen = [-1], [0], [0]

    def clone(p: int, w: bytes, q: int) -> int:
        c = len(arcs)
        arcs.append(arcs[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        seen.append(0)
        link[q] = c
        while p >= 0 and arcs[p].get(w) == q:
            arcs[p][w] = c
            p = link[p]
        return c

    for words, n in zip(texts, counts):
        last = 0
        for w in words:
            q = arcs[last].get(w)
            if q is not None:  # a later text that goes along an earlier one
                last = q if length[q] == length[last] + 1 else clone(last, w, q)
            else:
                new, p = len(arcs), last
                arcs.append({})
                length.append(length[last] + 1)
                seen.append(0)
                link.append(0)
                while p >= 0 and w not in arcs[p]:
                    arcs[p][w] = new
                    p = link[p]
                if p >= 0:
                    q = arcs[p][w]
                    link[new] = q if length[q] == length[p] + 1 else clone(p, w, q)
                last = new
            seen[last] += n
    for s in sorted(range(1, len(arcs)), key=length.__getitem__, reverse=True):
        if link[s] > 0:
            seen[link[s]] += seen[s]
    out = []
    for words in texts:
        state, spans = 0, []
        for end, w in enumerate(words, 1):
            state = arcs[state][w]
            if end >= window:
                while length[link[state]] >= window:
                    state = link[state]
                if seen[state] > 1:
                    if spans and end - window <= spans[-1][1]:
                        spans[-1][1] = end
                    else:
                        spans.append([end - window, end])
        out.append(spans)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a 128-bit key (gneiss_r1, gneiss_r2) of each row's doc_id and text, for joins that come back to it."""
    return docs.withColumn("gneiss_r1", F.xxhash64("doc_id", "text")).withColumn("gneiss_r2", F.xxhash64("text", "doc_id", F.lit(1)))


def _segments(keyed: DataFrame) -> DataFrame:
    schema = pa.schema([(c, pa.int64()) for c in ("key", "seg", "r1", "r2")] + [(c, pa.int32()) for c in ("first", "last", "weight")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for text, r1, r2 in zip(*(b.column(i).to_pylist() for i in range(3))):
                found = segments_of(text)
                if found is not None:
                    key, seg, first, last, weight = found
                    n = len(key)
                    parts.append((key, seg, np.full(n, r1), np.full(n, r2), first, last, weight))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(f.type.to_pandas_dtype())) for c, f in zip(zip(*parts), schema)], schema=schema)

    return keyed.select(F.col("text").cast("binary"), "gneiss_r1", "gneiss_r2").mapInArrow(lean(run), "key long, seg long, r1 long, r2 long, first int, last int, weight int")


def _cut_texts(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, seg, n, hot, text) of wanted(key, seg, n, hot, r1, r2, first, last): the words of each, joined by a space."""
    lists = wanted.groupBy("r1", "r2").agg(F.collect_list(F.struct("key", "seg", "n", "hot", "first", "last")).alias("parts"))
    joined = keyed.join(lists, (F.col("gneiss_r1") == F.col("r1")) & (F.col("gneiss_r2") == F.col("r2")))

    def fn(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"key": [], "seg": [], "n": [], "hot": [], "text": []}
        for text, parts in zip(cols["text"], cols["parts"]):
            words = text.split()
            for p in parts:
                for c in ("key", "seg", "n", "hot"):
                    out[c].append(p[c])
                out["text"].append(b" ".join(words[p["first"] : p["last"] + WINDOW]))
        return out

    # Rows that repeat a doc_id and text share a key and give equal segments.
    return map_batches(joined.select(F.col("text").cast("binary").alias("text"), "parts"), fn, "key long, seg long, n long, hot boolean, text binary")


def _automata(groups: DataFrame) -> DataFrame:
    """(key, seg, spans) of groups(key, seg, n, text): for each key one automaton, over its distinct segments."""
    dealt = groups.repartition("key").sortWithinPartitions("key", "seg")
    schema = pa.schema([("key", pa.int64()), ("seg", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            unique = {r[1]: r for r in held}
            rows = list(unique.values())
            texts = [r[3].split(b" ") for r in rows]
            for r, spans in zip(rows, repeated_windows(texts, [r[2] for r in rows])):
                if spans:
                    out.append((r[0], r[1], spans))
            held.clear()

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("key", "seg", "n", "text"))):
                if held and held[0][0] != r[0]:
                    close()
                held.append(r)
            if len(out) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if held:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return dealt.mapInArrow(lean(run), "key long, seg long, spans array<array<int>>")


def _windows(texts: DataFrame) -> DataFrame:
    """The single windows of hot segments: hash, place, and text."""

    def fn(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"key": [], "seg": [], "n": [], "at": [], "text": []}
        for key, seg, n, text in zip(cols["key"], cols["seg"], cols["n"], cols["text"]):
            words = text.split(b" ")
            for i in range(len(words) - WINDOW + 1):
                for c, v in (("key", key), ("seg", seg), ("n", n), ("at", i), ("text", b" ".join(words[i : i + WINDOW]))):
                    out[c].append(v)
        return out

    return map_batches(texts.select("key", "seg", "n", "text"), fn, "key long, seg long, n long, at int, text binary").withColumn("window", F.xxhash64("text")).withColumn("check", F.xxhash64("text", F.lit(1)))


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(r1, r2, spans) for the rows of keyed that hold repeated windows; spans of words [start, end), not yet merged."""
    runs = written(_segments(keyed), "segments")
    shared = written(runs.groupBy("key").agg(F.sum("weight").alias("all"), F.count(F.lit(1)).alias("runs")).filter(F.col("all") > 1).select("key", "runs"), "shared")
    rest = hot_join(runs, shared, ["key"], "runs")
    distinct = rest.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("r1", "r2", "first", "last")).alias("one"))
    kinds = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > HOT).select("key", F.lit(True).alias("hot"))
    wanted = distinct.join(kinds, "key", "left").select("key", "seg", "n", F.coalesce("hot", F.lit(False)).alias("hot"), "one.*")
    texts = written(_cut_texts(keyed, wanted), "segment-texts")
    times = texts.select("key", "seg", "n").dropDuplicates(["key", "seg"])
    found = _automata(texts.filter(~F.col("hot")))
    if not kinds.isEmpty():
        windows = _windows(texts.filter("hot").dropDuplicates(["key", "seg"]))
        summed = windows.groupBy("window", "check").agg(F.sum("n").alias("n"), F.first("text").alias("text"))
        again = _automata(summed.select(F.col("window").alias("key"), F.col("check").alias("seg"), "n", "text")).select(F.col("key").alias("window"), F.col("seg").alias("check"))
        found = found.unionByName(windows.select("key", "seg", "at", "window", "check").join(again, ["window", "check"]).groupBy("key", "seg").agg(F.collect_list(F.array(F.col("at"), F.col("at") + WINDOW)).alias("spans")))
    moved = F.transform("spans", lambda s: F.array(s[0] + F.col("first"), s[1] + F.col("first")))
    found = written(found.join(times, ["key", "seg"]), "found")
    return hot_join(rest, found, ["key", "seg"], "n").groupBy("r1", "r2").agg(F.flatten(F.collect_list(moved)).alias("spans"))


def _kept(text: bytes | None, spans: list | None) -> tuple[int, list[bytes]]:
    words = text.split() if text else []
    if not spans:
        return len(words), words
    out, at = [], 0
    for a, b in sorted(spans):
        if a > at:
            out += words[at:a]
        at = max(at, b)
    return len(words), out + words[at:]


def _with_spans(docs: DataFrame) -> DataFrame:
    keyed = _keyed(docs)
    spans = repeated_spans(keyed.select("text", "gneiss_r1", "gneiss_r2"))
    return keyed.join(spans.select(F.col("r1").alias("gneiss_r1"), F.col("r2").alias("gneiss_r2"), F.col("spans").alias("gneiss_spans")), ["gneiss_r1", "gneiss_r2"], "left")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): n_words, n_removed, kept_sha256 (kept words joined by one space, UTF-8).

    Null, empty and short texts keep all their words; repeated rows give a row each and count as each other's copies;
    an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def fn(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_words": [], "n_removed": [], "kept_sha256": []}
        for text, spans in zip(cols["text"], cols["gneiss_spans"]):
            n, kept = _kept(text, spans)
            out["n_words"].append(n)
            out["n_removed"].append(n - len(kept))
            out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return out

    joined = _with_spans(docs.select("doc_id", "text"))
    return map_batches(joined.select("doc_id", F.col("text").cast("binary").alias("text"), "gneiss_spans"), fn, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated windows cut from text (the kept words joined by one space) and n_chars set anew.

    A text without repeats, null, empty or short stays as it is; repeated rows are each other's copies and lose their
    long passages; an empty table gives no rows. Columns stay as they are, whatever their names.
    """
    prepare(docs.sparkSession)
    given, docs = docs, positional(docs, ("doc_id", "text", "n_chars"))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            texts = []
            for text, spans in zip(cols["text"].to_pylist(), cols["gneiss_spans"].to_pylist()):
                texts.append(b" ".join(_kept(text.encode(), spans)[1]).decode() if spans else text)
            cols["text"] = pa.array(texts, b.schema.field("text").type)
            if "n_chars" in names:
                was = cols["n_chars"].to_pylist()
                spans = cols["gneiss_spans"].to_pylist()
                cols["n_chars"] = pa.array([len(t) if s else n for t, s, n in zip(texts, spans, was)], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    return _with_spans(docs).select(*names, "gneiss_spans").mapInArrow(lean(run), docs.schema).toDF(*given.columns)


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeats of all documents; edge cases as there."""
    return remove_repeats(table(spark, sf_dir, "documents"))
