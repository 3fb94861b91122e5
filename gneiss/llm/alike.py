"""Near-duplicate rows by the likeness of their word shingles, every pair from the threshold on.

Texts are sets of hashed runs of SHINGLE words. Two sets whose Jaccard likeness is at least 4/5 share an element among
the first fifth of each, in whatever one order all elements have (prefix filter), so rows meet in buckets of those
elements; sizes and places rule most pairs out, bitmaps of the sets most others (two sets share at most half of what
their sizes add up to less the bits in which their bitmaps differ), and the rest are counted exactly. SimHash radii cannot promise this:
at a likeness of 0.8 fingerprints differ in about 10 of 64 bits, with a spread of 3. A sample says which elements are
in very many texts; these come last in the order, so that a common line fills no bucket.

Rows are taken in the order of (doc_id, key), and one goes if a row before it that stays is alike: the greedy choice,
whatever the size of a bucket. Small buckets compare all their rows, large ones their first rows with the others, then
more of those that are left, and so on; so a group of near copies costs each of its buckets some comparisons with rows
that its others go for, and not all pairs. A row is decided once it has been compared with all before it: it stays if
those alike to it are gone, and goes if one of them stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import cut, lean, positional, prepare, written
from gneiss.llm.simhash import components, fingerprint, link_fingerprints, signed
from gneiss.llm.substring import _keyed, word_hashes
from gneiss.llm.winnow import gram_hashes
from gneiss.shared import dropped

SHINGLE = 5
#: Jaccard likeness from which two rows are alike: 4/5, that is 9 * shared >= 4 * (size + size).
PART, WHOLE = 4, 5
#: Rows of the sample that finds common elements, rows of it that make one common, and how many are kept.
SAMPLE, COMMON, COMMON_KEPT = 20_000, 3, 50_000
#: Rows of a bucket beyond which only its first LEADERS are compared with the others, and how many times as many next.
LARGE, LEADERS, GROWTH = 16, 4, 4
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct hashes, ascending; of fewer than SHINGLE words the text is one, and blank texts have one in common."""
    words = word_hashes(text.translate(_FOLD)) if text and text.strip() else ()
    return np.unique(gram_hashes(words, min(len(words), SHINGLE))).view(np.int64) if len(words) else np.zeros(1, np.int64)


def prefix(s: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first elements of s that a set alike to s must meet: by hash, then common ones by rank (rarest first)."""
    s = np.sort(s)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        held = common[at] == s
        s = np.concatenate((s[~held], s[held][np.argsort(rank[at[held]], kind="stable")]))
    return s[: len(s) + (-PART * len(s)) // WHOLE + 1]


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each of the set's hashes, among the least power of two that is not under its size (64 at least)."""
    bits = np.zeros(1 << max(6, (len(s) - 1).bit_length()), bool)
    bits[s.view(np.uint64) & np.uint64(len(bits) - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_be_alike(n: int, m: int, x: bytes, y: bytes) -> bool:
    """Whether sets of n and m elements with bitmaps x and y can be alike; never False for sets that are."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    shared = (n + m - int(np.bitwise_count(a ^ b).sum())) // 2
    return (PART + WHOLE) * shared >= PART * (n + m)


def _keys(docs: DataFrame) -> DataFrame:
    return _keyed(docs.select("doc_id", "text")).select("doc_id", F.col("gneiss_r1").alias("r1"), F.col("gneiss_r2").alias("r2"), F.col("text").cast("binary").alias("text"))


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Elements in many rows of a sample, ascending, and their ranks."""
    every = max(docs.count() // SAMPLE, 1)
    drawn = docs.select(F.col("text").cast("binary").alias("text")).distinct().filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s, n = np.unique(np.concatenate([shingles(t) for t in b.column(0).to_pylist()]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"s": pa.array(s), "n": pa.array(n)})

    seen = drawn.mapInArrow(lean(run), "s long, n long").groupBy("s").agg(F.sum("n").alias("count")).filter(F.col("count") >= COMMON)
    top = [r["s"] for r in seen.orderBy(F.desc("count"), "s").limit(COMMON_KEPT).collect()]
    found = np.array(top, np.int64)
    order = np.argsort(found)
    return found[order], -order


def _rows(docs: DataFrame, prints: bool) -> DataFrame:
    """doc_id, r1, r2 (the row's key), equal (a hash of its set), n (its size), bits (its bitmap), first (its prefix) and
    fp (its SimHash fingerprint, 0 if not wanted)."""
    common, rank = _common(docs)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(3).to_pylist()
            sets = [shingles(t) for t in texts]
            fps = [signed(fingerprint(t)) for t in texts] if prints else [0] * len(texts)
            first = [prefix(s, common, rank) for s in sets]
            ends = np.concatenate(([0], np.cumsum([len(f) for f in first]))).astype(np.int32)
            values = np.concatenate(first) if first else np.zeros(0, np.int64)
            cols = [*b.columns[:3], pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([bitmap(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "r1", "r2", "equal", "n", "bits", "first", "fp"])

    return _keys(docs).mapInArrow(lean(run), f"doc_id {kind}, r1 long, r2 long, equal binary, n int, bits binary, first array<long>, fp long")


def fit_pairs(n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j, if their elements at places at are the first they share, can share enough of n."""
    most = 1 + np.minimum(n[i] - at[i], n[j] - at[j]) - 1
    return (PART + WHOLE) * most >= PART * (n[i] + n[j])


def paired(key: np.ndarray, n: np.ndarray, at: np.ndarray, row: np.ndarray, large: int, leaders: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (a, b) of rows in sorted buckets, a before b, in parts, and last the entries that are left. Of a bucket of
    more than large rows only the first leaders are compared with those after them; the others are left for a round more."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(key)))
    huge = np.repeat(sizes > max(large, leaders), sizes)
    place = np.arange(len(key)) - np.repeat(starts, sizes)
    none = np.zeros(0, np.int64)

    def fitting(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fits = fit_pairs(n, at, i, j)
        return row[i[fits]], row[j[fits]], none

    here, d = np.flatnonzero(~huge), 1
    while len(here):
        here = here[here + d < len(key)]
        here = here[key[here] == key[here + d]]
        yield fitting(here, here + d)
        d += 1
    first = np.repeat(starts, sizes)
    for k in range(leaders if huge.any() else 0):
        after = np.flatnonzero(huge & (place > k))
        yield fitting(first[after] + k, after)
    yield none, none, np.flatnonzero(huge & (place >= leaders))


def _pairs(listed: DataFrame, large: int, leaders: int) -> DataFrame:
    """Of listed(s, no, doc_id, r1, n, at): rows (a, b) to compare, and entries (r1 as a, s, at) left for another round."""
    none = lambda kind, n: pa.nulls(n, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in range(4)]

        def given(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b, left in paired(*cols, large, leaders):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none(pa.int64(), len(a)), none(pa.int32(), len(a))], ["a", "b", "s", "at"])
                if len(left):
                    s, _, at, r1 = (c[left] for c in cols)
                    yield pa.RecordBatch.from_arrays([pa.array(r1), none(pa.int64(), len(s)), pa.array(s), pa.array(at.astype(np.int32))], ["a", "b", "s", "at"])

        for b in batches:
            held = [np.concatenate((h, b.column(i).to_numpy().astype(np.int64))) for i, h in enumerate(held)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if last > 20_000:
                yield from given([h[:last] for h in held])
                held = [h[last:] for h in held]
        if len(held[0]):
            yield from given(held)

    dealt = listed.repartition("s").sortWithinPartitions("s", "no", "doc_id", "r1").select("s", "n", "at", "r1")
    return dealt.mapInArrow(lean(run), "a long, b long, s long, at int")


def _close(base: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that bitmaps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(["a", "b"]).filter(pa.array([may_be_alike(*r) for r in zip(*(b.column(c).to_pylist() for c in ("na", "nb", "x", "y")))], pa.bool_()))

    one = lambda end, n, bits: base.select(F.col("r1").alias(end), F.col("n").alias(n), F.col("bits").alias(bits))
    return pairs.join(one("b", "nb", "y"), "b").join(one("a", "na", "x"), "a").select("a", "b", "na", "nb", "x", "y").mapInArrow(lean(run), "a long, b long")


def _alike(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are alike."""
    ends = pairs.select(F.col("a").alias("r1")).union(pairs.select("b")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_pydict({"r1": pa.array([r], pa.int64()), "s": pa.array([shingles(t)], pa.list_(pa.int64()))})

    sets = written(_keys(docs).join(ends, "r1", "left_semi").select("r1", "text").dropDuplicates(["r1"]).mapInArrow(lean(run), "r1 long, s array<long>"), "sets")
    both = pairs.join(sets.select(F.col("r1").alias("b"), F.col("s").alias("t")), "b").join(sets.select(F.col("r1").alias("a"), "s"), "a")
    links = written(both.filter((PART + WHOLE) * F.size(F.array_intersect("s", "t")) >= PART * (F.size("s") + F.size("t"))).select("a", "b"), "links")
    dropped(sets)
    return links


#: Bytes of a part file of the stage's larger tables.
PART_BYTES = 64 << 20


def _parts(rows: DataFrame) -> int:
    """Part files for tables of about the size of a written one: two for each core, more if they would be large. A file
    costs a local store some child processes, and a stage that ends in very many small ones is slower, not wider."""
    context = rows.sparkSession.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(rows.inputFiles()[0]).getParent()
    found = folder.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return max(2 * context.defaultParallelism, -(-found // PART_BYTES))


def _settled(links: DataFrame, open_rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Of links (a, b), a before b, without rows that are decided: those that are still undecided, and the rows that go.

    A row with no link to one before it stays, unless it is open (not yet compared with all before it); the rows linked
    to one that stays go, and with them their links; and so on. Links of a group of copies settle at once, a chain takes
    a step for every second row of it.
    """
    gone = []
    while True:
        heads = links.select("a").distinct().join(links.select(F.col("b").alias("a")), "a", "left_anti").join(open_rows.select(F.col("r1").alias("a")), "a", "left_anti")
        found = written(links.join(heads, "a", "left_semi").select(F.col("b").alias("r1")).distinct(), "gone")
        if found.isEmpty():
            dropped(found)
            return links, gone
        gone.append(found)
        rest = written(links.join(found.select(F.col("r1").alias("a")), "a", "left_anti").join(found.select(F.col("r1").alias("b")), "b", "left_anti"), "links")
        dropped(links)
        links = rest


def _unlinked(rows: DataFrame) -> DataFrame:
    """Of the rows whose SimHash fingerprints are linked, over any number of steps, the first."""
    nodes = written(rows.groupBy("fp").agg(F.min(F.struct("no", "doc_id", "r1", "r2")).alias("k")), "prints")
    rooted = components(cut(link_fingerprints(nodes)))
    first = nodes.join(rooted, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("k").alias("k"))
    return rows.join(written(first.select("k.r1", "k.r2"), "firsts"), ["r1", "r2"], "left_semi")


def drop_near_duplicates(docs: DataFrame, large: int = LARGE, prints: bool = False) -> DataFrame:
    """docs without each row that is alike (Jaccard of 5-word shingles at least 0.8) to a row before it that stays.

    Rows are taken in the order of doc_id, null ones last, then by a hash of doc_id and text; of equal rows one stays.
    So no two rows that stay are alike, and every row that goes is alike to an earlier one that stays; large, the size
    of a bucket from which it takes rounds, has no influence on the result. Blank and null texts are alike. An empty
    table gives no rows; columns stay as they are, whatever their names.

    With prints, of rows linked by SimHash fingerprints (as in op3) only the first comes into this choice: fingerprints
    find what differs in a few words, and the exact search after them what their radius misses.
    """
    prepare(docs.sparkSession)
    given, docs = docs, positional(docs)
    rows = written(_rows(docs, prints).withColumn("no", F.col("doc_id").isNull()), "rows")
    lead = written((_unlinked(rows) if prints else rows).groupBy("equal").agg(F.min(F.struct("no", "doc_id", "r1", "r2")).alias("k")).select("k.r1", "k.r2"), "leads")
    parts = _parts(rows)
    base = written(rows.select("no", "doc_id", "r1", "n", "bits", "first").join(lead.select("r1"), "r1", "left_semi").dropDuplicates(["r1"]).coalesce(parts), "base")
    listed, gone, used, links, leaders = base.select("no", "doc_id", "r1", "n", F.posexplode("first").alias("at", "s")), [], [], None, LEADERS
    while True:
        out = written(_pairs(listed, large, leaders).coalesce(parts), "pairs")
        close = written(_close(base, out.filter("b is not null").select("a", "b").distinct()), "close")
        left = out.filter("b is null").select(F.col("a").alias("r1"), "s", "at")
        found = _alike(docs, close)
        links, went = _settled(found if links is None else written(links.unionByName(found).distinct(), "links"), left.select("r1").distinct())
        for t in (close, *used):
            dropped(t)
        gone += went
        for g in went:
            left = left.join(g, "r1", "left_anti")
        used = [out]
        if left.isEmpty():
            break
        listed, leaders = left.join(base.select("no", "doc_id", "r1", "n"), "r1"), leaders * GROWTH
    for g in gone:
        lead = lead.join(g, "r1", "left_anti")
    kept = written(lead, "kept").select(F.col("r1").alias("gneiss_r1"), F.col("r2").alias("gneiss_r2"))
    equal = rows.join(kept, (F.col("r1") == F.col("gneiss_r1")) & (F.col("r2") == F.col("gneiss_r2")), "left_semi").groupBy("r1", "r2").count().filter("count > 1")
    out = _keyed(docs).join(kept, ["gneiss_r1", "gneiss_r2"], "left_semi")
    if not equal.isEmpty():
        out = out.dropDuplicates(["gneiss_r1", "gneiss_r2"])
    for t in (rows, base, links, *gone, *used):
        dropped(t)
    return out.select(*docs.columns).toDF(*given.columns)
