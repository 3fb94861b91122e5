"""Operator 3, SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most R bits, split into partitions with thresholds t_p >= -1 whose sum is R - m + 1,
agree up to t_p bits in at least one partition p. Correlated bits share a partition; a dynamic programme chooses the
thresholds by the rows and candidates that a sample of fingerprints lets expect. Each distinct fingerprint is listed
under its value in every partition in use, and probes the values within t_p bits; buckets verify their candidates and
give a spanning forest of the links found, so a group of copies costs edges in proportion to its fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import cut, hot_join, lean, map_batches, prepare, table
from gneiss.shared import dropped, written

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 3
#: Fingerprints in the sample that the plan is made from, and those of it that are compared pair by pair.
SAMPLE, PAIRED = 20_000, 2000
#: Numbers of partitions that the plan may take, and microseconds of a listed or probing row and of a candidate.
PARTITIONS, ROW_US, CANDIDATE_US = (2, 3, 4), 1.5, 0.02
#: Rows of one bucket from which it is split once more by other bits.
LARGE = 2048
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ONE = np.uint64(1)


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit SimHash; none of words: 0."""
    words = text.translate(_FOLD).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return h(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -SHINGLE] + 1)).tolist()
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())), np.uint64, n)
    votes = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row of docs(doc_id, text); a null text has no words."""
    prepare(docs.sparkSession)
    fn = lambda cols: {"doc_id": cols["doc_id"], "fp": [signed(fingerprint(t)) for t in cols["text"]]}
    return map_batches(docs.select("doc_id", F.col("text").cast("binary").alias("text")), fn, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def correlated_groups(fps: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m groups of about equal width, correlated ones together."""
    bits = ((fps[:, None] >> np.arange(BITS, dtype=np.uint64)) & _ONE).astype(np.float64)
    spread = bits.std(0) if len(bits) else np.zeros(BITS)
    z = (bits - (bits.mean(0) if len(bits) else 0)) / np.where(spread > 0, spread, 1)
    c = np.abs(z.T @ z) / max(len(fps), 1)
    np.fill_diagonal(c, 0)
    free, groups = set(range(BITS)), []
    for g in range(m):
        width = (len(free) + m - g - 1) // (m - g)
        group = [max(free, key=lambda b: (c[b, sorted(free)].sum(), -b))]
        free.discard(group[0])
        while len(group) < width:
            best = max(free, key=lambda b: (c[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_p >= -1 that sum to total at least cost; costs[p][t + 1] for t from -1 to RADIUS."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, ts) in best.items():
            for t in range(-1, RADIUS + 1):
                new = (cost + row[t + 1], [*ts, t])
                if s + t not in after or new < after[s + t]:
                    after[s + t] = new
        best = after
    return best[total]


def plan(sample: np.ndarray, n: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions in use, for n fingerprints of which sample is a part."""
    some = sample[:PAIRED]
    apart = some[:, None] ^ some[None, :]
    pairs = max(len(some) * (len(some) - 1), 1)
    best = None
    for m in PARTITIONS:
        groups = correlated_groups(sample, m)
        costs = []
        for g in groups:
            far = np.bincount(np.bitwise_count(apart & mask_of(g)).ravel(), minlength=BITS + 1)
            far[0] -= len(some)
            row = [0.0]
            for t in range(RADIUS + 1):
                probes = sum(comb(len(g), i) for i in range(t + 1))
                chance = (far[: t + 1].sum() + 1) / pairs
                row.append(n * probes * ROW_US + n * n / 2 * chance * CANDIDATE_US)
            costs.append(row)
        cost, ts = allocate(costs, RADIUS - m + 1)
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, ts) if t >= 0])
    return best[1]


def spread(fps: np.ndarray, parts: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket key, fingerprint and whether the row only probes, for the rows that fps give."""
    keys, rows, probing = [], [], []
    for p, (bits, t) in enumerate(parts):
        own = np.zeros(len(fps), np.uint64)
        for i, b in enumerate(bits):
            own |= ((fps >> np.uint64(b)) & _ONE) << np.uint64(i)
        for r in range(t + 1):
            for flips in combinations(range(len(bits)), r):
                keys.append((own ^ mask_of(list(flips))) | np.uint64(p << 60))
                rows.append(fps)
                probing.append(np.full(len(fps), r > 0))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    # Up to 60 bits of value: partitions are at most 32 wide.
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(probing)


def neighbours(keys: np.ndarray, fps: np.ndarray, probing: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within RADIUS bits among rows of equal key; keys are sorted. Two rows that only probe are no candidates."""
    here = np.arange(len(keys) - 1)
    d = 1
    while len(here):
        here = here[here + d < len(keys)]
        here = here[keys[here] == keys[here + d]]
        a, b = fps[here], fps[here + d]
        near = (np.bitwise_count(a ^ b) <= RADIUS) & (a != b) & ~(probing[here] & probing[here + d])
        if near.any():
            yield a[near], b[near]
        d += 1


class Forest:
    """The links that first connect fingerprints; others add nothing."""

    def __init__(self):
        self.root: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def top(self, x: int) -> int:
        root = self.root
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = self.top(x), self.top(y)
            if p != q:
                self.root[max(p, q)] = min(p, q)
                self.edges.append((signed(x), signed(y)))


def grown(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all that links within RADIUS connect among distinct fps: from one on, all that are near and
    not yet reached are reached, so that a dense group costs a few passes and no list of its pairs."""
    left = np.unique(fps)
    while len(left):
        edge, left = [left[0]], left[1:]
        while edge and len(left):
            x = np.uint64(edge.pop())
            near = np.bitwise_count(left ^ x) <= RADIUS
            if near.any():
                yield np.full(int(near.sum()), x, np.uint64), left[near]
                edge += left[near].tolist()
                left = left[~near]


def links(keys: np.ndarray, fps: np.ndarray, probing: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links in sorted buckets; large buckets are split by each quarter of the bits first."""
    starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] + _ONE)) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(keys)))
    large = np.repeat(sizes > LARGE, sizes)
    forest = Forest()
    for a, b in neighbours(keys[~large], fps[~large], probing[~large]):
        forest.add(a, b)
    for q in range(RADIUS + 1) if large.any() else ():
        # Of the pair's at most RADIUS differing bits none lies in at least one of RADIUS + 1 quarters.
        quarter = (fps[large] >> np.uint64(16 * q)) & np.uint64(0xFFFF)
        order = np.lexsort((quarter, keys[large]))
        group = np.cumsum(np.concatenate(([0], (np.diff(keys[large][order]) != 0) | (np.diff(quarter[order]) != 0))))
        part, probes = fps[large][order], probing[large][order]
        many = np.repeat(np.bincount(group) > LARGE, np.bincount(group))
        for a, b in neighbours(group[~many], part[~many], probes[~many]):
            forest.add(a, b)
        for g in np.unique(group[many]):
            for a, b in grown(part[group == g]):
                forest.add(a, b)
    return forest.edges


def link_fingerprints(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints nodes(fp); what they connect is what links within RADIUS connect."""
    n = nodes.count()
    drawn = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    parts = plan(np.array([r["fp"] for r in drawn], np.int64).view(np.uint64), n)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, f, p = spread(b.column(0).to_numpy().view(np.uint64), parts)
            for i in range(0, len(k), 100_000):
                s = slice(i, i + 100_000)
                yield pa.RecordBatch.from_pydict({"key": pa.array(k[s].view(np.int64)), "fp": pa.array(f[s].view(np.int64)), "probing": pa.array(p[s])})

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # whole buckets and the begin of the last one, in parts
        size = 0

        def given(cols: list[np.ndarray]) -> pa.RecordBatch:
            e = links(*cols)
            return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in e], pa.int64()), "b": pa.array([y for _, y in e], pa.int64())})

        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)]
            last = int(np.flatnonzero(new[0] != new[0][-1])[-1]) + 1 if new[0][0] != new[0][-1] else 0
            closes = bool(held) and held[-1][0][-1] != new[0][-1]
            if last or closes:  # the batch's last bucket begins in it
                held.append([x[:last] for x in new])
                size += last
                if size > 20_000:
                    yield given([np.concatenate(x) for x in zip(*held)])
                    held, size = [], 0
                new = [x[last:] for x in new]
            held.append(new)
            size += len(new[0])
        if held:
            yield given([np.concatenate(x) for x in zip(*held)])

    rows = nodes.select("fp").mapInArrow(lean(listed), "key long, fp long, probing boolean")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(lean(verified), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) of every end of edges(a, b): the least fingerprint it is connected with.

    Every round takes the least label among neighbours and then the label's label, so rounds grow with the logarithm
    of the longest chain. Each round's labels are a written table, so plans and their estimates do not grow.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    label = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "fp"), "labels")
    while True:
        near = both.join(label.select(F.col("fp").alias("b"), F.col("root").alias("_l")), "b").groupBy("a").agg(F.min("_l").alias("near"))
        step = label.join(near, label["fp"] == near["a"]).select("fp", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        beyond = step.select(F.col("fp").alias("root"), F.col("root").alias("beyond"))
        new = written(step.join(beyond, "root").select("fp", F.least("root", "beyond").alias("root"), (F.least("root", "beyond") != F.col("was")).alias("moved")), "labels")
        dropped(label)
        label = new.select("fp", "root")
        if new.filter("moved").isEmpty():
            return label


def near_duplicates(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): fingerprint (16 hex digits) and component_id, the least doc_id linked with it.

    Null, empty and blank texts have the fingerprint zero and are linked to one another like any others; repeated
    rows give a row each; a null doc_id gets its component like others but never names one (unless all are null); an
    empty table gives no rows; other columns, whatever their names, are ignored.
    """
    fps = cut(fingerprints(docs))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    rooted = components(cut(link_fingerprints(nodes)))
    known = nodes.join(rooted, "fp", "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    named = cut(known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", "copies"))
    return hot_join(fps, named, ["fp"], "copies").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of all documents; edge cases as there."""
    return near_duplicates(table(spark, sf_dir, "documents"))
