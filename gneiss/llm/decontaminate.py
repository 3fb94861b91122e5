"""Operator 8, benchmark decontamination by Wu-Manber search over words.

The alphabet is words. A window of a benchmark item (13 consecutive words, or the whole of a shorter item) is a
pattern. Patterns of one length form a class with its own tables: the shift table tells for each block of two words
how far the search may move on, blocks that end a pattern select a suffix bucket, and the words themselves are
compared before an occurrence counts.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import filter_batches, map_batches, once, prepare, table, written

WINDOW = 13
#: A document is contaminated from one hit word in this many.
ONE_IN = 20
#: Benchmark bytes of one broadcast, about; more items are searched block by block. Tables take some hundred times as much.
BLOCK_BYTES = 2 << 20

#: Bytes that separate words (all ASCII but 0-9, A-Z, a-z) become spaces, A-Z become a-z; every byte of a non-ASCII character belongs to a word.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class WordSearch:
    """Wu-Manber tables over the windows of items: {item_id: words}."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        owners: dict[tuple, set] = defaultdict(set)
        for item, words in items:
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners[tuple(words[i : i + window])].add(item)
        self.owners = {k: frozenset(v) for k, v in owners.items()}
        self.classes = []
        for m in sorted({len(p) for p in owners}):
            mine = [p for p in owners if len(p) == m]
            block = min(2, m)
            shift: dict[tuple, int] = {}
            buckets: dict[tuple, list] = defaultdict(list)
            for p in mine:
                for end in range(block, m + 1):
                    key = p[end - block : end]
                    shift[key] = min(shift.get(key, m), m - end)
                buckets[p[-block:]].append(p)
            self.classes.append((m, block, shift, {k: self._by_prefix(v, block) for k, v in buckets.items()}))

    @staticmethod
    def _by_prefix(patterns: list[tuple], block: int) -> dict[tuple, list]:
        """Within a suffix bucket, patterns by their first words: most windows are refused after one look-up."""
        out: dict[tuple, list] = defaultdict(list)
        for p in patterns:
            out[p[:block]].append(p)
        return dict(out)

    def find(self, words: list[bytes]):
        """(start, pattern) of every occurrence."""
        n = len(words)
        for m, block, shift, buckets in self.classes:
            far, at = m - block + 1, m - 1
            if block == 2:
                while at < n:
                    move = shift.get((words[at - 1], words[at]), far)
                    if move:
                        at += move
                        continue
                    start = at - m + 1
                    for p in buckets[(words[at - 1], words[at])].get((words[start], words[start + 1]), ()):
                        if tuple(words[start : at + 1]) == p:
                            yield start, p
                    at += 1
            else:
                for i, w in enumerate(words):
                    if (w,) in buckets:
                        yield i, (w,)

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Merged spans [start, end) that occurrences cover, and the items they come from."""
        spans, items = [], set()
        for start, p in self.find(words):
            items |= self.owners[p]
            spans.append([start, start + len(p)])
        return merged(spans), items


def merged(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(benchmark: DataFrame) -> Iterator[bytes]:
    """Pickled search input, one block of about BLOCK_BYTES of item text after the other; the driver holds one."""
    items = benchmark.select("item_id", F.col("text").cast("binary").alias("text"))
    n = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] // BLOCK_BYTES + 1
    for b in range(n):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else items
        found = [(r["item_id"], words_of(bytes(r["text"]))) for r in some.filter(F.col("text").isNotNull()).toLocalIterator()]
        yield pickle.dumps([x for x in found if x[1]])


def _searched(texts: DataFrame, block: bytes, keys: str, sent: Broadcast, hits_only: bool = False) -> DataFrame:
    """texts(<keys>, text) with n_words, spans and items that the items of one block, sent, give."""
    key = "wm-" + hashlib.sha256(block).hexdigest()

    def fn(cols: dict[str, list]) -> dict[str, list]:
        search = once(key, lambda: WordSearch(pickle.loads(sent.value)))
        n, spans, items = [], [], []
        for t in cols["text"]:
            words = words_of(t)
            s, i = search.hits(words)
            n.append(len(words))
            spans.append(s)
            items.append([str(x) for x in i])
        return cols | {"n_words": n, "spans": spans, "items": items}

    found = map_batches(texts, fn, f"{keys}, n_words long, spans array<array<int>>, items array<string>")
    return found.filter(F.size("spans") > 0) if hits_only else found


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row of docs with gneiss_n (words), gneiss_spans (not merged over blocks) and gneiss_items.

    One block is searched in one pass. More of them take a pass each, of which only the rows with hits are written, and
    come together by the row's (doc_id, text): rows equal in both have equal hits.
    """
    blocks = _blocks(benchmark)
    first, second = next(blocks), next(blocks, None)
    text = F.col("text").cast("binary")
    if second is None:
        names = [f"c{i}" for i in range(len(docs.columns))]
        plain = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]).cast("binary"))
        out = _searched(plain, first, ", ".join(f"{n} {k}" for n, (_, k) in zip(names, docs.dtypes)), docs.sparkSession.sparkContext.broadcast(first))
        return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)), F.col("n_words").alias("gneiss_n"), F.col("spans").alias("gneiss_spans"), F.col("items").alias("gneiss_items"))
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("r2"), text.alias("text"))
    each = []
    for b in chain((first, second), blocks):
        sent = docs.sparkSession.sparkContext.broadcast(b)
        each.append(written(_searched(keyed, b, "r1 long, r2 long", sent, True), "hits"))
        sent.destroy()
    hits = reduce(DataFrame.unionByName, each).groupBy("r1", "r2").agg(F.flatten(F.collect_set("spans")).alias("gneiss_spans"), F.flatten(F.collect_set("items")).alias("gneiss_items"))
    rows = docs.withColumn("gneiss_r1", F.xxhash64("doc_id", "text")).withColumn("gneiss_r2", F.xxhash64("text", "doc_id", F.lit(1)))
    joined = rows.join(hits, (F.col("gneiss_r1") == F.col("r1")) & (F.col("gneiss_r2") == F.col("r2")), "left")
    count = map_batches(joined.select(*(F.col(c) for c in docs.columns), "gneiss_spans", "gneiss_items").withColumn("gneiss_text", text), lambda cols: {k: v for k, v in cols.items() if k != "gneiss_text"} | {"gneiss_n": [len(words_of(t)) for t in cols["gneiss_text"]]}, ", ".join(f"`{c}` {k}" for c, k in docs.dtypes) + ", gneiss_n long, gneiss_spans array<array<int>>, gneiss_items array<string>")
    return count


def _contaminated(n: int, spans: list | None) -> tuple[int, bool]:
    hit = sum(b - a for a, b in merged(spans or []))
    return hit, hit > 0 and ONE_IN * hit >= n


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; null items match nothing; a null item_id counts as "None";
    repeated rows give a row each; an empty benchmark hits nothing, an empty table gives no rows. Other columns,
    whatever their names, are ignored.
    """
    prepare(docs.sparkSession)

    def digest(cols: dict[str, list]) -> dict[str, list]:
        items = [sorted(set(x or ())) for x in cols["gneiss_items"]]
        judged = [_contaminated(n, s) for n, s in zip(cols["gneiss_n"], cols["gneiss_spans"])]
        return {
            "doc_id": cols["doc_id"], "n_words": cols["gneiss_n"], "n_hit": [h for h, _ in judged], "n_items": [len(x) for x in items],
            "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], "contaminated": [c for _, c in judged],
        }

    found = _found(docs.select("doc_id", "text"), benchmark).drop("text")
    return map_batches(found, digest, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows of which a twentieth or more of the words lie in benchmark windows; columns unchanged.

    Null and empty texts stay, as all rows do if the benchmark is empty; repeated rows are judged alike.
    """
    spark = docs.sparkSession
    prepare(spark)
    blocks = _blocks(benchmark)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        sent, key = spark.sparkContext.broadcast(first), "wm-" + hashlib.sha256(first).hexdigest()

        def keep(cols: dict[str, list]) -> list[bool]:
            search = once(key, lambda: WordSearch(pickle.loads(sent.value)))
            words = [words_of(t.encode() if t is not None else None) for t in cols["text"]]
            return [not _contaminated(len(w), search.hits(w)[0])[1] for w in words]

        return filter_batches(docs, keep)
    found = _found(docs.select("doc_id", "text"), benchmark)
    bad = map_batches(found.select(F.xxhash64("doc_id", "text").alias("gneiss_r1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("gneiss_r2"), "gneiss_n", "gneiss_spans").filter("gneiss_spans is not null"), lambda cols: {"gneiss_r1": cols["gneiss_r1"], "gneiss_r2": cols["gneiss_r2"], "bad": [_contaminated(n, s)[1] for n, s in zip(cols["gneiss_n"], cols["gneiss_spans"])]}, "gneiss_r1 long, gneiss_r2 long, bad boolean").filter("bad")
    rows = docs.withColumn("gneiss_r1", F.xxhash64("doc_id", "text")).withColumn("gneiss_r2", F.xxhash64("text", "doc_id", F.lit(1)))
    return rows.join(bad.select("gneiss_r1", "gneiss_r2"), ["gneiss_r1", "gneiss_r2"], "left_anti").select(*docs.columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_contamination of all documents by all items; edge cases as there."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
