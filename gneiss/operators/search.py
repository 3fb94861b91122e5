"""Keyword and vector scores, their fusion, BM25, grams and citations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.text import bilingual_tokens, matches_term, may_match
from gneiss.operators.aggregates import ratio
from gneiss.operators.joins import named_in
from gneiss.shared import ship, spread, tasks, written

# Fixed values of the scoring rule: field weights, boosts, weights of query terms, words that only vary a product's
# name, and words that are no terms.
FIELDS = [("title", 0.50), ("summary", 0.30), ("body", 0.20), ("tag", 0.10)]
ENTITY_TITLE, ENTITY_TAG = 0.45, 0.35
PHRASE, VARIANT, DIGITS, PLAIN = 3.0, 0.15, 0.05, 1.0
KEYWORD_SHARE, BONUS, LEAST_VECTOR = 0.85, 0.1, 0.20
VARIANTS = {"pro", "max", "mini", "plus", "standard", "version"}
STOP = {"a", "an", "and", "are", "for", "how", "in", "is", "of", "on", "or", "the", "to", "what", "which", "with"}


def query_terms(query: str, phrases: list[str] = ()) -> list[str]:
    """Terms of a query: known phrases first, then its words without stop words, once each."""
    low = query.casefold()
    found = [p for p in phrases if p.casefold() in low]
    tokens = [w for w in "".join(c if c.isalnum() else " " for c in low).split() if w not in STOP]
    return list(dict.fromkeys([*(p.casefold() for p in found), *tokens]))


def term_weights(terms: list[str], phrases: list[str] = ()) -> dict[str, float]:
    known = {p.casefold() for p in phrases}
    return {t: PHRASE if t in known else DIGITS if t.isdigit() and len(terms) > 1 else VARIANT if t in VARIANTS else PLAIN for t in terms}


def pruned(weights: dict[str, float], has_entities: bool = False) -> list[str]:
    """Terms that must be looked for: the lightest go as long as what they could add stays under the score threshold."""
    if has_entities:
        return list(weights)
    limit, dropped, gone = LEAST_VECTOR * max(sum(weights.values()), 1.0) - 1e-12, 0.0, set()
    for t, w in sorted(weights.items(), key=lambda x: (x[1], x[0])):
        if dropped + w >= limit:
            break
        dropped, gone = dropped + w, gone | {t}
    return [t for t in weights if t not in gone]


def keyword_score(fields: dict[str, Column], weights: dict[str, float], entities: list[str] = ()) -> Column:
    """Each term scores its best field; the sum over half the terms' weight (at least 1); entity boosts if that is not 0; at most 1.

    Fields are lower-case texts.
    """
    hit = lambda f, t: matches_term(fields[f], t, lowered=True) if f in fields else F.lit(False)
    total = F.lit(0.0)
    for term, w in weights.items():
        best = reduce(lambda c, f: c.when(hit(f[0], term), f[1]), FIELDS[1:], F.when(hit(FIELDS[0][0], term), FIELDS[0][1])).otherwise(0.0)
        total = total + w * best
    base = total / (0.5 * max(sum(weights.values()), 1.0))
    boost = F.lit(0.0)
    for e in entities:
        boost = boost + F.when(hit("title", e), ENTITY_TITLE).when(hit("tag", e), ENTITY_TAG).otherwise(0.0)
    return F.when(base > 0, F.least(base + boost, F.lit(1.0))).otherwise(0.0)


def keyword_hits(items: DataFrame, fields: dict[str, Column], weights: dict[str, float], entities: list[str] = ()) -> DataFrame:
    """items with a score over 0, and the score. Texts are lower-cased once, rows that hold no term's longest word go
    before any expression is matched, and the score is computed once: it passes through a generator, which filters
    after it do not cross."""
    low = items.withColumns({f"_{n}": F.lower(c) for n, c in fields.items()})
    some = low.filter(reduce(lambda x, y: x | y, (may_match(F.col(f"_{n}"), list(weights)) for n in fields)))
    scored = keyword_score({n: F.col(f"_{n}") for n in fields}, weights, entities)
    return some.withColumn("score", F.explode(F.filter(F.array(scored), lambda x: x > 0))).drop(*(f"_{n}" for n in fields))


#: Items that a lane scores at once, and questions that it holds.
SCORED, ASKED = 16_384, 65_536


class _Lane:
    """The k best items so far of some questions; items come in order of id, in blocks."""

    def __init__(self, weights: list[float], k: int):
        self.weights, self.k, self.names, self.asked, self.totals, self.held = weights, k, [], [], [], []

    def ask(self, names: list, terms: list[list[str]]) -> None:
        self.names += names
        self.asked += terms
        self.totals += [max(float(len(t)), 1.0) for t in terms]

    def ready(self) -> None:
        number = {t: i for i, t in enumerate(dict.fromkeys(t for terms in self.asked for t in terms))}
        self.known, self.asked = pa.array(list(number), pa.string()), [[number[t] for t in terms] for terms in self.asked]
        self.best = [(np.zeros(0), np.zeros(0, np.int64))] * len(self.asked)

    def add(self, ids: pa.Array, fields: list[pa.Array]) -> None:
        self.held.append((ids.to_numpy(), [(f.flatten(), pc.fill_null(pc.list_value_length(f), 0).to_numpy()) for f in fields]))
        if sum(len(i) for i, _ in self.held) >= SCORED:
            self.score()

    def _postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each known term begins, and the items (by place in the block) and weights it has; the best field counts."""
        words, at, weight, n = [], [], [], 0
        for ids, fields in self.held:
            for (flat, lengths), w in zip(fields, self.weights):
                words.append(flat)
                at.append(np.repeat(np.arange(n, n + len(ids)), lengths))
                weight.append(np.full(len(flat), w))
            n += len(ids)
        term = pc.fill_null(pc.index_in(pa.concat_arrays(words), value_set=self.known), -1).to_numpy()
        at, weight = np.concatenate(at)[term >= 0], np.concatenate(weight)[term >= 0]
        key = term[term >= 0].astype(np.int64) * n + at
        order = np.lexsort((-weight, key))
        key, weight = key[order], weight[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
        key, weight = key[first], weight[first]
        return np.searchsorted(key, np.arange(len(self.known) + 1) * n), key % n, weight

    def score(self) -> None:
        if not self.held:
            return
        ids = np.concatenate([i for i, _ in self.held])
        starts, at, weight = self._postings()
        self.held = []
        for q, terms in enumerate(self.asked):
            spans = [slice(starts[t], starts[t + 1]) for t in terms if starts[t] < starts[t + 1]]
            if not spans:
                continue
            d, w = np.concatenate([at[s] for s in spans]), np.concatenate([weight[s] for s in spans])
            if len(d) * 8 < len(ids):
                d, place = np.unique(d, return_inverse=True)
                s = np.bincount(place, w)
            else:
                s = np.bincount(d, w, len(ids))
                d = np.flatnonzero(s)
                s = s[d]
            s = np.round(np.minimum(s / (0.5 * self.totals[q]), 1.0), 9)
            had, its = self.best[q]
            if len(had) == self.k:  # later ids lose a tie
                d, s = d[s > had[-1]], s[s > had[-1]]
            if len(d):
                s, i = np.concatenate((had, s)), np.concatenate((its, ids[d]))
                order = np.argsort(-s, kind="stable")[: self.k]
                self.best[q] = s[order], i[order]

    def found(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        self.score()
        for a in range(0, len(self.names) if self.asked else 0, 1000):
            some = self.best[a : a + 1000]
            names = np.repeat(np.arange(a, a + len(some)), [len(s) for s, _ in some])
            yield pa.RecordBatch.from_arrays([pa.array([self.names[i] for i in names], kind), pa.array(np.concatenate([i for _, i in some])), pa.array(np.concatenate([s for s, _ in some]))], ["question", "id", "score"])


def keyword_top(items: DataFrame, id_: str, fields: list[tuple[Column, float]], questions: DataFrame, k: int) -> DataFrame:
    """(question, id, score), the k best items of each of questions(question, terms), ties by id (long).

    An item scores its best field (an array of words, and its weight) for each different term; the sum over half the
    number of terms, at most 1, rounded to nine digits. There is no row for a pair: items are dealt once to a number of
    lanes that does not grow with them, a lane takes them in order of id, block by block, adds up the postings of each
    question's terms, and keeps k items a question. Questions beyond ASKED have lanes of their own.
    """
    spark = items.sparkSession
    ship(spark)
    lanes = 2 * spark.sparkContext.defaultParallelism
    parts = max(-(-questions.count() // ASKED), 1)
    kind, weights = dict(questions.dtypes)["question"], [w for _, w in fields]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    unit = (F.col("_part") * lanes + F.col("_lane")).cast("int").alias("unit")
    names = [f"f{i}" for i in range(len(fields))]
    none = [F.lit(None).cast("array<string>").alias(n) for n in names[1:]]
    # Of an item the id and its fields, of a question the terms, which come first.
    asking = questions.select("question", F.col("terms").alias("f0"), F.pmod(F.xxhash64("question"), F.lit(parts)).alias("_part")).withColumn("_lane", every(lanes)).select(unit, F.lit(None).cast("long").alias("id"), "question", "f0", *none)
    rows = items.select(F.col(id_).cast("long").alias("id"), *(F.array_distinct(c).alias(n) for n, (c, _) in zip(names, fields))).withColumn("_lane", F.pmod(F.xxhash64("id"), F.lit(lanes))).withColumn("_part", every(parts))
    both = asking.unionByName(rows.filter("id IS NOT NULL").select(unit, "id", F.lit(None).cast(kind).alias("question"), *names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, last = _Lane(weights, k), (None, True)
        for b in batches:
            units, asks = b.column(0).to_numpy(), b.column(1).is_null().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate(([True], (units[1:] != units[:-1]) | (asks[1:] != asks[:-1]))))[: len(units)]
            for x, y in zip(starts, [*starts[1:], len(units)]):
                part, now = b.slice(x, y - x), (units[x], asks[x])
                if now[1] and now != last:
                    if not last[1]:
                        yield from lane.found(part.schema.field(2).type)
                    lane = _Lane(weights, k)
                if now[1]:
                    lane.ask(part.column(2).to_pylist(), part.column(3).to_pylist())
                elif lane.names:
                    if now != last:
                        lane.ready()
                    lane.add(part.column(1), part.columns[3:])
                last = now
        if not last[1]:
            yield from lane.found(b.schema.field(2).type)

    dealt = both.repartitionById(lanes * parts, F.col("unit")).sortWithinPartitions("unit", F.col("id").asc_nulls_first())
    found = dealt.mapInArrow(run, f"question {kind}, id long, score double")
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))
    return found.withColumn("_n", place).filter(F.col("_n") <= k).drop("_n")


def over_fetch(k: int) -> tuple[int, int, int]:
    """For k results: vector hits and keyword hits to fetch, and rows that keyword search may score. The factors and bounds are fixed values."""
    keyword = max(10 * k, 50)
    return min(max(4 * k, 50), 600), keyword, min(max(20 * keyword, 500), 1000)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double; 0 if lengths differ or one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0)))


def vector_top_k(vectors: DataFrame, column: str, query: list[float], k: int, tie: str, least: float | None = None) -> DataFrame:
    """The k rows nearest to one query vector by cosine."""
    scored = vectors.withColumn("score", cosine(F.col(column), F.array(*(F.lit(float(x)) for x in query))))
    if least is not None:
        scored = scored.filter(~F.isnan("score") & (F.col("score") >= least))
    return scored.orderBy(F.desc("score"), tie).limit(k)


def hybrid(vector: DataFrame, keyword: DataFrame, id_: str) -> DataFrame:
    """Full outer merge of vector (id, score) and keyword (id, score) hits: fused score and which branch found it."""
    v = vector.select(id_, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("v"))
    k = keyword.select(id_, F.col("score").alias("k"))
    weak = KEYWORD_SHARE * F.col("k")
    both = F.least(F.greatest(F.col("v"), weak) + BONUS * F.least("v", "k"), F.lit(1.0))
    out = v.join(k, id_, "full_outer")
    return out.select(id_, F.when(F.col("k").isNull(), F.col("v")).when(F.col("v").isNull(), weak).otherwise(both).alias("score"), F.when(F.col("k").isNull(), "vector").when(F.col("v").isNull(), "keyword").otherwise("hybrid").alias("branch"), F.coalesce("v", F.lit(0.0)).alias("vector"))


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(key, score) of the documents with a term; statistics over all documents. Texts are split once: lengths and term
    counts are written and read again for the statistics and for the scores."""
    split = docs.select(key, bilingual_tokens(F.col(text)).alias("_w"))
    counts = written(split.select(key, F.size("_w").alias("len"), *(F.size(F.filter("_w", _is(t))).alias(f"tf{i}") for i, t in enumerate(terms))), "counts")
    about = counts.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return counts.join(F.broadcast(about)).filter(reduce(lambda x, y: x | y, (F.col(f"tf{i}") > 0 for i in range(len(terms))))).select(key, score.alias("score"))


def _is(term: str):
    return lambda x: x == F.lit(term)


def min_max(df: DataFrame, column: str, name: str) -> DataFrame:
    """Scaled to 0..1 over all rows; of equal values 1 if they are positive, else 0."""
    about = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    c = F.col(column)
    scaled = F.when(F.col("_hi") > F.col("_lo"), (c - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).when(c > 0, 1.0).otherwise(0.0)
    return df.join(F.broadcast(about)).withColumn(name, scaled).drop("_lo", "_hi")


def char_grams(df: DataFrame, key: str, text: str, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(key, gram, weight): counts of character grams of the padded lower-case text, of unit length per key."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    listed = F.flatten(F.array(*(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), _cutter(padded, n)) for n in sizes)))
    counts = df.select(key, F.explode(listed).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("n"))
    norm = Window.partitionBy(key)
    return counts.withColumn("weight", F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(norm))).drop("n")


def _cutter(c: Column, n: int):
    return lambda i: F.substring(c, i, F.lit(n))


def citations(df: DataFrame, key: str, answer: str, n_sources: int) -> DataFrame:
    """Numbers cited as [1] or [1, 2]: cited within 1..n_sources, out of range, not cited, and a status."""
    marks = F.regexp_extract_all(answer, F.lit(r"\[([0-9]+(?:\s*,\s*[0-9]+)*)\]"), F.lit(1))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(marks, lambda m: F.transform(F.split(m, ","), lambda x: F.trim(x).cast("int"))))))
    good, bad = F.filter(numbers, lambda x: (x >= 1) & (x <= n_sources)), F.filter(numbers, lambda x: (x < 1) | (x > n_sources))
    missing = F.array_except(F.sequence(F.lit(1), F.lit(n_sources)), good)
    status = F.when(F.size(bad) > 0, "out_of_range").when(F.size(good) == 0, "none").otherwise("ok")
    return df.select(key, good.alias("cited"), bad.alias("out_of_range"), missing.alias("uncited"), status.alias("status"))


def retention(judged: DataFrame, column: str) -> DataFrame:
    return judged.agg(ratio(F.count_if(F.col(column)), F.count("*")).alias("rate"))


def agreed(vector: DataFrame, keyword: DataFrame, stored: DataFrame, id_: str) -> DataFrame:
    """(id, content) of hits of vector(id, v) and keyword(id, k): the keyword branch's content id wins, and must be the
    one that stored(id, stored) has."""
    both = vector.join(keyword, id_, "full_outer").withColumn("content", F.coalesce("k", "v"))
    return both.join(stored, id_).filter("content = stored").select(id_, "content")


def device_gate(items: DataFrame, device: str, guide: str, questions: DataFrame, id_: str, question: str) -> DataFrame:
    """(question's id, item columns): for each of a stated set of questions all items, but of guides only those of the
    devices that it names, if it names any. Devices are a short list of names, and so are those that questions name."""
    names = [r[0] for r in items.select(device).distinct().toLocalIterator()]
    named = F.filter(F.array(*(F.when(matches_term(F.col(question), n), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    asked = questions.select(id_, named.alias("_named"))
    return items.join(F.broadcast(asked)).filter(~F.col(guide) | (F.size("_named") == 0) | F.array_contains("_named", F.col(device))).drop("_named")


def gated(items: DataFrame, item: str, device: str, guide: str, questions: DataFrame, id_: str, question: str) -> DataFrame:
    """(question, item): what each question may see, without a row for every pair. A row without a question is an item
    that all questions see (no guide, or one of no device); a row without an item is a question that names no device
    and sees all; the rest are the guides of the devices that a question names."""
    open_ = items.filter(~F.coalesce(F.col(guide), F.lit(False)) | F.col(device).isNull()).select(F.lit(None).cast(dict(questions.dtypes)[id_]).alias("question"), F.col(item).alias("item"))
    guides = items.filter(F.col(guide) & F.col(device).isNotNull()).select(F.col(device).alias("_device"), F.col(item).alias("item"))
    named = written(named_in(questions, id_, question, items.filter(F.col(device).isNotNull()).select(F.col(device).alias("_device")), "_device"), "named")
    free = questions.select(id_).join(named.select(id_), id_, "left_anti").select(F.col(id_).alias("question"), F.lit(None).cast(dict(items.dtypes)[item]).alias("item"))
    # Devices may be few, and their rows make many pairs: guides are dealt into blocks, which each question's rows meet.
    blocks = tasks(items.sparkSession)
    every = named.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    dealt = guides.withColumn("_block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    met = spread(every, "_device", "_block").hint("merge").join(spread(dealt, "_device", "_block"), ["_device", "_block"])
    return open_.unionByName(free).unionByName(met.select(F.col(id_).alias("question"), "item"))
