"""Operator 1, toxicity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w.x - theta_k): one weight for each sparse feature, shared by all thresholds theta_0 <= theta_1
<= theta_2. x marks which words, and which beginnings of words, a text holds. Grades are 0 (clean) and 1 to 3. Labels
say only toxic or not, so a toxic row's grade is set from how many different marker words it holds (words that nearly
only toxic rows have), cut at the thirds of the toxic rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import cut, filter_batches, map_batches, prepare, table, text_or_empty

#: Labelled rows a fit takes at most (those of least xxhash64(doc_id)), features it keeps, and toxic rows a feature needs.
TRAIN_ROWS, FEATURES, LEAST_ROWS = 20_000, 4096, 3
#: Lengths of the beginnings of words that are features besides whole words.
STARTS = (4, 5, 6)
GRADES = 4
#: A row is rejected from this P(grade > 0) on.
REJECT = 0.5
STEPS, RATE, RIDGE = 400, 0.1, 3e-6
#: A feature's share of toxic rows is at least this many times that of all rows, or half-way from that to 1 if this is less.
LIFT = 2
STRIP = ".,!?;:*%$&#|\"'()[]{}<>=+-_/\\~`^@"
#: Tokens whose features a worker remembers.
KNOWN = 300_000


def features_of(token: str) -> tuple[str, ...]:
    """A token's features: the word, folded and stripped of punctuation, and its beginnings."""
    word = token.strip(STRIP).lower()
    return (word, *(f"{word[:n]}*" for n in STARTS if len(word) > n)) if word else ()


class Model:
    """Weights by feature, thresholds, and scores of texts."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, thresholds
        self.known: dict[str, tuple[str, ...]] = {}

    def __getstate__(self):
        return self.weights, self.thresholds

    def __setstate__(self, state):
        self.__init__(*state)

    def present(self, text: str | None) -> set[str]:
        if len(self.known) > KNOWN:
            self.known.clear()
        known, found = self.known, set()
        for t in set((text or "").split()):
            got = known.get(t)
            if got is None:
                got = known[t] = tuple(f for f in features_of(t) if f in self.weights)
            if got:
                found.update(got)
        return found

    def exceed(self, text: str | None) -> list[float]:
        """P(grade > k) for each threshold."""
        z = sum(map(self.weights.__getitem__, self.present(text)))
        return [1 / (1 + np.exp(min(max(t - z, -700), 700))) for t in self.thresholds]


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest likelihood with a ridge, by Adam over all rows. rows: indices of features present."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    w = np.zeros(n_features)
    # theta_0 and the logs of the steps to the next thresholds, so that these stay in order.
    u = np.array([0.0, 0.0, 0.0])
    m, v = np.zeros(n_features + 3), np.zeros(n_features + 3)
    n = max(len(rows), 1)
    for step in range(1, STEPS + 1):
        theta = u[0] + np.concatenate(([0.0], np.cumsum(np.exp(u[1:]))))
        z = np.bincount(at, w[col], len(rows))
        p = 1 / (1 + np.exp(np.clip(theta[:, None] - z, -60, 60)))  # P(grade > k), k = 0..2
        bound = np.vstack([np.ones(len(rows)), p, np.zeros(len(rows))])
        slope = bound * (1 - bound)
        pick = np.arange(len(rows))
        here, after = bound[grades, pick], bound[grades + 1, pick]
        chance = np.maximum(here - after, 1e-12)
        g = (slope[grades, pick] - slope[grades + 1, pick]) / chance / n  # d log-likelihood / dz
        gw = np.bincount(col, g[at], n_features) - RIDGE * w
        gt = np.zeros(3)
        for k in range(3):
            gt[k] = (-(slope[k + 1] / chance)[grades == k + 1].sum() + (slope[k + 1] / chance)[grades == k].sum()) / n
        gu = np.concatenate(([gt.sum()], [gt[1:].sum() * np.exp(u[1]), gt[2] * np.exp(u[2])]))
        grad = np.concatenate((gw, gu))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w += move[:n_features]
        u += move[n_features:]
    return w, u[0] + np.concatenate(([0.0], np.cumsum(np.exp(u[1:]))))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from labels(doc_id, toxic) and docs(doc_id, text), from at most train_rows labelled rows.

    Labels with nulls are left out. Without toxic labels the model accepts everything.
    """
    prepare(docs.sparkSession)
    some = labels.select("doc_id", "toxic").dropna().withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "toxic").limit(train_rows)
    sample = cut(docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(some), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic")))

    def count(cols: dict[str, list]) -> dict[str, list]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        known: dict[str, tuple] = {}
        for text, toxic in zip(cols["text"], cols["toxic"]):
            here: set[str] = set()
            for t in set(text.split()):
                got = known.get(t)
                if got is None:
                    got = known[t] = features_of(t)
                here.update(got)
            seen[toxic].update(here)
        names = list(seen[0] | seen[1])
        return {"feature": names, "toxic": [seen[1][f] for f in names], "clean": [seen[0][f] for f in names]}

    totals = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not totals["t"] or totals["t"] == totals["n"]:
        return Model({}, [700.0] * 3)
    share = totals["t"] / totals["n"]
    counted = map_batches(sample, count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.col("toxic") >= LEAST_ROWS)
    n = F.col("toxic") + F.col("clean")
    excess = (F.col("toxic") - share * n) / F.sqrt(share * (1 - share) * n)
    best = counted.withColumn("excess", excess).filter((F.col("excess") > 3) & (F.col("toxic") >= min(LIFT * share, (1 + share) / 2) * n)).orderBy(F.desc("excess"), "feature").limit(FEATURES).collect()
    if not best:
        return Model({}, [700.0] * 3)
    index = {r["feature"]: i for i, r in enumerate(best)}
    marks = {r["feature"] for r in best if "*" not in r["feature"] and r["toxic"] >= 0.9 * (r["toxic"] + r["clean"])}
    finder = Model(dict.fromkeys(index, 0.0), [0.0])

    def found(cols: dict[str, list]) -> dict[str, list]:
        present = [finder.present(t) for t in cols["text"]]
        return {"x": [sorted(map(index.__getitem__, p)) for p in present], "marks": [len(p & marks) for p in present], "toxic": cols["toxic"]}

    rows = map_batches(sample, found, "x array<int>, marks int, toxic int").groupBy("x", "marks", "toxic").count().collect()
    # Equal rows of the sample come once, with their number.
    x, g = [], []
    toxic = np.repeat([r["marks"] for r in rows if r["toxic"]], [r["count"] for r in rows if r["toxic"]])
    third = np.quantile(toxic, [1 / 3, 2 / 3])
    for r in rows:
        grade = 1 + int(r["marks"] > third[0]) + int(r["marks"] > third[1]) if r["toxic"] else 0
        x += [np.array(r["x"], np.int64)] * r["count"]
        g += [grade] * r["count"]
    w, theta = fit_ordinal(x, np.array(g), len(index))
    return Model({f: float(w[i]) for f, i in index.items()}, [float(t) for t in theta])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """For each row of docs(doc_id, text): expected_severity (0 to 3), p_toxic, grade (the likeliest), toxic.

    Null and empty texts have no features and the severity that the thresholds alone give; repeated rows give a row
    each; an empty table gives none; other columns, whatever their names, are ignored.
    """
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def fn(cols: dict[str, list]) -> dict[str, list]:
        p = [model.exceed(t) for t in cols["text"]]
        chances = [np.diff([-1.0, *(-x for x in q), 0.0]) for q in p]
        return {"doc_id": cols["doc_id"], "expected_severity": [float(sum(q)) for q in p], "p_toxic": [float(q[0]) for q in p], "grade": [int(np.argmax(c)) for c in chances], "toxic": [bool(q[0] >= REJECT) for q in p]}

    return map_batches(docs.select("doc_id", "text"), fn, f"doc_id {kind}, expected_severity double, p_toxic double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model rejects; columns unchanged, whatever their names.

    Null and empty texts have no features and are judged by the thresholds alone, which a model of mostly clean labels
    keeps; repeated rows are judged alike; an empty table gives no rows; texts of any length are read whole.
    """
    prepare(docs.sparkSession)
    return filter_batches(docs, lambda cols: [bool(model.exceed(t)[0] < REJECT) for t in cols["text"]])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score of all documents by a model fitted on a bounded sample of labelled ones; edge cases as there."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
