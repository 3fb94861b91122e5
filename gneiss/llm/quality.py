"""Operator 6, quality scores: random Fourier features, ridge from partition-summed normal equations, isotonic calibration.

Inputs of a score are statistics of the text alone. cos(Wx + b) with Gaussian W approximates a Gaussian kernel over
them. Each partition of the training rows sums its share of the normal equations; the ridge solution is calibrated by
pool-adjacent-violators on rows that the ridge was not fitted on.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import cut, lean, map_batches, prepare, table

FOLDS = 5
#: Of the folds a fit may use, the one whose rows calibrate.
CALIBRATION_FOLD = 1
WAVES, RIDGE, SEED = 160, 1e-2, 20240101
#: Labelled rows that a fit takes at most (those of least xxhash64(doc_id)), and the partitions that sum them.
TRAIN_ROWS, SUMS = 200_000, 16
#: Steps of the raw score whose label sums the calibration keeps.
STEPS = 2000
PREDICT = 0.3

_CLASS = np.zeros((256, 6))
_CLASS[65:91, 0] = 1  # upper case
_CLASS[97:123, 1] = 1  # lower case
_CLASS[48:58, 2] = 1  # digits
_CLASS[[9, 10, 11, 12, 13, 32], 3] = 1  # white space
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()], 4] = 1  # punctuation
_CLASS[[ord(c) for c in "*#$%&|!<>{}[]\\^~=+_"], 5] = 1  # signs that prose seldom has
STATS = 14


def statistics(text: bytes | None) -> list[float]:
    """Statistics of one text; an empty one has zeros."""
    words = text.split() if text else []
    if not words:
        return [0.0] * STATS
    n, k = len(text), len(words)
    upper, lower, digit, space, punct, odd = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS / n).tolist()
    seen = Counter(words)
    lines = text.split(b"\n")
    twice = sum(1 for a, b in zip(words, words[1:]) if a == b) / k
    return [
        math.log1p(k), math.log1p(n / k), upper / (upper + lower + 1e-9), digit, space, punct, odd,
        len(seen) / k, len(seen) / math.sqrt(k), max(seen.values()) / k, twice, 1 - len(set(lines)) / len(lines),
        math.log1p(k / len(lines)), sum(1 for w in words if w[-1:] in b".!?") / k,
    ]


class Model:
    def __init__(self, mean, scale, waves, phases, beta, knots, values):
        self.mean, self.scale, self.waves, self.phases, self.beta, self.knots, self.values = mean, scale, waves, phases, beta, knots, values

    def raw(self, x: np.ndarray) -> np.ndarray:
        return lifted(x, self.mean, self.scale, self.waves, self.phases) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def lifted(x, mean, scale, waves, phases) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    return np.hstack([np.sqrt(2 / len(phases)) * np.cos(z @ waves + phases), np.ones((len(x), 1))])


def isotonic(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Means of sums/weights, pooled where they would fall (pool-adjacent-violators); one value for each entry."""
    blocks: list[list[float]] = []
    for w, s in zip(weights.tolist(), sums.tolist()):
        blocks.append([w, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, s2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + s2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), s / w) for w, s, n in blocks]) if blocks else np.zeros(0)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as ""."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def document_statistics(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    fn = lambda cols: {"doc_id": cols["doc_id"], "x": [statistics(t) for t in cols["text"]]}
    return map_batches(docs.select("doc_id", F.col("text").cast("binary").alias("text")), fn, f"doc_id {kind}, x array<float>")


def fit(stats: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from stats(doc_id, x) and labels(doc_id, quality); fold 0 takes no part, one fold only calibrates.

    Labels with nulls are left out; repeated labels count each. Without labels of both kinds every score is their mean
    (0.5 if there are none).
    """
    some = labels.select("doc_id", "quality").dropna().filter(fold_of(F.col("doc_id")) != 0).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "quality").limit(train_rows)
    rows = cut(stats.join(F.broadcast(some) if train_rows <= TRAIN_ROWS else some, "doc_id").select("x", (F.col("quality") > 0).cast("int").alias("y"), fold_of(F.col("doc_id")).alias("fold")).repartition(SUMS))
    d, rng = STATS, np.random.default_rng(SEED)
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y"), *(f(F.element_at("x", i + 1)).alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not about["n"] or about["y"] in (0, about["n"]):
        flat = about["y"] / about["n"] if about["n"] else 0.5
        return Model(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(2), np.array([0.0, 1.0]), np.array([flat, flat]))
    mean, scale = np.array([about[f"m{i}"] for i in range(d)]), np.array([max(about[f"s{i}"], 1e-3) for i in range(d)])
    # Two kernel widths, as statistics matter both broadly and in their details.
    waves = rng.standard_normal((d, WAVES)) * np.where(np.arange(WAVES) % 2, 0.15, 0.4)
    phases = rng.uniform(0, 2 * np.pi, WAVES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WAVES + 1, WAVES + 2))
        for b in batches:
            x, y = np.array(b.column(0).to_pylist(), float).reshape(-1, d), np.array(b.column(1).to_pylist(), float)
            a = lifted(x, mean, scale, waves, phases)
            total += np.hstack([a.T @ a, (a.T @ y)[:, None]])
        yield pa.RecordBatch.from_pydict({"s": pa.array([total.tobytes()], pa.binary())})

    parts = rows.filter(F.col("fold") != CALIBRATION_FOLD).select("x", "y").mapInArrow(lean(sums), "s binary").collect()
    total = sum(np.frombuffer(bytes(r["s"])).reshape(WAVES + 1, WAVES + 2) for r in parts)
    beta = np.linalg.solve(total[:, :-1] + RIDGE * np.eye(WAVES + 1), total[:, -1])
    model = Model(mean, scale, waves, phases, beta, None, None)

    def stepped(cols: dict[str, list]) -> dict[str, list]:
        raw = model.raw(np.array(cols["x"], float).reshape(-1, d))
        return {"step": np.clip(np.round(raw * STEPS), -STEPS, 2 * STEPS).astype(int).tolist(), "y": cols["y"]}

    held = map_batches(rows.filter(F.col("fold") == CALIBRATION_FOLD).select("x", "y"), stepped, "step int, y int").groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).orderBy("step").collect()
    if not held:
        return Model(mean, scale, waves, phases, beta, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    w, s = np.array([r["n"] for r in held], float), np.array([r["y"] for r in held], float)
    # Between pooled values scores rise with the raw score by a hair, so that ranks stay.
    knots = np.array([r["step"] for r in held]) / STEPS
    model.knots, model.values = knots, 0.998 * isotonic(w, s) + 0.002 * (knots + 1) / 3
    return model


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every row of documents: doc_id, held_out, score, predicted.

    Null and empty texts are scored from zero statistics; repeated rows give a row each; an empty table gives none.
    """
    stats = cut(document_statistics(table(spark, sf_dir, "documents")))
    model = fit(stats, table(spark, sf_dir, "labels"))
    kind = dict(stats.dtypes)["doc_id"]

    def fn(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "score": model.score(np.array(cols["x"], float).reshape(-1, STATS)).tolist()}

    scored = map_batches(stats, fn, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
