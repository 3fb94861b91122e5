import binascii
import random

import numpy as np
from pyspark.sql import functions as F

from gneiss.llm import quality as q


def test_statistics_of_odd_texts():
    assert q.statistics(None) == q.statistics(b"") == q.statistics(b" \n") == [0.0] * q.STATS
    assert all(np.isfinite(q.statistics(t)).all() for t in (b"x", "日本".encode(), b"A" * 100_000, b"a a a\n\na", bytes(range(256))))


def test_isotonic_pools():
    w, s = np.ones(5), np.array([0.0, 1.0, 0.0, 1.0, 1.0])
    assert q.isotonic(w, s).tolist() == [0.0, 0.5, 0.5, 1.0, 1.0]
    r = np.random.default_rng(1)
    y = q.isotonic(r.integers(1, 9, 200).astype(float), r.random(200))
    assert (np.diff(y) >= 0).all() and len(q.isotonic(np.zeros(0), np.zeros(0))) == 0


def test_summed_normal_equations_equal_one_solve():
    r = np.random.default_rng(2)
    x, y = r.random((300, 4)), r.random(300)
    a = q.lifted(x, x.mean(0), x.std(0), r.standard_normal((4, 10)), r.random(10))
    parts = sum(b.T @ b for b in np.array_split(a, 7))
    assert np.allclose(parts, a.T @ a)
    assert np.allclose(sum(b.T @ c for b, c in zip(np.array_split(a, 7), np.array_split(y, 7))), a.T @ y)


def test_held_out_accuracy(spark, make, prose, monkeypatch, tmp_path):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        t = prose(40 + i % 30, i).capitalize() + "."
        bad = r.random() < 0.3
        if bad:
            t = [t.upper(), " ".join(w + "***" for w in t.split()), " ".join([t.split()[0]] * 60)][i % 3]
        rows.append((i, t))
        labels.append((i, int(not bad), 0))
    rows += [(5000, None), (5001, ""), (5002, "word"), (5000, None)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = q.op6_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth = {i: y for i, y, _ in labels}
    for x in got:
        assert x["held_out"] == (binascii.crc32(str(x["doc_id"]).encode()) % 5 == 0)
        assert 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3)
    held = [x for x in got if x["held_out"] and x["doc_id"] in truth]
    assert sum(x["predicted"] == truth[x["doc_id"]] for x in held) >= 0.95 * len(held) > 100


def test_labels_of_one_kind_or_none(spark, make):
    stats = q.document_statistics(make([(1, "a b"), (2, "c")]))
    for labels, want in (([], 0.5), ([(1, 1), (2, 1)], 1.0)):
        model = q.fit(stats, spark.createDataFrame([(i, y) for i, y in labels], "doc_id long, quality int"))
        assert np.allclose(model.score(np.zeros((2, q.STATS))), want)


def test_fit_equals_one_dense_solve(spark):
    """Weights from sums by partition against a least-squares solve over all training rows at once."""
    r = np.random.default_rng(4)
    rows = [(i, r.standard_normal(q.STATS).astype("float32").tolist()) for i in range(600)]
    labels = [(i, int(x[0] + 0.3 * x[1] > 0)) for i, x in rows]
    stats = spark.createDataFrame(rows, "doc_id long, x array<float>")
    given = spark.createDataFrame(labels, "doc_id long, quality int")
    model = q.fit(stats, given)
    fold = {x["doc_id"]: x["f"] for x in stats.select("doc_id", q.fold_of(F.col("doc_id")).alias("f")).collect()}
    kept = [(x, y) for (i, x), (_, y) in zip(rows, labels) if fold[i] not in (0, q.CALIBRATION_FOLD)]
    a = q.lifted(np.array([x for x, _ in kept], float), model.mean, model.scale, model.waves, model.phases)
    y = np.array([y for _, y in kept], float)
    whole = np.vstack([a, np.sqrt(q.RIDGE) * np.eye(a.shape[1])])
    want = np.linalg.lstsq(whole, np.concatenate((y, np.zeros(a.shape[1]))), rcond=None)[0]
    assert np.allclose(model.beta, want, atol=1e-6)
    scored = model.score(np.array([x for i, x in rows if fold[i] == 0], float))
    truth = np.array([y for (i, y) in labels if fold[i] == 0])
    assert ((scored >= 0.5) == truth).mean() > 0.8


def test_very_long_text(make):
    rows = [(1, "Some words here. " * 100_000), (2, "")]
    got = {x["doc_id"]: x["x"] for x in q.document_statistics(make(rows)).collect()}
    assert len(got[1]) == q.STATS and all(v == v for v in got[1])
