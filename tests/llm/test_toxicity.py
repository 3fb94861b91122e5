import numpy as np
import pytest

from gneiss.llm import toxicity as tox


def corpus(prose, n=300):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = prose(30, i).split()
        if bad:
            for k in range(1 + i % 3):
                words.insert(3 * k + 2, ["Grobian,", "flegelhaft", "flegelig"][(i // 4 + k) % 3])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_rows_and_unseen_endings(spark, make, prose):
    rows, labels = corpus(prose)
    lab = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, quality int, toxic int")
    model = tox.fit(make(rows), lab)
    assert model.thresholds == sorted(model.thresholds)
    got = {r["doc_id"]: r for r in tox.score(make([*rows, (1000, "flegelnd " + prose(10, 9)), (1001, ""), (1002, None), (1002, None)]), model).collect()}
    wrong = [i for i, _, t in labels if i % 5 == 0 and got[i]["toxic"] != bool(t)]
    assert not wrong
    assert got[1000]["toxic"] and not got[1001]["toxic"] and not got[1002]["toxic"]
    one, three = got[0]["expected_severity"], max(got[i]["expected_severity"] for i, _, t in labels if t)
    assert 0 < one <= three <= 3 and got[1]["expected_severity"] < 0.5


def test_rejected_rows_go_and_columns_stay(spark, make, prose):
    rows, labels = corpus(prose)
    docs = make([*rows, (None, None)])
    model = tox.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = tox.drop_toxic(docs, model)
    assert kept.schema == docs.schema
    ids = {r["doc_id"] for r in kept.collect()}
    assert {i for i, _, t in labels if not t} <= ids and None in ids
    assert len(ids & {i for i, _, t in labels if t}) <= 2


def test_no_labels_rejects_nothing(spark, make):
    docs = make([(1, "a b"), (2, None)])
    for labels in ([], [(None, 1, 1), (1, None, None)], [(1, 1, 0)]):
        model = tox.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert not any(r["toxic"] for r in tox.score(docs, model).collect())
    assert tox.score(make([]), tox.Model({}, [1.0, 2.0, 3.0])).count() == 0


def test_thresholds_share_weights():
    r = np.random.default_rng(1)
    grades = r.integers(0, 4, 600)
    rows = [np.array(sorted({int(g), 4 + int(r.integers(0, 3))})) for g in grades]
    w, theta = tox.fit_ordinal(rows, grades, 7)
    assert w[0] < w[1] < w[2] < w[3] and list(theta) == sorted(theta)


@pytest.mark.parametrize("tenths", [4, 6, 8])
def test_many_or_most_labels_toxic(spark, make, prose, tenths):
    rows, labels = [], []
    for i in range(600):
        bad = i // 5 % 10 < tenths
        rows.append((i, prose(30, i) + (f" {['grobian', 'flegelhaft', 'flegelig'][i % 3]} " + prose(5, 700 + i) if bad else "")))
        labels.append((i, 1, int(bad)))
    model = tox.fit(make(rows), spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["toxic"] for r in tox.score(make(rows), model).collect()}
    assert not [i for i, _, t in labels if i % 5 == 0 and got[i] != bool(t)]


def test_the_fit_is_a_maximum_by_numeric_gradients():
    """The penalised log-likelihood, written out from its definition, has no slope at the fitted weights and thresholds."""
    r = np.random.default_rng(6)
    n, f = 300, 5
    x = (r.random((n, f)) < 0.4).astype(float)
    latent = x @ np.array([2.0, 1.0, 0.0, -1.0, 0.5]) + r.logistic(size=n)
    grades = np.digitize(latent, [0.5, 1.5, 2.5])
    w, theta = tox.fit_ordinal([np.flatnonzero(row) for row in x], grades, f)

    def gain(p):
        z, t = x @ p[:f], p[f:]
        over = np.vstack([np.ones(n), 1 / (1 + np.exp(t[:, None] - z)), np.zeros(n)])
        at = np.arange(n)
        return np.log(over[grades, at] - over[grades + 1, at]).mean() - tox.RIDGE / 2 * (p[:f] ** 2).sum()

    best = np.concatenate((w, theta))
    slope = [(gain(best + h) - gain(best - h)) / 2e-4 for h in 1e-4 * np.eye(f + 3)]
    assert np.abs(slope).max() < 5e-3 and (np.diff(theta) > 0).all()
    assert all(gain(best + 0.2 * r.standard_normal(f + 3)) < gain(best) for _ in range(50))


def test_very_long_text(make):
    model = tox.Model({"bad": 3.0}, [1.0, 2.0, 3.0])
    rows = [(1, "good " * 400_000 + "bad"), (2, "good " * 400_000)]
    got = {x["doc_id"]: x["p_toxic"] for x in tox.score(make(rows), model).collect()}
    assert got[1] > 0.8 > 0.3 > got[2]
