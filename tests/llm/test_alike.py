import random

import numpy as np
import pytest

from gneiss.llm import alike


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def laws(rows, kept):
    """No two rows that stay are alike; every row that goes is alike to one before it, by exact Jaccard likeness."""
    sets = {i: grams(t) for i, t in rows}
    alike_to = lambda i, others: any(9 * len(sets[i] & sets[o]) >= 4 * (len(sets[i]) + len(sets[o])) for o in others)
    for i in sets:
        if i in kept:
            assert not alike_to(i, [o for o in kept if o < i])
        else:
            assert alike_to(i, [o for o in sets if o < i])


def planted(prose):
    r = random.Random(5)
    rows = [(3 * i, prose(120, i)) for i in range(40)]
    for i in range(40):  # one to four changed words: likeness about 0.7 to 0.95
        for c in (1, 2, 3, 4):
            w = rows[i][1].split()
            for p in r.sample(range(len(w)), c):
                w[p] = f"x{r.randrange(10**6)}"
            rows.append((1000 + 4 * i + c, " ".join(w)))
    step = prose(120, 900).split()  # a chain whose ends are not alike
    for i in range(8):
        step[10 * i + 3] = f"y{i}"
        rows.append((2000 + i, " ".join(step)))
    return rows


def greedy(rows):
    """Ids that stay: in order of doc_id, each row that is alike to none that stays."""
    kept, sets = [], {i: grams(t) for i, t in rows}
    for i in sorted(sets):
        if not any(9 * len(sets[i] & sets[o]) >= 4 * (len(sets[i]) + len(sets[o])) for o in kept):
            kept.append(i)
    return kept


def dense(prose):
    """150 near copies of one text, one to four words changed, and a chain of 120 texts, each 6 words further along."""
    r = random.Random(9)
    first = prose(200, 77).split()
    rows = []
    for i in range(150):
        w = list(first)
        for p in r.sample(range(len(w)), r.randrange(1, 5)):
            w[p] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    long = prose(104 + 6 * 120, 78, 5000).split()
    return rows + [(1000 + i, " ".join(long[6 * i : 6 * i + 104])) for i in range(120)]


@pytest.mark.parametrize("large", [2, 16, 1000])
def test_the_greedy_choice_whatever_the_size_of_buckets(make, prose, large):
    rows = [*dense(prose), *((5000 + i, t) for i, t in planted(prose))]
    docs = make(rows)
    got = alike.drop_near_duplicates(docs, large)
    assert got.columns == docs.columns
    want = greedy(rows)
    assert sorted(r["doc_id"] for r in got.collect()) == want
    assert sum(1000 <= i < 2000 for i in want) >= 60


@pytest.mark.parametrize("large", [64, 2])
def test_pairs_from_the_threshold_on_and_only_those(make, prose, large):
    rows = planted(prose)
    got = sorted(r["doc_id"] for r in alike.drop_near_duplicates(make(rows), large).collect())
    laws(rows, set(got))
    assert 41 <= len(got) < len(rows)


def test_prefixes_meet():
    r = np.random.default_rng(1)
    common = np.sort(r.choice(10**6, 50, replace=False)).astype(np.int64)
    for _ in range(300):
        a = np.unique(np.concatenate((r.integers(0, 10**6, 40), r.choice(common, 8)))).astype(np.int64)
        b = np.unique(np.concatenate((a[r.random(len(a)) > 0.12], r.integers(0, 10**6, 3)))).astype(np.int64)
        if 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b)):
            rank = np.arange(50)
            assert len(np.intersect1d(alike.prefix(a, common, rank), alike.prefix(b, common, rank)))


def test_bitmaps_rule_out_no_alike_sets():
    r, out = np.random.default_rng(2), 0
    for n in (1, 3, 40, 70, 500, 3000):
        for _ in range(60):
            a = np.unique(r.integers(-(1 << 63), 1 << 63, n, np.int64))
            b = np.unique(np.concatenate((a[r.random(len(a)) > r.random() * 0.4], r.integers(-(1 << 63), 1 << 63, n // 9, np.int64))))
            same = 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b))
            may = alike.may_be_alike(len(a), len(b), alike.bitmap(a), alike.bitmap(b)) if len(b) else False
            assert may or not same
            out += not may
    assert out > 60


def test_short_and_blank(make):
    rows = [(1, "One"), (2, "one"), (3, "one two"), (4, ""), (5, None), (6, " \n")]
    assert sorted(r["doc_id"] for r in alike.drop_near_duplicates(make(rows)).collect()) == [1, 3, 4]
    assert alike.drop_near_duplicates(make([])).count() == 0
