import random

import numpy as np
import xxhash

from gneiss.llm import alike
from gneiss.llm import simhash as sim


def plain(text):
    fold = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    w = (text or "").encode().translate(fold).split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [plain(t) for _, t in rows]
    a, root = np.array(fps, np.uint64), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            x, y = top(i), top(int(j))
            root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, f"{f:016x}", least.get(top(k))) for k, ((i, _), f) in enumerate(zip(rows, fps))), key=str)


def test_equals_brute_force(make, prose):
    rows = [(i, prose(60 + i % 7, i)) for i in range(60)]
    for i in range(40):  # near copies: one word put in
        w = rows[i % 10][1].split()
        w.insert(i % len(w), f"new{i}")
        rows.append((100 + i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "One"), (204, "one two"), (205, "ONE TWO"), (206, rows[3][1].upper()), (207, rows[3][1]), (207, rows[3][1]), (None, rows[5][1])]
    got = sorted((tuple(r) for r in sim.near_duplicates(make(rows)).collect()), key=str)
    assert got == brute(rows)


def chained(n, r):
    fps, x = [], r.getrandbits(64)
    for _ in range(n):
        fps.append(x)
        for _ in range(r.randrange(1, 4)):
            x ^= 1 << r.randrange(64)
    return fps


def test_links_of_planted_fingerprints(spark):
    r = random.Random(2)
    fps = sorted({*(r.getrandbits(64) for _ in range(3000)), *chained(400, r), *(r.getrandbits(12) for _ in range(300))})
    nodes = spark.createDataFrame([(sim.signed(f),) for f in fps], "fp long")
    rooted = {x["fp"]: x["root"] for x in sim.components(sim.link_fingerprints(nodes)).collect()}
    a = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            if j != i:
                assert rooted[sim.signed(f)] == rooted[sim.signed(fps[j])]
    assert len(set(rooted.values())) > 1


def test_large_buckets_and_every_plan():
    r = random.Random(3)
    fps = np.array(sorted({x ^ (1 << r.randrange(64)) for x in (r.getrandbits(10) for _ in range(6000))} | {r.getrandbits(64) for _ in range(500)}), np.uint64)
    for m in (2, 3, 4):
        groups = sim.correlated_groups(fps, m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        for cost in ([[0, 1, 2, 3, 4]] * m, [[0, 9, 9, 9, 9], *[[0, 1, 1, 1, 1]] * (m - 1)]):
            _, ts = sim.allocate(cost, sim.RADIUS - m + 1)
            assert sum(ts) == sim.RADIUS - m + 1 and min(ts) >= -1
    parts = [(g, 0) for g in sim.correlated_groups(fps, 4)]
    keys, rows, probing = sim.spread(fps, parts)
    o = np.argsort(keys, kind="stable")
    edges = sim.links(keys[o], rows[o], probing[o])
    root = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for x, y in edges:
        root[max(top(x), top(y))] = min(top(x), top(y))
    for i, f in enumerate(fps[::17]):
        for j in fps[(np.bitwise_count(fps ^ f) <= 3)]:
            assert top(sim.signed(int(f))) == top(sim.signed(int(j)))


def test_one_row_of_each_group_stays(make, prose):
    docs = make([(3, prose(50, 1)), (1, prose(50, 1)), (1, prose(50, 1)), (2, prose(50, 2)), (7, None), (8, "")])
    out = alike.drop_near_duplicates(docs)
    assert sorted(out.columns) == sorted(docs.columns)
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 7]
    assert sim.near_duplicates(make([])).count() == 0


def test_a_dense_group_in_one_bucket_and_a_hot_fingerprint(make, prose, monkeypatch):
    """A third of the fingerprints within a few bits of one another, in one bucket; a third of the rows of one text."""
    r = random.Random(5)
    base = r.getrandbits(64)
    fps = np.array(sorted({base ^ sum(1 << b for b in r.sample(range(64), 4)) ^ (1 << r.randrange(64)) for _ in range(6000)}), np.uint64)
    found = list(sim.grown(fps))
    forest, brute_force = sim.Forest(), sim.Forest()
    for a, b in found:
        assert (np.bitwise_count(a ^ b) <= sim.RADIUS).all()
        forest.add(a, b)
    for i in range(len(fps)):
        near = fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= sim.RADIUS]
        brute_force.add(np.full(len(near), fps[i]), near)
    assert len({forest.top(x) for x in fps.tolist()}) == len({brute_force.top(x) for x in fps.tolist()})
    monkeypatch.setattr(sim, "LARGE", 8)
    rows = [(i, prose(40, 0)) for i in range(50)] + [(100 + i, prose(40, i)) for i in range(60)]
    assert sorted((tuple(x) for x in sim.near_duplicates(make(rows)).collect()), key=str) == brute(rows)
