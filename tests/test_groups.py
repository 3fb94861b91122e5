"""Grouped operators against plain definitions."""

import random
from itertools import permutations

from gneiss.functions import slots
from gneiss.operators import groups


def test_matching_is_largest_and_one_to_one(spark):
    r = random.Random(1)
    pairs = {(c, a, b) for c in range(40) for _ in range(r.randrange(1, 9)) for a in [r.randrange(4)] for b in [10 + r.randrange(4)]}
    got = groups.matched(spark.createDataFrame(sorted(pairs), "c int, a int, b int"), "c", "a", "b").collect()
    for c in range(40):
        mine, have = {(a, b) for k, a, b in pairs if k == c}, [(x["a"], x["b"]) for x in got if x["c"] == c]
        assert set(have) <= mine and len({a for a, _ in have}) == len({b for _, b in have}) == len(have)
        assert len(have) == max(sum((a, b) in mine for a, b in zip(range(4), p)) for p in permutations(range(10, 14)))


def test_frames_boxes_and_windows(spark):
    f = spark.createDataFrame([("v", 1, 0), ("v", 2, 255), ("v", 3, 511), ("v", 4, 1)], "v string, t int, code long")
    assert sorted(r["t"] for r in groups.distinct_frames(f, "v", "t", "code").collect()) == [1, 3]
    b = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 4.0), (1, 1.0, 1.0, 5.0, 5.0), (1, 9.0, 9.0, 10.0, 10.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r["x0"], r["x1"]) for r in groups.merged_boxes(b, "page").collect()) == [(0.0, 5.0), (9.0, 10.0)]
    text = "intro " * 20 + "\n```\n" + "code\n" * 30 + "```\n" + "end " * 60
    w = groups.post_windows(spark.createDataFrame([(1, 1, text), (1, 2, ""), (1, 3, None)], "t int, n int, x string"), "t", "n", "x", 200).orderBy("start").collect()
    assert [r["start"] for r in w][0] == 0 and w[-1]["end"] == len(text) and all(a["end"] == z["start"] for a, z in zip(w, w[1:])) and all(r["end"] - r["start"] <= 200 for r in w)
    assert not any(text.index("```") < r["end"] < text.rindex("```") for r in w)


def test_quotes_are_not_cut():
    body = "lead " * 30 + "\n" + "\n".join(f"> quoted line {i}" for i in range(6)) + "\nafter " + "end " * 40
    a, b = body.index("> "), body.index("\nafter")
    assert groups.protected(body) == [(a, b)]
    assert groups.protected("> a\nx\n> b\n```\n> c\n```") == [(0, 3), (6, 9), (10, 21)]


def test_display_part_is_connected(spark):
    e = spark.createDataFrame([("g", f"n{i}", f"n{(i * 7 + 1) % 30}", i) for i in range(30)] + [("g", "x", "y", 99)], "g string, a string, b string, w long")
    got = groups.display_selection(e, "g", "a", "b", "w", 10, 12).collect()
    seen, left = {got[0]["a"]}, [(r["a"], r["b"]) for r in got]
    for _ in got:
        seen |= {x for p in left if set(p) & seen for x in p}
    assert len(seen) == 10 and seen == {x for p in left for x in p} and len(got) <= 12


def test_slots(spark):
    v = slots.hashed_embedding(["a b", "", None, "a b"])
    assert (v[0] == v[3]).all() and not v[1].any() and abs((v[0] ** 2).sum() - 1) < 1e-9
    assert slots.dictionary_terms(["red", "red kite"])(["a Red Kite", "red", None]) == [["red kite"], ["red"], []]
    assert slots.overlap_judge(["a b", "", "x y z"], ["b c", "b", "x"]) == [True, False, False]
