"""Agreement of relations against a matching by search, and the reranker slot."""

import random
from collections import Counter

import pytest

from gneiss.functions import slots
from gneiss.operators import evaluation


def most_pairs(left, right, fits):
    """Size of a largest one-to-one matching, by augmenting paths."""
    of = {}

    def place(i, seen):
        for j in range(len(right)):
            if j not in seen and fits(left[i], right[j]):
                seen.add(j)
                if j not in of or place(of[j], seen):
                    of[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(left)))


@pytest.mark.parametrize("seed", range(3))
def test_levels_are_largest_matchings(spark, seed):
    r = random.Random(seed)
    rel = lambda: (r.choice("ab"), r.choice(("is", "near")), r.choice("bc"), r.choice(("yes", "no")), r.choice((None, "q")))
    gold = {c: [rel() for _ in range(r.randrange(5))] for c in range(12)}
    said = {(s, c): [rel() for _ in range(r.randrange(6))] for s in ("x", "y") for c in range(14)}
    g = spark.createDataFrame([(c, *x) for c, xs in gold.items() for x in xs], "case int, subject string, predicate string, object string, assertion string, qualifiers string")
    p = spark.createDataFrame([(s, c, *x) for (s, c), xs in said.items() for x in xs], "system string, case int, subject string, predicate string, object string, assertion string, qualifiers string")
    got = Counter()
    for x in evaluation.matches(g, p, ["near"]).collect():
        for n in ("tp", "fp", "fn"):
            got[x["system"], x["case"], x["level"], n] += x[n]
    ends = lambda x: tuple(sorted((x[0], x[2]))) if x[1] == "near" else (x[0], x[2])
    key = {"endpoint_pair": lambda x: sorted((x[0], x[2])), "triple": lambda x: (ends(x), x[1]), "assertion": lambda x: (ends(x), x[1], x[3]), "qualified": lambda x: (ends(x), x[1], x[3], x[4])}
    for (s, c), xs in said.items():
        once = list({key["qualified"](x): x for x in xs}.values())
        for level, k in key.items():
            tp = most_pairs(once, gold.get(c, []), lambda a, b: k(a) == k(b))  # noqa: B023
            assert [got[s, c, level, n] for n in ("tp", "fp", "fn")] == [tp, len(once) - tp, len(gold.get(c, [])) - tp]


def test_reranker(spark):
    df = spark.createDataFrame([("q", "red ring", 1, "blue ring"), ("q", "red ring", 2, "red ring"), ("q", "red ring", 3, None), ("q", "red ring", 4, "blue ring"), ("r", "", 5, "x")], "q string, a string, i int, t string")
    got = sorted((x["q"], x["place"], x["i"]) for x in slots.reranked(df, "q", "a", "i", "t").collect())
    assert got == [("q", 1, 2), ("q", 2, 1), ("q", 3, 4), ("q", 4, 3), ("r", 1, 5)]
    with pytest.raises(Exception, match="scores for"):
        slots.reranked(df, "q", "a", "i", "t", lambda q, d: [0.0]).collect()
