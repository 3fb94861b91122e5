import random
import re
from itertools import permutations

import pytest

from gneiss.llm import audit as au

WORD = re.compile("[^\x20\x09-\x0d]+")


def fails(rows):
    """Flags A to E of (doc_id, text, lang) rows, from the definition."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        out.append((len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t]))
    return out


def brute(parts, flags, lost, letters="ABCDE"):
    """{(part, order, step): counts}, by putting every row through every order."""
    out = {}
    for p in set(parts):
        mine = [(f, x) for q, f, x in zip(parts, flags, lost) if q == p]
        by_letter = dict.fromkeys(letters, 0)
        for order in permutations(letters):
            at = [letters.index(x) for x in order]
            first = [next((k for k, i in enumerate(at, 1) if f[i]), 99) for f, _ in mine]
            for k, x in enumerate(order, 1):
                i = letters.index(x)
                removed = [m for m, s in zip(mine, first) if s == k]
                by_letter[x] += len(removed)
                out[p, "".join(order), k] = [sum(s > k for s in first), len(removed), sum(s < k and f[i] for (f, _), s in zip(mine, first)), sum(f[i] and sum(f) == 1 for f, _ in mine), *(sum(x[w] for _, x in removed) for w in range(len(lost[0])))]
        for (q, order, k), v in out.items():
            if q == p:
                v.append(by_letter[order[k - 1]])
    return out


def texts(r, n):
    kinds = [lambda: " ".join(f"w{r.randrange(300)}" for _ in range(r.choice((20, 199, 200, 260)))), lambda: "same few words " * 80, lambda: "LOUD Words " * 120, lambda: " ".join(f"v{k}" for k in range(200)) + " 5%", lambda: "", lambda: None, lambda: "copied text", lambda: "copied text ", lambda: "Xx" * 5]
    return [r.choice(kinds)() for _ in range(n)]


def check(got, want):
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got} == want


def test_query_equal_to_brute_force(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, t, r.choice(("en", "de", None, ""))) for i, t in enumerate(texts(r, 150))]
    rows += [(3, rows[3][1], "en"), (3, rows[3][1], "fr"), (None, "copied text", "en"), (None, None, None), (200, "solo", "zz")]
    labels = [(i, r.randrange(2), r.randrange(2)) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (7777, 1, 1), (9, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    known = {}
    for i, q, x in labels:
        if i is not None:
            a = known.get(i, (0, 0))
            known[i] = (max(a[0], q or 0), max(a[1], x or 0))
    got = au.op13_filter_audit(spark, str(tmp_path)).collect()
    check(got, brute([p or "" for _, _, p in rows], fails(rows), [known.get(i, (0, 0)) for i, _, _ in rows]))
    assert len(got) == 600 * 5


def test_hot_text_and_ties(spark):
    """Copies of one text are a third of the rows, and more than a thousand other texts are held twice."""
    rows = [(i, "hot copy" if i % 3 == 0 else f"pair {i % 1300}", "en") for i in range(4000)]
    flagged = au.failures(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert sorted((r["doc_id"], r["E"]) for r in flagged.collect()) == [(i, f[4]) for (i, _, _), f in zip(rows, fails(rows))]


def test_two_filters_and_the_total(spark):
    flags = [("x", True, None), ("x", True, True), ("y", False, True), (None, None, None), ("y", True, True)]
    df = spark.createDataFrame([(*f, 7) for f in flags], "part string, P boolean, Q boolean, n long")
    rows = {(r["part"], r["filter_order"], r["step"]): r for r in au.audit(df, "PQ", total=True).collect()}
    clean = [(bool(p), bool(q)) for _, p, q in flags]
    for parts in (["*"] * 5, [f[0] or "" for f in flags]):
        for (p, order, k), v in brute(parts, clean, [()] * 5, "PQ").items():
            r = rows[None if p == "*" else p, order, k]
            assert [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "shapley")] == v
    assert len(rows) == 4 * 4


def test_steps_and_bad_filters(spark):
    assert au.steps(spark, "ABC").count() == 18
    for bad in ("", "AA", "ABCDEFG"):
        with pytest.raises(ValueError):
            au.audit(spark.createDataFrame([], "part string"), bad)


def test_empty_table(spark):
    docs, labels = (spark.createDataFrame([], s) for s in ("doc_id long, text string, lang string, hash long, n long, part long, first long, E long", "doc_id long, quality int, toxic int"))
    assert au.audit(au.failures(docs, labels), "ABCDE", {"good_lost": "good"}).count() == 0


def test_very_long_text_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(300_000))
    docs = spark.createDataFrame([(1, text, "en", 5, 6, 7, 8), (2, text, "en", 5, 6, 7, 8)], "doc_id long, text string, lang string, A long, part long, hash long, good long")
    labels = spark.createDataFrame([(2, 1, 0, "x")], "doc_id long, quality int, toxic int, part string")
    got = {r["doc_id"]: r for r in au.failures(docs, labels).collect()}
    assert [got[1][x] for x in "ABCDE"] == [False] * 5 and [got[2][x] for x in "ABCDE"] == [False] * 4 + [True] and got[2]["good"] == 1
