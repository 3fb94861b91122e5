"""Edge cases of single operators."""

import pytest
from pyspark.sql import functions as F

from gneiss.functions import text, urls
from gneiss.operators import aggregates, chunking, filters, graph, incremental, joins, search, windows


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_terms_stand_alone(spark):
    assert column(spark, ["Mini 4", "mini4", "a-mini  4.", None], lambda c: text.matches_term(c, "mini 4")) == [True, False, True, None]
    assert column(spark, ["C++ code", "c"], lambda c: text.matches_term(c, "c++")) == [True, False]


def test_snippets(spark):
    long = "word " * 200 + "needle " + "word " * 200
    a, b, c, d = column(spark, ["  short \n text ", long, "word " * 200, None], lambda x: text.snippet(x, ["needle", "none"]))
    assert a == "short text" and "needle" in b and b.startswith("…") and b.endswith("…") and c.endswith("…") and d is None


def test_urls(spark):
    got = column(spark, ["HTTP://A.com:80", "https://b.org:443/x?q=1#f", "ftp://c/", "https://u@d/", None], urls.canonical)
    assert got == ["http://a.com/", "https://b.org/x?q=1", None, None, None]
    assert column(spark, ["https://v/w?t=5&v=1", "https://v/w#x"], lambda c: urls.at_seconds(c, F.lit(61.9))) == ["https://v/w?v=1&t=61", "https://v/w?t=61"]


def test_slices_at_the_limit(spark):
    df = spark.createDataFrame([(1, "a" * 1200), (2, "a" * 1201), (3, ""), (4, None)], "id int, t string")
    got = sorted((r["id"], r["chunk_index"], r["start_char"], r["end_char"]) for r in chunking.fixed_slices(df, "id", "t", 1200).collect())
    assert got == [(1, 0, 0, 1200), (2, 0, 0, 1200), (2, 1, 1200, 1201)]


def test_article_chunks_cover_the_text(spark):
    texts = ["Lead line\n" + "b" * 2500, "\n\n  Lead", "x" * 1300, "", "\n \n"]
    df = spark.createDataFrame([(i, t, "T") for i, t in enumerate(texts)], "id int, t string, title string")
    got = {}
    for r in chunking.article_chunks(df, "id", "t", "title").orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append(r["body"])
    assert got[3] == ["[empty]"] and got[4][0] == "[empty]"
    assert "".join(got[0][1:]) == "\n" + "b" * 2500 and "".join(got[2][1:]) == "x" * 100


def test_packing(spark):
    df = spark.createDataFrame([(["aa", "bb", "cccccccc", "d", "e"],), ([],)], "p array<string>")
    assert [r[0] for r in df.select(chunking.packed(F.col("p"), 5)).collect()] == [["aa bb", "cccccccc", "d e"], []]


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([-1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(search.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, -1.0]


def test_hybrid_merge(spark):
    v, k = spark.createDataFrame([(1, 0.9), (2, 1.7), (3, -1.0)], "id int, score double"), spark.createDataFrame([(1, 0.5), (4, 1.0)], "id int, score double")
    got = {r["id"]: (round(r["score"], 6), r["branch"]) for r in search.hybrid(v, k, "id").collect()}
    assert got == {1: (0.95, "hybrid"), 2: (1.0, "vector"), 3: (0.0, "vector"), 4: (0.85, "keyword")}


def test_query_terms_weights_and_pruning():
    terms = search.query_terms("What is the MIT License 42?", ["MIT License"])
    assert terms == ["mit license", "mit", "license", "42"]
    w = search.term_weights(terms, ["MIT License"])
    assert w == {"mit license": 3.0, "mit": 1.0, "license": 1.0, "42": 0.05}
    assert "42" not in search.pruned(w) and search.pruned(w, True) == terms


def test_citations(spark):
    df = spark.createDataFrame([(1, "a [1] b [2, 9]"), (2, "none"), (3, "[3]")], "id int, a string")
    got = {r["id"]: (r["cited"], r["out_of_range"], r["uncited"], r["status"]) for r in search.citations(df, "id", "a", 3).collect()}
    assert got == {1: ([1, 2], [9], [3], "out_of_range"), 2: ([], [], [1, 2, 3], "none"), 3: ([3], [], [1, 2], "ok")}


def test_long_chains_have_one_component(spark):
    edges = spark.createDataFrame([(f"n{i:04}", f"n{i + 1:04}") for i in range(300)] + [("z1", "z2"), ("z3", "z3")], "a string, b string")
    got = {r["node"]: r["component"] for r in graph.components(edges, "a", "b").collect()}
    assert {v for k, v in got.items() if k[0] == "n"} == {"n0000"} and got["z2"] == "z1" and "z3" not in got


def test_core_degrees_paths_and_merges(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("c", "d", 4), ("d", "d", 5)], "s string, o string, w long")
    assert {r["node"] for r in graph.k_core(edges, "s", "o", 2).collect()} == {"a", "b", "c"}
    assert {r["node"]: r["degree"] for r in graph.degrees(edges, "s", "o").collect()} == {"a": 2, "b": 2, "c": 3, "d": 2}
    assert graph.shortest(edges, "s", "o", "a", "d").first()["hops"] == 2
    same = spark.createDataFrame([("a", "b")], "x string, y string")
    got = sorted((r["s"], r["o"], r["w"]) for r in graph.merged_edges(edges, "s", "o", same, ["w"]).collect())
    assert got == [("a", "c", 2), ("c", "a", 3), ("c", "d", 4)]


def test_reconcile_and_upsert(spark):
    new, old = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "k int, h string"), spark.createDataFrame([(2, "x"), (3, "c"), (4, None)], "k int, h string")
    assert {r["k"]: r["action"] for r in incremental.reconcile(new, old, ["k"], ["h"]).collect()} == {1: "new", 2: "stale", 3: "obsolete", 4: "same"}
    assert sorted(tuple(r) for r in incremental.upsert(old.filter("k < 4"), new.filter("k < 4"), ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(tuple(r) for r in incremental.upsert(old.filter("k < 4"), new.filter("k < 4"), ["k"], ["h"]).collect()) == [(1, "a"), (2, "x"), (3, "c")]


def test_as_of_and_overlap(spark):
    a, b = spark.createDataFrame([(1, 5, "x"), (1, 1, "y"), (2, 9, "z")], "k int, t int, v string"), spark.createDataFrame([(1, 2, "p"), (1, 5, "q")], "k int, u int, w string")
    got = {r["v"]: r["w"] for r in joins.as_of(a, b, "k", "t", "u", ["w"]).collect()}
    assert got == {"x": "q", "y": None, "z": None}
    s, r = spark.createDataFrame([(1, 0, 10), (1, 20, 21)], "k int, a0 int, a1 int"), spark.createDataFrame([(1, 9, 25), (1, 10, 20)], "k int, b0 int, b1 int")
    pairs = sorted((x["a0"], x["b0"], x["lo"], x["hi"]) for x in joins.overlapping(s, r, "k", ("a0", "a1"), ("b0", "b1"), 4.0).collect())
    assert pairs == [(0, 9, 9, 10), (20, 9, 20, 21)]


def test_windows(spark):
    df = spark.createDataFrame([("a", i, 3) for i in range(3)] + [("b", 9, 1)], "k string, i int, n int")
    assert [(r["k"], r["i"]) for r in windows.round_robin(df, ["k"], [F.col("i")], 3).orderBy("rank").collect()] == [("a", 0), ("b", 9), ("a", 1)]
    assert sorted(r["i"] for r in windows.within_budget(df, ["k"], [F.col("i")], F.col("n"), 6).collect()) == [0, 1, 9]
    seg = spark.createDataFrame([("v", 0.0, 5.0, "aaa"), ("v", 5.0, 9.0, "bbb"), ("v", 9.0, 99.0, "c")], "k string, s double, e double, t string")
    assert [(r["part"], r["t"]) for r in windows.bounded_groups(seg, ["k"], "s", "e", "t", 800, 60.0).orderBy("part").collect()] == [(0, "aaa bbb"), (1, "c")]


def test_filters(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "i int, tags array<string>")
    assert [r["i"] for r in df.filter(filters.contains_all(F.col("tags"), ["b", "a"])).collect()] == [1]
    with pytest.raises(ValueError):
        filters.matching(df, nothing=1)
    assert aggregates.multiset_difference(df.select("i"), df.select("i")).isEmpty()
