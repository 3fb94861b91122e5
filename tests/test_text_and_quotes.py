"""Unicode keys, newline slices, quotes of every length and ranks, against plain Python."""

import unicodedata

from pyspark.sql import functions as F

from gneiss.functions import text
from gneiss.operators import chunking, joins, windows


def test_fold_of_any_text(spark):
    texts = ["Ｆｕｌｌ　Width", "Straße  ﬁn", "A\tB", "", None, "ÉCOLE"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(text.fold(F.col("t"))).collect()]
    assert got == [None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()) for t in texts]


def test_newline_slices(spark):
    body = "one line\nsecond line of some length\n" + "x" * 50
    rows = chunking.newline_slices(spark.createDataFrame([(1, body), (2, ""), (3, None)], "i int, t string"), ["i"], "t", 20).orderBy("i", "part").collect()
    assert "".join(r["body"] for r in rows) == body and all(len(r["body"]) <= 20 for r in rows) and {r["i"] for r in rows} == {1}


def test_quotes_of_every_length(spark):
    docs = [(1, "alpha beta gamma delta epsilon zeta eta theta iota"), (2, "beta gamma delta"), (3, "nothing here"), (4, None)]
    quotes = [(10, "beta"), (11, "ta gam"), (12, "beta gamma delta"), (13, "lpha beta gamma delta epsilon zeta e"), (14, "absent words of a quote that none has"), (15, "pha beta gam")]
    d, q = spark.createDataFrame(docs, "i int, t string"), spark.createDataFrame(quotes, "k int, quote string")
    got = sorted((r["i"], r["k"]) for r in joins.quoted_in(d, "t", q, "quote").collect())
    assert got == sorted((i, k) for i, t in docs for k, x in quotes if t is not None and x in t)


def test_ranks_with_ties_over_partitions(spark):
    rows = [(i % 7, i) for i in range(200)]
    got = windows.ranked(spark.createDataFrame(rows, "a int, b int").repartition(5), [F.desc("a"), F.col("b")], "place").collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["place"])] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted(r["place"] for r in got) == list(range(1, 201))
