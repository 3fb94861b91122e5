"""Checks, replays, ingest runs and element packing against plain loops and planted cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gneiss.functions import dialogue
from gneiss.operators import checks, packing


def test_intents_and_questions(spark):
    cases = {"Hello!!": "greeting", "hi hey": "greeting", "你好啊": "greeting", "Thank you.": "thanks", "OK": "acknowledgement", "ｏｋ": "acknowledgement", "再见": "goodbye", "What can you do?": "capabilities", "hi, what is it": None, "": None, None: None, "okay then": None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "a string, b string")
    assert all(r[0] == r[1] for r in df.select(dialogue.intent(F.col("a")), "b").collect())
    alone = {"Mini 4 weight?": True, "is it heavy": False, "item weight": True, "A versus B": False, "x" * 41: False, " ": False, None: False, "它多重": False}
    df = spark.createDataFrame([(k, v) for k, v in alone.items()], "a string, b boolean")
    assert all(r[0] == r[1] for r in df.select(dialogue.stands_alone(F.col("a")), "b").collect())


def test_answer_problems(spark):
    answers = spark.createDataFrame([(1, "up 20 m [1] for 5≤X＜7 [3]", 2), (2, "", 2), (3, None, 1)], "key int, answer string, sources int")
    facts = spark.createDataFrame([(1, "climb", [r"20\s*m", "descend"], None), (1, "span", [], "5 <= X < 7"), (2, "climb", ["x"], "a"), (9, "none", ["x"], None)], "key int, fact string, patterns array<string>, range string")
    got = sorted((r["key"], r["kind"], r["fact"] or "", ",".join(r["missing"])) for r in checks.answer_problems(answers, facts).collect())
    assert got == [(1, "invalid_citation", "", ""), (1, "missing_condition", "climb", "descend"), (2, "missing_citations", "", ""), (2, "missing_condition", "climb", "x,range a")]


def test_footnotes(spark):
    rows = [("d", i, "s" if i < 6 else "t", v, n) for i, (v, n) in enumerate([("9 *", []), ("8", ["own"]), ("7 *†", []), ("5", ["* here", " [2] two"]), ("4 [2]", []), ("3", ["† far"]), ("2 †", []), ("1", ["† other"])])]
    df = spark.createDataFrame(rows, "doc string, place int, section string, value string, notes array<string>")
    got = sorted((r["place"], r["owner"], r["note"], r["binding"]) for r in checks.bound_footnotes(df).collect())
    own = [(i, i, n, "own") for _, i, _, _, ns in rows for n in ns]
    assert got == sorted(own + [(0, 3, "* here", "shared marker"), (2, 3, "* here", "shared marker"), (2, 5, "† far", "shared marker"), (6, 7, "† other", "shared marker")])


def test_misses(spark):
    cols = "case string, id int, name string, type string, owner string, mention string"
    gold = spark.createDataFrame([("c", 1, "Lens", "part", "A", "lens"), ("c", 2, "A Cam", "part", "A", "cam"), ("c", 3, "Gone", "part", None, "g"), ("c", 4, "Lost", "part", None, "l"), ("c", 5, "Same", "part", None, "s"), ("c", 6, "Same", "part", None, "s")], cols)
    said = spark.createDataFrame([("c", 11, "lens ", "tool", "A", "lens"), ("c", 12, "B Cam", "part", "B", "CAM"), ("c", 13, "Else", "part", None, "e"), ("c", 14, "same", "part", None, "s")], cols)
    got = sorted(((r["gold"], r["predicted"], r["category"]) for r in checks.misses(gold, said, spark.createDataFrame([("c", "gone")], "case string, name string")).collect()), key=str)
    assert got == sorted([(1, 11, "type"), (2, 12, "owner"), (3, None, "selection"), (4, None, "review"), (6, None, "review"), (None, 13, "review")], key=str)


def test_replays(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    cache = spark.createDataFrame([(sha("a"), "A", sha("A")), (sha("b"), "B", sha("other")), (sha("z"), "Z", sha("Z"))], "key string, response string, digest string")
    asked = spark.createDataFrame([(5, "a"), (3, "b"), (2, "c"), (1, "c"), (4, "b")], "id int, body string")
    out, kept = checks.replayed(cache, asked, F.upper)
    assert sorted(map(tuple, out.collect())) == [(1, "C", False), (2, "C", True), (3, "B", False), (4, "B", True), (5, "A", True)]
    assert sorted((r["response"], r["digest"] == sha(r["response"])) for r in kept.collect()) == [(x, True) for x in "ABCZ"]


@pytest.mark.parametrize("seed", range(3))
def test_ingest_runs(spark, seed):
    r = random.Random(seed)
    rows = [(s, p, i, f"u{r.randrange(25)}", r.random() < 0.5) for s in "abc" for p in range(5) for i in range(r.randrange(1, 7))]
    old = {f"u{i}" for i in range(4)}
    want = []
    for s in "abc":
        seen, won = set(), 0
        for p in range(4):
            if won >= 3:
                break
            for _, _, i, u, works in sorted(x for x in rows if x[0] == s and x[1] == p):
                if won >= 3:
                    break
                outcome = "duplicate" if u in seen or u in old else "success" if works else "failed"
                seen.add(u)
                won += outcome == "success"
                want.append((s, p, i, u, outcome))
    df = spark.createDataFrame(rows, "search string, page int, place int, url string, works boolean")
    got = checks.ingested(df, spark.createDataFrame([(u,) for u in old], "url string"), 3, 4).collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("block", [3, packing.BLOCK])
def test_elements(spark, block):
    r = random.Random(block)
    rows = [(k, i, r.choice((1, 5, 30, 200)), r.random() < 0.2, r.choice(("s", "s", "t", None))) for k in range(6) for i in range(r.randrange(1, 40))]
    want, last = {}, None
    for k, i, n, atomic, section in rows:
        if last and last[0] == k and not atomic and not last[3] and last[2] == section and last[1] + n <= 99:
            last = [k, last[1] + n, section, atomic, last[4]]
        else:
            last = [k, n, section, atomic, last[4] + 1 if last and last[0] == k else 0]
        want[k, i] = last[4]
    df = spark.createDataFrame(rows, "k int, i int, n int, atomic boolean, section string")
    got = packing.packed_elements(df, ["k"], [F.col("i")], ["section"], F.col("atomic"), F.col("n"), 99, block)
    assert {(x["k"], x["i"]): x["part"] for x in got.collect()} == want


def test_extraction_problems(spark):
    chunks = spark.createDataFrame([(1, "The Air  has a lens in\nParis"), (2, "x")], "chunk int, text string")
    entities = spark.createDataFrame([(1, "a", "the air has"), (1, "p", "Paris"), (1, "p", "Paris"), (1, "q", "Rome"), (2, "a", "x")], "chunk int, key string, surface string")
    relations = spark.createDataFrame([(1, "r", "a", "located_in", "p", "lens in Paris"), (1, "s", "a", "located_in", "p", "the Air"), (1, "t", "a", "has", "z", "no such"), (2, "u", "a", "has", "a", "X")], "chunk int, key string, subject string, predicate string, object string, quote string")
    got = sorted(map(tuple, checks.extraction_problems(chunks, entities, relations, ["located_in"]).collect()))
    assert got == [(1, "place not in quote", "s"), (1, "quote not in text", "t"), (1, "repeated key", "p"), (1, "surface not in text", "q"), (1, "unknown end", "t")]
