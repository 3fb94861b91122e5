"""Steps whose work outgrew their input: the same results as plain loops, and plans that show what is dealt out."""

from pyspark.sql import functions as F

from gneiss.operators import search


def test_the_best_items_of_each_question_need_no_row_for_a_pair(spark, monkeypatch):
    words = ["red", "blue", "green", "tall", "wide"]
    items = [(i, [words[i % 5]] if i % 3 else None, [words[j] for j in range(5) if (i >> j) & 1]) for i in range(60)]
    asked = [("q", ["red", "green", "wide"]), ("r", ["blue"]), ("s", ["none such"]), ("t", words)]
    monkeypatch.setattr(search, "SCORED", 3)  # lanes take several blocks
    found = search.keyword_top(spark.createDataFrame(items, "id long, a array<string>, b array<string>"), "id", [(F.col("a"), 0.5), (F.col("b"), 0.2)], spark.createDataFrame(asked, "question string, terms array<string>"), 7)
    want = set()
    for q, terms in asked:
        score = {i: round(min(sum(0.5 if w in (a or []) else 0.2 if w in b else 0.0 for w in terms) / (0.5 * len(terms)), 1.0), 9) for i, a, b in items}
        want |= {(q, i, score[i]) for i in sorted((i for i in score if score[i] > 0), key=lambda i: (-score[i], i))[:7]}
    assert {tuple(r) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_no_items_and_no_questions(spark):
    none = spark.createDataFrame([], "id long, a array<string>")
    asked = spark.createDataFrame([("q", ["red"])], "question string, terms array<string>")
    one = spark.createDataFrame([(1, ["red"])], none.schema)
    assert search.keyword_top(none, "id", [(F.col("a"), 0.5)], asked, 2).count() == 0
    assert search.keyword_top(one, "id", [(F.col("a"), 0.5)], asked.limit(0), 2).count() == 0


def test_answers_search_once(spark, sf, monkeypatch):
    from gneiss.plans import answers
    from gneiss.plans.registry import QUERIES

    made, before = [], answers.written
    monkeypatch.setattr(answers, "written", lambda df, name: made.append(name) or before(df, name))
    plan = QUERIES["pl_3c_answers"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert made == ["questions", "evidence", "blocks"]
    assert "MapInArrow" not in plan and "FlatMapGroups" not in plan  # nothing of the search is left to run again


def shuffles(df):
    """The exchanges of a plan before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_pairs_to_match_are_not_dealt_out(spark, sf):
    from gneiss.plans import cases  # noqa: F401
    from gneiss.plans.registry import QUERIES

    found = QUERIES["gr_23_matching"](spark, sf)
    assert shuffles(found) == 2  # the lines' two columns; pairs are made where they are matched


def test_relations_are_dealt_out_once(spark):
    from gneiss.operators import evaluation

    row = "case long, subject string, predicate string, object string, assertion string, qualifiers string"
    gold = spark.createDataFrame([(1, "a", "R", "b", "yes", None), (1, "a", "R", "b", "yes", None), (2, "a", "P", "b", "no", "q")], row)
    said = spark.createDataFrame([("x", 1, "b", "R", "a", "yes", None), ("x", 1, "a", "R", "b", "yes", None), ("x", 2, "b", "P", "a", "no", "q")], "system string, " + row)
    found = evaluation.matches(gold, said, ["R"])
    assert shuffles(found) == 2  # relations by case; the few systems
    got = {(r["case"], r["level"]): (r["tp"], r["fp"], r["fn"]) for r in found.groupBy("case", "level").agg(*(F.sum(c).cast("int").alias(c) for c in ("tp", "fp", "fn"))).collect()}
    assert all(got[1, n] == (1, 0, 1) for n in evaluation.LEVELS)
    assert got[2, "endpoint_pair"] == (1, 0, 0) and all(got[2, n] == (0, 1, 1) for n in evaluation.LEVELS[1:])


def test_batches_are_worked_out_without_texts(spark, monkeypatch):
    from gneiss.operators import packing

    seen, before = [], packing.written
    monkeypatch.setattr(packing, "written", lambda df, name: seen.extend(df.columns) or before(df, name))
    docs = [("s", 1, "ab\r\ncd\x0bef"), ("s", 2, "x" * 23), ("s", 3, None), (None, 4, "\n")]
    got = packing.document_batches(spark.createDataFrame(docs, "k string, i int, b string"), ["k"], "i", "b", 20, 1)
    assert sorted((r["k"] or "", r["batch"], r["i"], r["text"]) for r in got.collect()) == [("", 0, 4, "\n"), ("s", 0, 1, "ab\r\ncd\x0bef"), ("s", 1, 2, "x" * 10), ("s", 2, 2, "xxx"), ("s", 2, 2, "x" * 10)]
    assert not {"_piece", "text", "b"} & set(seen)


def test_chunks_are_cut_once(spark, sf, monkeypatch):
    from gneiss.plans import rules
    from gneiss.plans.registry import QUERIES

    made, before = [], rules.written
    monkeypatch.setattr(rules, "written", lambda df, name: made.append(name) or before(df, name))
    QUERIES["gr_16b_problems"](spark, sf)
    assert made == ["chunks"]


def peeled(edges):
    """{(graph, node): core} by taking away the node of least degree, again and again."""
    core = {}
    for g in {e[0] for e in edges}:
        near = {}
        for _, a, b in (e for e in edges if e[0] == g and e[1] != e[2]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        k = 0
        while near:
            n = min(near, key=lambda n: len(near[n]))
            k = max(k, len(near[n]))
            core[g, n] = k
            for m in near.pop(n):
                near[m].discard(n)
    return core


def test_core_numbers_go_over_few_edges_again(spark, monkeypatch):
    import random

    from gneiss.operators import graph

    links, before = [], graph.written

    def written(df, name):
        made = before(df, name)
        if name == "links":
            links.append(made.count())
        return made

    monkeypatch.setattr(graph, "written", written)
    dice = random.Random(4)
    # Few nodes of many edges and many nodes of few; a clique with a tail; a ring; loops and repeated edges.
    edges = [("a", f"s{dice.randrange(20)}", f"p{dice.randrange(300)}") for _ in range(1500)]
    edges += [("b", f"n{i}", f"n{j}") for i in range(9) for j in range(i)] + [("b", f"n{i}", f"n{i + 1}") for i in range(8, 30)] + [("b", "n3", "n3"), ("b", "n2", "n3")]
    edges += [("c", f"r{i}", f"r{(i + 1) % 12}") for i in range(12)]
    table, want = spark.createDataFrame(edges, "g string, a string, b string"), peeled(edges)
    for inner in (0.01, graph.INNER):
        monkeypatch.setattr(graph, "INNER", inner)
        found = graph.core_numbers(table, "g", "a", "b").collect()
        assert {(r["graph"], r["node"]): r["core"] for r in found} == want and len(found) == len(want)
    # In both directions: of the first graph's edges a part, where all of them were gone over before.
    assert links[1] < len(set(edges))
