"""Names, clusters that may not join two codes, and the typed projection."""

import random

import pytest
from pyspark.sql import functions as F

from gneiss.operators import identity, projection


def test_canonical_names(spark):
    cases = {
        "  the   Small  ring ": "Small ring", "A 5 inch prop": "5-inch prop", "three-axis gimbal": "3-axis gimbal", "Mini two": "Mini 2", "one way valve": "one way valve", "These 3 axis": "These 3-axis", "": "", None: None,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "a string, b string")
    assert all(r[0] == r[1] for r in df.select(identity.canonical(F.col("a")), "b").collect())


def test_values_are_no_names(spark):
    yes = ["250 g", "4.5kg", "60 fps", "12", "-3.5", "1920x1080", "1920 × 1080", "$1,200", "fw.bin", "192.168.0.1", "30 min"]
    no = ["5G protocol", "Mini 4K pro", "X1", "250 g version", "fw.bin loader", "bolt"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in yes + no], "a string").select("a", identity.is_value(F.col("a"))).collect()}
    assert got == {**dict.fromkeys(yes, True), **dict.fromkeys(no, False)}


def test_scopes_and_refusals(spark):
    rows = [(1, "product", "Drone", "drone", "global", "s"), (2, "product", "Drone", "drone", "source", "s"), (3, "product", "X5", "X5", "global", "s"), (4, "component", "X5", "X5", "global", "s"), (5, "product", "the ring", "Small Ring", "global", "s"), (6, "product", "SMALL-RING", "Small  Ring", "global", "t"), (7, "product", "", None, "global", "s"), (8, "product", "x", "12 kg", "source", "s")]
    df = spark.createDataFrame(rows, "id int, kind string, surface string, name string, scope string, source string")
    got = {r["id"]: r for r in identity.identities(df, "kind", "surface", "name", "scope", "source").collect()}
    assert {i: got[i]["refusal"] for i in got} == {1: "generic", 2: None, 3: "short model", 4: None, 5: None, 6: None, 7: "nameless", 8: "value"}
    assert got[5]["identity"] == got[6]["identity"] and got[2]["scope_key"] == "source:s"
    assert got[5]["alias_scope"] == "source:s" and got[6]["alias_scope"] == "global"


def brute(nodes, keys):
    """The rule on plain sets: codes spread by rounds, the least of the nearest; places are (key, code)."""
    code = dict(nodes)
    members = {}
    for i, k in keys:
        members.setdefault(k, set()).add(i)
    front = {i: c for i, c in code.items() if c is not None}
    while front:
        at_key = {}
        for k, m in members.items():
            found = [front[i] for i in m if i in front]
            if found:
                at_key[k] = min(found)
        new = {}
        for k, c in at_key.items():
            for i in members[k]:
                if code[i] is None:
                    new[i] = min(c, new.get(i, c))
        code.update(new)
        front = new
    parent = {i: i for i in code}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for m in members.values():
        for i in m:
            for j in m:
                if code[i] == code[j]:
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return {i: (root(i), code[i]) for i in code}


@pytest.mark.parametrize("seed", range(4))
def test_clusters(spark, seed):
    r = random.Random(seed)
    nodes = [(i, r.choice((None, None, None, "1", "2", "3"))) for i in range(60)]
    keys = [(i, f"k{r.randrange(25)}") for i in range(60) for _ in range(r.randrange(3))]
    got = identity.clusters(spark.createDataFrame(nodes, "id long, code string"), spark.createDataFrame(keys, "id long, key string"))
    assert {x["id"]: (x["cluster"], x["code"]) for x in got.collect()} == brute(nodes, keys)


def test_a_chain_between_two_codes_is_cut(spark):
    nodes = [(i, {0: "1", 6: "2"}.get(i)) for i in range(7)]
    keys = [(i, f"k{i}") for i in range(6)] + [(i + 1, f"k{i}") for i in range(6)]
    got = {x["id"]: x["cluster"] for x in identity.clusters(spark.createDataFrame(nodes, "id long, code string"), spark.createDataFrame(keys, "id long, key string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 4}


def test_blocks_and_spans(spark):
    text = "> said\nmid\n```py\nx = 1\n```\n> two\nend\n```\nopen"
    blocks = projection.ranges_in(text)
    assert [(text[b["start"] : b["end"]], b["kind"]) for b in blocks] == [("> said", "quote"), ("```py\nx = 1\n```", "code"), ("> two", "quote"), ("```\nopen", "code")]
    assert projection.ranges_in(None) == [] and projection.ranges_in("```\n> no quote\n```")[0]["kind"] == "code"
    at = text.index
    cases = [(0, 4, "quote"), (0, 9, "mixed"), (at("mid"), at("mid") + 3, "text"), (at("x ="), at("x =") + 2, "code"), (at("end"), len(text), "mixed")]
    df = spark.createDataFrame([(text, a, b, k) for a, b, k in cases], "t string, a int, b int, k string")
    assert all(r[0] == r[1] for r in df.select(projection.span_kind(projection.block_ranges(F.col("t")), F.col("a"), F.col("b")), "k").collect())


def test_conflicts_and_loose_edges(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "x"), (3, None)], "k int, v string")
    nodes, edges, faults = projection.compiled([projection.nodes_of("b", "n", rows, ["k"])], [projection.edges_of("b", "e", spark.createDataFrame([(2, 3), (2, 3), (2, 1), (9, 8)], "a int, z int"), ("n", ["a"]), ("n", ["z"]))])
    assert sorted(r["key"] for r in nodes.collect()) == ["2", "3"] and edges.count() == 1
    assert sorted((r["fault"], r["n"]) for r in faults.collect()) == [("conflict", 2), ("loose", 1), ("loose", 2)]
