"""Names in texts, nearest pairs and expansion under budgets, against plain loops."""

import random

import pytest

from gneiss.operators import graph, joins, search


@pytest.mark.parametrize("seed", range(3))
def test_nearest_later(spark, seed):
    r = random.Random(seed)
    rows = [(k, i, float(r.choice((r.randrange(20), r.randrange(1000))))) for k, n in (("a", 60), ("b", 1), ("c", 2), ("d", 25)) for i in r.sample(range(1000), n)]
    want = {}
    for k, i, v in rows:
        later = sorted((abs(v - w), j) for q, j, w in rows if q == k and j > i)[:3]
        want[k, i] = [(j, d) for d, j in later]
    got = {}
    keyed = {}
    for k, i, _ in rows:
        keyed.setdefault(i, []).append(k)
    df = spark.createDataFrame([(k, f"{k}{i:04}", v) for k, i, v in rows], "k string, i string, v double")
    for x in joins.nearest_later(df, "k", "i", "v", 3).collect():
        got.setdefault((x["a"][0], int(x["a"][1:])), []).append((x["place"], int(x["b"][1:]), x["apart"]))
    assert {a: [(j, d) for _, j, d in sorted(v)] for a, v in got.items()} == {a: v for a, v in want.items() if v}


def test_names_in_texts(spark):
    texts = spark.createDataFrame([(1, "The AIR-2 flies"), (2, "air 20"), (3, "Air, 2"), (4, None), (5, "repair 2")], "i int, t string")
    names = spark.createDataFrame([("Air 2",), ("air",), ("--",), ("Air 2",)], "n string")
    assert sorted(map(tuple, joins.named_in(texts, "i", "t", names, "n").collect())) == [(1, "Air 2"), (1, "air"), (2, "air"), (3, "Air 2"), (3, "air")]


def test_gate(spark):
    items = spark.createDataFrame([(1, "Air 2", True), (2, "Mini", True), (3, "Mini", False), (4, None, True), (5, "Air 2", None)], "i int, d string, g boolean")
    q = spark.createDataFrame([("q", "my Air 2"), ("r", "hello"), ("s", "air 2 or mini")], "q string, t string")
    got = sorted(map(tuple, search.gated(items, "i", "d", "g", q, "q", "t").collect()), key=repr)
    assert got == sorted([(None, 3), (None, 4), (None, 5), ("r", None), ("q", 1), ("s", 1), ("s", 2)], key=repr)


def fold(edges, roots, hops, most_nodes, most_edges):
    """The rule edge by edge."""
    hop_of = dict.fromkeys(sorted(roots)[:most_nodes], 0)
    chosen, front, cut = [], set(hop_of), len(roots) > most_nodes
    for hop in range(1, hops + 1):
        new = set()
        old = {n for n, h in hop_of.items() if h < hop - 1}
        for w, i, a, b in sorted((-w, i, a, b) for i, a, b, w in edges if (a in front or b in front) and a not in old and b not in old):
            fresh = {x for x in (a, b) if x not in hop_of}
            if len(chosen) == most_edges or len(hop_of) + len(fresh) > most_nodes:
                cut = True
                continue
            chosen.append((i, hop))
            hop_of.update(dict.fromkeys(fresh, hop))
            new |= fresh
        front = new
        if len(chosen) == most_edges or not front:
            break
    return chosen, hop_of, cut


@pytest.mark.parametrize("budget", [(5, 8), (12, 15), (100, 9), (100, 1000), (1, 5)])
def test_expansion_under_budgets(spark, budget):
    r = random.Random(budget[0])
    pairs = {tuple(r.sample(range(40), 2)) for _ in range(90)}
    edges = [(f"e{i:03}", f"n{a}", f"n{b}", r.randrange(5)) for i, (a, b) in enumerate(sorted(pairs))]
    df = spark.createDataFrame(edges, "id string, a string, b string, w int")
    nodes, chosen, cut = graph.expand_within(df, "a", "b", "id", "w", spark.createDataFrame([("n1",), ("n2",)], "node string"), 3, *budget)
    want_edges, want_nodes, want_cut = fold(edges, {"n1", "n2"}, 3, *budget)
    assert sorted((x["id"], x["hop"]) for x in chosen.collect()) == sorted(want_edges)
    assert {x["node"]: x["hop"] for x in nodes.collect()} == want_nodes
    assert cut == want_cut


def cores_of(near):
    core, rest, k = {}, {n: set(v) for n, v in near.items()}, 0
    while rest:
        low = [n for n, v in rest.items() if len(v) <= k]
        if not low:
            k += 1
        for n in low:
            core[n] = k
            for m in rest.pop(n):
                if m in rest:
                    rest[m].discard(n)
    return core


@pytest.mark.parametrize("seed", range(2))
def test_cores_and_the_display_part(spark, seed):
    r = random.Random(seed)
    edges = [(g, f"n{x}", f"n{y}", r.randrange(6)) for g, n, m in (("g", 30, 90), ("h", 12, 14), ("i", 2, 1)) for x, y in [r.sample(range(n), 2) for _ in range(m)]] + [("g", "n1", "n1", 99)]
    df = spark.createDataFrame(edges, "g string, a string, b string, w int")
    want_edges, want_cores = set(), {}
    for g in ("g", "h", "i"):
        best, near = {}, {}
        for q, x, y, w in edges:
            if q == g and x != y:
                e = (min(x, y), max(x, y))
                best[e] = max(best.get(e, w), w)
                near.setdefault(x, set()).add(y)
                near.setdefault(y, set()).add(x)
        core = cores_of(near)
        want_cores |= {(g, n): (c, len(near[n])) for n, c in core.items()}
        rank = lambda n: (-core[n], -len(near[n]), n)  # noqa: B023, E731
        kept, tree = [min(near, key=rank)], []
        while len(kept) < 9:
            border = {m for n in kept for m in near[n]} - set(kept)
            if not border:
                break
            new = min(border, key=lambda n: (-len(near[n] & set(kept)), *rank(n)))  # noqa: B023
            tree.append(max(((min(new, m), max(new, m)) for m in near[new] & set(kept)), key=lambda e: (best[e], e)))  # noqa: B023
            kept.append(new)
        more = sorted((e for e in best if set(e) <= set(kept) and e not in tree), key=lambda e: (-min(core[e[0]], core[e[1]]), -best[e], e))
        want_edges |= {(g, *e, best[e]) for e in (tree + more)[: max(12, len(tree))]}
    assert {(x["graph"], x["node"]): (x["core"], x["degree"]) for x in graph.core_numbers(df, "g", "a", "b").collect()} == want_cores
    assert {tuple(x) for x in graph.connected_selection(df, "g", "a", "b", "w", 9, 12).collect()} == want_edges
