"""Graphs as edge tables: expansion, components, cores, paths, display reductions, merging."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.shared import dropped, scratch, written

#: Bytes that were written for a partition up to which a join may hash it.
HASHED = "64m"


@contextmanager
def hashed(spark: SparkSession):
    """Joins that run within it hash partitions that are all below HASHED instead of sorting both sides; larger ones are
    sorted as ever, so what a task holds stays bounded."""
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = spark.conf.get(name, None)
    spark.conf.set(name, HASHED)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of every edge, without loops, once each."""
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(F.col(b).alias("a"), F.col(a).alias("b")))
    return both.filter("a <> b").distinct()


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges at each node; a loop counts once."""
    return edges.select(F.explode(F.array_distinct(F.array(a, b))).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def expand(edges: DataFrame, a: str, b: str, roots: DataFrame, hops: int) -> DataFrame:
    """(node, hop) of all nodes within hops of the roots (a column node), in either direction. Hops are few: a join each."""
    both = undirected(edges, a, b)
    seen = roots.select("node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for h in range(1, hops + 1):
        new = both.join(front.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(h))
        front = written(new, "front")
        seen = seen.unionByName(front)
    return seen


def expand_within(edges: DataFrame, a: str, b: str, id_: str, weight: str, roots: DataFrame, hops: int, most_nodes: int, most_edges: int) -> tuple[DataFrame, DataFrame, bool]:
    """(node, hop) and (id, a, b, hop) of an expansion in either direction under budgets, and whether they cut it short.

    In each hop the edges that touch the last hop's new nodes come in order of weight, greatest first, then id. One that
    would bring a node too many is left out, and the next one is looked at; once there are most_edges, nothing follows.
    What reaches the driver is bounded by the budgets; candidates are sorted out by partial minima and top rows.
    """
    spark, kind = edges.sparkSession, dict(edges.dtypes)
    schema = f"node {kind[a]}, hop int"
    nodes = [(r["node"], 0) for r in roots.select("node").distinct().orderBy("node").limit(most_nodes).collect()]
    cut = roots.select("node").distinct().count() > most_nodes
    chosen, front = [], [n for n, _ in nodes]
    for hop in range(1, hops + 1):
        if not front:
            break
        seen = F.broadcast(spark.createDataFrame(nodes, schema))
        at = lambda c: seen.select(F.col("node").alias(c), F.col("hop").alias(f"_{c}"))  # noqa: B023, E731
        touched = edges.select(id_, a, b, weight).join(at(a), a, "left").join(at(b), b, "left").filter((F.col(f"_{a}") == hop - 1) | (F.col(f"_{b}") == hop - 1))
        fresh = touched.filter((F.coalesce(f"_{a}", F.lit(hop - 1)) >= hop - 1) & (F.coalesce(f"_{b}", F.lit(hop - 1)) >= hop - 1))
        new = F.when(F.col(f"_{a}").isNull(), F.col(a)).when(F.col(f"_{b}").isNull(), F.col(b))
        fresh = written(fresh.withColumn("_new", new).withColumn("_order", F.struct((-F.col(weight)).alias("w"), F.col(id_).alias("i"))), "touched")
        first = fresh.filter("_new IS NOT NULL").groupBy("_new").agg(F.min("_order").alias("_first"))
        room = most_nodes - len(nodes)
        welcome = [r["_new"] for r in first.orderBy("_first").limit(room).collect()] if room > 0 else []
        ok = fresh.filter(F.col("_new").isNull()).unionByName(fresh.join(F.broadcast(spark.createDataFrame([(w,) for w in welcome], f"_new {kind[a]}")), "_new", "left_semi").select(fresh.columns))
        taken = ok.orderBy("_order").limit(most_edges - len(chosen)).collect()
        cut = cut or fresh.count() > len(taken)
        chosen += [(r[id_], r[a], r[b], hop) for r in taken]
        have = {n for n, _ in nodes}
        front = [n for n in dict.fromkeys(r["_new"] for r in taken if r["_new"] is not None) if n not in have]
        nodes += [(n, hop) for n in front]
        if len(chosen) == most_edges:
            break
    return spark.createDataFrame(nodes, schema), spark.createDataFrame(chosen, f"`{id_}` {kind[id_]}, `{a}` {kind[a]}, `{b}` {kind[b]}, hop int"), cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node that each node is connected with; every round also takes the label's label."""
    both = written(undirected(edges, a, b), "links")
    label = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("label").alias("_l")), "b").groupBy("a").agg(F.min("_l").alias("near"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        beyond = step.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        new = written(step.join(beyond, "label").select("node", F.least("label", "beyond").alias("label"), (F.least("label", "beyond") != F.col("was")).alias("moved")), "labels")
        dropped(label)
        label = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return label.select("node", F.col("label").alias("component"))


def large_components(edges: DataFrame, a: str, b: str, least: int) -> DataFrame:
    c = components(edges, a, b)
    return c.withColumn("size", F.count("*").over(Window.partitionBy("component"))).filter(F.col("size") >= least)


def largest_component(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Nodes of the largest component, on ties that of the least node."""
    c = components(edges, a, b)
    best = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return c.join(F.broadcast(best.select("component")), "component", "left_semi")


def k_core(edges: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """Nodes of the k-core with their degree in it: nodes with under k neighbours leave until none does."""
    both = written(undirected(edges, a, b), "links")
    while True:
        keep = both.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("a")
        rest = written(both.join(keep, "a", "left_semi").join(keep.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b"), "links")
        if rest.count() == both.count():
            return rest.groupBy("a").agg(F.count("*").alias("degree")).withColumnRenamed("a", "node")
        dropped(both)
        both = rest


# Joins name the node first: a sort compares the first bytes of its first column at once, and all nodes of a graph have the
# same graph.

#: Share of a graph's edges whose ends both have the degree that its nodes are parted at.
INNER = 0.2


def _both(edges: DataFrame) -> DataFrame:
    """(graph, a, b) in both directions."""
    return edges.select("graph", "a", "b").unionByName(edges.select("graph", F.col("b").alias("a"), F.col("a").alias("b")))


def core_numbers(edges: DataFrame, graph: str, a: str, b: str) -> DataFrame:
    """(graph, node, core, degree): the greatest k for which a node is in its graph's k-core, parallel edges as one."""
    ends = edges.select(F.col(graph).alias("graph"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b")
    return simple_core_numbers(written(ends.distinct(), "near"))


def simple_core_numbers(near: DataFrame) -> DataFrame:
    """core_numbers of a table near(graph, a, b) that has each two nodes once.

    Each graph is parted at a degree t. Nodes of its t-core have core numbers of t or more, which edges within the t-core
    decide alone; to the others, which stay below t, neighbours in the t-core count in full, whatever their numbers. So
    only edges within and edges outside the t-core are gone over again, and t, of which the results do not depend, is a
    degree that few edges reach at both ends: most nodes below it meet the t-core alone, and their degree is their number.
    """
    count = lambda df: df.groupBy("graph", F.col("a").alias("node")).agg(F.count("*").alias("_n"))
    degree = written(count(_both(near)).withColumnRenamed("_n", "degree"), "degrees")
    side = lambda end: degree.select("graph", F.col("node").alias(end), F.col("degree").alias(f"_{end}"))
    with hashed(near.sparkSession):
        ends = written(near.select("graph", "a", "b").join(side("a"), ["a", "graph"]).join(side("b"), ["b", "graph"]), "ends")
    lesser = F.least("_a", "_b")
    by = Window.partitionBy("graph")
    reach = ends.groupBy("graph", lesser.alias("_t")).agg(F.count("*").alias("_n")).select("graph", "_t", F.sum("_n").over(by.orderBy(F.desc("_t"))).alias("_upto"), F.sum("_n").over(by).alias("_all"))
    split = written(reach.filter(F.col("_upto") >= INNER * F.col("_all")).groupBy("graph").agg(F.max("_t").alias("_t")), "split")
    marked = ends.join(split, "graph")
    inner = written(marked.filter(lesser >= F.col("_t")).select("graph", "a", "b"), "inner")
    while True:
        few = written(count(_both(inner)).join(split, "graph").filter("_n < _t").select("graph", "node"), "few")
        if few.isEmpty():
            break
        rest = written(inner.join(few.withColumnRenamed("node", "a"), ["a", "graph"], "left_anti").join(few.withColumnRenamed("node", "b"), ["b", "graph"], "left_anti").select("graph", "a", "b"), "inner")
        dropped(inner)
        inner = rest
    held = written(count(_both(inner)).select("graph", "node", F.col("_n").alias("core"), F.lit(0).cast("long").alias("base")), "held")
    fallen = written(degree.join(split, "graph").filter("degree >= _t").join(held, ["node", "graph"], "left_anti").select("graph", "node"), "fallen")
    gone = lambda end: fallen.select("graph", F.col("node").alias(end), F.lit(True).alias(f"_out_{end}"))
    below = lambda end: (F.col(f"_{end}") < F.col("_t")) | F.col(f"_out_{end}").isNotNull()
    outer = written(marked.join(gone("a"), ["a", "graph"], "left").join(gone("b"), ["b", "graph"], "left").filter(below("a") & below("b")).select("graph", "a", "b"), "outer")
    others = count(_both(outer)).join(degree, ["node", "graph"]).join(split, "graph").select("graph", "node", F.least("degree", F.col("_t") - 1).alias("core"), (F.col("degree") - F.col("_n")).alias("base"))
    value = _settled(written(_both(inner.unionByName(outer)), "links"), written(held.unionByName(others), "cores"))
    return degree.join(value.select("graph", "node", "core"), ["node", "graph"], "left").select("graph", "node", F.coalesce("core", "degree").alias("core"), "degree")


def _settled(both: DataFrame, value: DataFrame) -> DataFrame:
    """value(graph, node, core, base) brought down to core numbers, over both(graph, a, b).

    Every node starts at a number not below its own and takes, round by round, the greatest h such that h of its
    neighbours have at least h, until none moves: that is the core number, reached in far fewer rounds than peeling
    takes. `base` neighbours that are not in the table have at least h always.
    """
    while True:
        near = both.join(value.select("graph", F.col("node").alias("b"), F.col("core").alias("_v")), ["b", "graph"])
        # Neighbours of one value are counted first; running counts from the greatest value down give h.
        counted = near.groupBy("graph", "a", "_v").agg(F.count("*").alias("_n")).join(value.select("graph", F.col("node").alias("a"), "base"), ["a", "graph"])
        upto = F.sum("_n").over(Window.partitionBy("a", "graph").orderBy(F.desc("_v"))) + F.col("base")
        h = counted.withColumn("_h", F.greatest(F.least("_v", upto), "base")).groupBy("graph", "a").agg(F.max("_h").alias("_h"))
        step = written(value.join(h.withColumnRenamed("a", "node"), ["node", "graph"]).select("graph", "node", F.least("core", "_h").alias("core"), "base", (F.col("_h") < F.col("core")).alias("moved")), "cores")
        dropped(value)
        value = step.select("graph", "node", "core", "base")
        if step.filter("moved").isEmpty():
            return value


#: Folders of a display table's edges, of which a step reads those of the nodes just taken.
FOLDERS = 256


def connected_selection(edges: DataFrame, graph: str, a: str, b: str, weight: str, nodes: int, links: int) -> DataFrame:
    """A connected part of each graph for display: grown from the node of greatest (core, degree), least id, by most
    attachments, then core, degree and id; a spanning tree of its strongest edges, then its other edges by the lesser
    core of their ends, weight and ends, `links` in all. nodes and links are the feature; the graph is not cut.

    Edges lie in folders by a hash of their node, and a step of growth reads those of the nodes just taken alone; it
    adds them to the table of what the chosen nodes touch. Only the node that each graph takes next comes to the driver.
    """
    spark = edges.sparkSession
    kinds = dict(edges.dtypes)
    near = written(parallel_by(edges, graph, a, b, weight), "near")
    cores = written(simple_core_numbers(near), "numbers")
    both = near.unionByName(near.select("graph", F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    info = cores.select("graph", F.col("node").alias("b"), "core", "degree")
    bucket = lambda node: F.pmod(F.xxhash64(node), F.lit(FOLDERS)).cast("int")
    path = scratch(spark, "display")
    with hashed(spark):
        both.join(info, ["b", "graph"]).select("graph", "a", "b", "core", "degree", bucket("a").alias("_folder")).repartition("_folder").sortWithinPartitions("_folder", "a").write.partitionBy("_folder").parquet(path)
    kind = ", ".join(f"{c} {k}" for c, k in (("graph", kinds[graph]), ("a", kinds[a]), ("b", kinds[b]), ("core", "long"), ("degree", "long"), ("_folder", "int")))
    table = spark.read.schema(kind).parquet(path)
    rank = lambda node: F.struct((-F.col("core")).alias("c"), (-F.col("degree")).alias("d"), F.col(node).alias("node"))
    schema = f"graph {kinds[graph]}, a {kinds[a]}, step int"
    # A local table, which needs no job to be read.
    local = lambda rows, kind: spark.createDataFrame(pa.table({c: list(v) for c, v in zip(("graph", "a", "step"), zip(*rows))}), kind)
    kept = [(r["graph"], r["s"]["node"], 0) for r in cores.groupBy("graph").agg(F.min(rank("node")).alias("s")).collect()]
    fresh, touched = [(g, n) for g, n, _ in kept], scratch(spark, "touched")
    for step in range(1, nodes):
        if not fresh:
            break
        new = local(fresh, f"graph {kinds[graph]}, a {kinds[a]}")
        folders = list({r[0] for r in new.select(bucket("a")).collect()})
        mine = table.filter(F.col("_folder").isin(folders) & F.col("a").isin([n for _, n in fresh])).join(F.broadcast(new), ["a", "graph"], "left_semi").drop("_folder")
        mine.write.mode("append").parquet(touched)
        have = F.broadcast(local(kept, schema))
        border = spark.read.schema(mine.schema).parquet(touched).groupBy("graph", "b", "core", "degree").agg(F.count("*").alias("n"))
        border = border.join(have.select("graph", F.col("a").alias("b")), ["b", "graph"], "left_anti")
        best = border.groupBy("graph").agg(F.min(F.struct((-F.col("n")).alias("n"), rank("b").alias("r"))).alias("s")).collect()
        fresh = [(r["graph"], r["s"]["r"]["node"]) for r in best]
        kept += [(g, n, step) for g, n in fresh]
    chosen = F.broadcast(spark.createDataFrame(kept, schema))
    core = cores.select("graph", "node", "core")
    side = lambda end: chosen.select("graph", F.col("a").alias(end), F.col("step").alias(f"_{end}"))
    held = near.join(side("a"), ["a", "graph"]).join(side("b"), ["b", "graph"])
    held = held.join(core.select("graph", F.col("node").alias("a"), F.col("core").alias("_ca")), ["a", "graph"]).join(core.select("graph", F.col("node").alias("b"), F.col("core").alias("_cb")), ["b", "graph"])
    held = held.withColumn("_new", F.greatest("_a", "_b")).withColumn("_low", F.least("_ca", "_cb"))
    # The tree has each node's strongest edge to those chosen before it; a graph's chosen edges are some thousands.
    tree = F.row_number().over(Window.partitionBy("_new", "graph").orderBy(F.desc("weight"), F.desc("a"), F.desc("b"))) == 1
    marked = held.withColumn("_tree", tree)
    place = F.row_number().over(Window.partitionBy("graph").orderBy(F.desc("_tree"), F.desc("_low"), F.desc("weight"), "a", "b"))
    out = marked.withColumn("_place", place).filter(F.col("_tree") | (F.col("_place") <= links))
    return out.select(F.col("graph").alias(graph), F.col("a").alias(a), F.col("b").alias(b), F.col("weight").alias(weight))


def parallel_by(edges: DataFrame, graph: str, a: str, b: str, weight: str) -> DataFrame:
    """(graph, a, b, weight): edges of a graph between the same two nodes as one, a before b, of the greatest weight."""
    return edges.filter(F.col(a) != F.col(b)).groupBy(F.col(graph).alias("graph"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max(weight).alias("weight"))


def parallel(edges: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """Edges between the same two nodes, whatever their direction, as one: number, weight, and greatest weight."""
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), weight).groupBy("a", "b").agg(F.count("*").alias("edges"), F.sum(weight).alias("weight"), F.max(weight).alias("strongest"))


def shortest(edges: DataFrame, a: str, b: str, start: str, goal: str, most: int = 4) -> DataFrame:
    """(start, goal, hops) of the shortest undirected path of up to most hops; no row if there is none."""
    near = expand(edges, a, b, edges.sparkSession.range(1).select(F.lit(start).alias("node")), most)
    return near.filter(F.col("node") == goal).select(F.lit(start).alias("start"), F.lit(goal).alias("goal"), F.col("hop").alias("hops"))


def lens(edges: DataFrame, a: str, b: str, predicate: str, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Edges of the allowed predicates, and their end nodes."""
    kept = edges.filter(F.col(predicate).isin(*allowed))
    return kept, kept.select(F.explode(F.array(a, b)).alias("node")).distinct()


def merged_edges(edges: DataFrame, a: str, b: str, same: DataFrame, weights: list[str]) -> DataFrame:
    """Edges after nodes that same(x, y) joins became one (the least of their group); loops that arise go, weights add up."""
    named = components(same, "x", "y")
    to = lambda df, c: df.join(named.select(F.col("node").alias(c), F.col("component").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return to(to(edges, a), b).filter(F.col(a) != F.col(b)).groupBy(a, b).agg(*(F.sum(w).alias(w) for w in weights))


def grown_by(base: DataFrame, more: DataFrame, a: str, b: str, budget: int) -> DataFrame:
    """base and edges of more up to `budget` edges in all: first those that touch a node of base, then others, in order.
    The budget is the feature; base is never cut."""
    nodes = base.select(F.explode(F.array(a, b)).alias("node")).distinct()
    new = more.select(a, b).distinct().join(base.select(a, b), [a, b], "left_anti")
    one = lambda df, c: df.join(nodes.select(F.col("node").alias(c), F.lit(1).alias(f"_{c}")), c, "left")
    near = one(one(new, a), b).withColumn("_near", F.coalesce(f"_{a}", f"_{b}").isNotNull())
    left = max(budget - base.select(a, b).distinct().count(), 0)
    return base.select(a, b).distinct().unionByName(near.orderBy(F.desc("_near"), a, b).limit(left).select(a, b))
