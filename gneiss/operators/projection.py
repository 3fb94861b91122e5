"""Typed nodes and edges compiled from reviewed rows: identities by digest, conflicts and loose ends as rows."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.shared import written


def digest(*parts: Column | str) -> Column:
    """SHA-256 of the parts, one a line (null: an empty line)."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts)), 256)


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """The columns as one object, keys in order, nulls left out: equal rows have equal texts."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))))


def nodes_of(build: str, label: str, rows: DataFrame, key: list[str]) -> DataFrame:
    """(id, label, key, data) of rows: id is the digest of build, label and key, data the other columns as JSON."""
    rest = [c for c in rows.columns if c not in key]
    named = F.concat_ws("/", *(F.col(k).cast("string") for k in key))
    return rows.select(digest(F.lit(build), F.lit(label), named).alias("id"), F.lit(label).alias("label"), named.alias("key"), canonical_json(rows, rest).alias("data"))


def edges_of(build: str, kind: str, rows: DataFrame, start: tuple[str, list[str]], end: tuple[str, list[str]]) -> DataFrame:
    """(id, kind, start, end) of rows that hold the keys of both ends, each end given as (label, key columns)."""
    at = lambda e: digest(F.lit(build), F.lit(e[0]), F.concat_ws("/", *(F.col(k).cast("string") for k in e[1])))
    ends = rows.select(at(start).alias("start"), at(end).alias("end"))
    return ends.select(digest(F.lit(build), F.lit(kind), "start", "end").alias("id"), F.lit(kind).alias("kind"), "start", "end")


def compiled(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, faults): nodes and edges once each; faults are rows (fault, id, label, n): "conflict" for an
    identity with several contents, n of them, which is then no node; "loose" for an edge with n ends that are no nodes,
    which is then no edge. Contents are compared by digest, after equal ones were put together."""
    every = reduce(DataFrame.unionByName, nodes).withColumn("_digest", F.sha2("data", 256))
    each = written(every.groupBy("id", "label", "key", "_digest").agg(F.first("data").alias("data")), "contents")
    counted = each.groupBy("id").agg(F.count("*").alias("n"))
    one = written(each.join(counted.filter("n = 1").select("id"), "id", "left_semi").select("id", "label", "key", "data"), "nodes")
    clash = counted.filter("n > 1").join(each.select("id", "label").distinct(), "id").select(F.lit("conflict").alias("fault"), "id", "label", "n")
    once = reduce(DataFrame.unionByName, edges).distinct()
    ids = one.select("id")
    for end in ("start", "end"):
        once = once.join(ids.select(F.col("id").alias(end), F.lit(0).alias(f"_{end}")), end, "left")
    checked = written(once.withColumn("n", F.coalesce("_start", F.lit(1)) + F.coalesce("_end", F.lit(1))), "edges")
    loose = checked.filter("n > 0").select(F.lit("loose").alias("fault"), "id", F.col("kind").alias("label"), F.col("n").cast("long").alias("n"))
    return one, checked.filter("n = 0").select("id", "kind", "start", "end"), clash.unionByName(loose)


def ranges_in(text: str | None) -> list[dict]:
    """The fenced code blocks and quoted lines of a text, in order; a fence without an end runs to the end of the text."""
    out, at, fence = [], 0, None
    for line in (text or "").split("\n"):
        if line.startswith("```"):
            if fence is None:
                fence = at
            else:
                out.append({"start": fence, "end": at + len(line), "kind": "code"})
                fence = None
        elif fence is None and line.startswith("> "):
            out.append({"start": at, "end": at + len(line), "kind": "quote"})
        at += len(line) + 1
    if fence is not None:
        out.append({"start": fence, "end": len(text), "kind": "code"})
    return out


def block_ranges(text: Column) -> Column:
    """ranges_in of each text, as structs (start, end, kind), end past the last character."""

    @F.pandas_udf("array<struct<start:int,end:int,kind:string>>")
    def ranges(s: pd.Series) -> pd.Series:
        return s.map(ranges_in)

    return ranges(text)


def span_kind(blocks: Column, start: Column, end: Column) -> Column:
    """The kind of the first block that holds a span whole; "mixed" if the span only touches blocks, "text" if it touches none."""
    touched = F.filter(blocks, lambda b: (start < b["end"]) & (end > b["start"]))
    holds = F.filter(touched, lambda b: (b["start"] <= start) & (end <= b["end"]))
    return F.when(F.size(touched) == 0, "text").when(F.size(holds) > 0, F.get(holds, F.lit(0))["kind"]).otherwise("mixed")
