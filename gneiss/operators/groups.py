"""Order-dependent operators: one small group (a case, a page, a recording, a topic) at a time, by applyInPandas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.projection import ranges_in
from gneiss.operators.windows import first_per


def matched(pairs: DataFrame, case: str, left: str, right: str) -> DataFrame:
    """A largest one-to-one matching of each case's (left, right) pairs, by augmenting paths; lefts and rights in order."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        options: dict = {}
        for a, b in sorted(set(zip(pdf[left], pdf[right]))):
            options.setdefault(a, []).append(b)
        of_left: dict = {}
        of_right: dict = {}
        for root in options:
            # Breadth-first search for an augmenting path; came names the left node that reached a right one.
            came, queue, free = {}, [root], None
            while queue and free is None:
                a = queue.pop(0)
                for b in options[a]:
                    if b not in came:
                        came[b] = a
                        if b not in of_right:
                            free = b
                            break
                        queue.append(of_right[b])
            while free is not None:
                a = came[free]
                before = of_left.get(a)
                of_left[a], of_right[free] = free, a
                free = before
        return pd.DataFrame({case: [pdf[case].iloc[0]] * len(of_left), left: list(of_left), right: list(of_left.values())})

    return pairs.select(case, left, right).groupBy(case).applyInPandas(match, pairs.select(case, left, right).schema)


def distinct_frames(frames: DataFrame, video: str, at: str, code: str, apart: int = 8) -> DataFrame:
    """Frames kept in order of time: one whose 64-bit code differs in more than `apart` bits from every frame kept before."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        rows = []
        for i, c in zip(pdf.sort_values([at, code]).index, pdf.sort_values([at, code])[code]):
            if all((int(c) ^ k).bit_count() > apart for k in kept):
                kept.append(int(c))
                rows.append(i)
        return pdf.loc[rows]

    return frames.groupBy(video).applyInPandas(keep, frames.schema)


def merged_boxes(boxes: DataFrame, page: str, overlap: float = 0.2, least_area: float = 0.0, most: int = 8) -> DataFrame:
    """Boxes (x0, y0, x1, y1) of a page, in order, joined with the first kept box that they share over `overlap` of the
    smaller area with; small ones dropped, the largest `most` kept (the limit is the feature)."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list[float]] = []
        for x0, y0, x1, y1 in pdf[["x0", "y0", "x1", "y1"]].sort_values(["y0", "x0", "y1", "x1"]).to_numpy().tolist():
            for o in out:
                w, h = min(x1, o[2]) - max(x0, o[0]), min(y1, o[3]) - max(y0, o[1])
                small = min((x1 - x0) * (y1 - y0), (o[2] - o[0]) * (o[3] - o[1]))
                if w > 0 and h > 0 and small > 0 and w * h / small > overlap:
                    o[:] = [min(x0, o[0]), min(y0, o[1]), max(x1, o[2]), max(y1, o[3])]
                    break
            else:
                out.append([x0, y0, x1, y1])
        area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
        out = sorted((b for b in out if area(b) >= least_area), key=lambda b: (-area(b), b))[:most]
        df = pd.DataFrame(out, columns=["x0", "y0", "x1", "y1"])
        df.insert(0, page, pdf[page].iloc[0])
        return df

    kinds = dict(boxes.dtypes)
    return boxes.select(page, "x0", "y0", "x1", "y1").groupBy(page).applyInPandas(merge, f"{page} {kinds[page]}, x0 double, y0 double, x1 double, y1 double")


def protected(body: str) -> list[tuple[int, int]]:
    """Where a text should not be cut: its fenced blocks, and its quoted lines, those that follow each other as one."""
    out: list[list] = []
    for r in ranges_in(body):
        if out and r["kind"] == "quote" and out[-1][2] == "quote" and out[-1][1] + 1 == r["start"]:
            out[-1][1] = r["end"]
        else:
            out.append([r["start"], r["end"], r["kind"]])
    return [(a, b) for a, b, _ in out]


def post_windows(posts: DataFrame, topic: str, number: str, text: str, size: int = 4000) -> DataFrame:
    """(topic, number, window, start, end): windows of up to size characters; a cut falls at the last blank line after the
    first third, else at the end of a line, else at size, and never inside a fenced block or a quote that fits a window."""
    kinds = dict(posts.dtypes)

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for n, body in zip(pdf[number], pdf[text]):
            body, start, window = body or "", 0, 0
            blocks = protected(body)
            while start < len(body):
                end = min(start + size, len(body))
                if end < len(body):
                    at = max(body.rfind("\n\n", start + size // 3, end), -1)
                    at = at if at >= 0 else body.rfind("\n", start + size // 3, end)
                    end = at + 1 if at >= 0 else end
                    inside = next(((a, b) for a, b in blocks if a < end < b and b - a <= size and a > start), None)
                    end = inside[0] if inside else end
                rows.append((pdf[topic].iloc[0], n, window, start, end))
                start, window = end, window + 1
        return pd.DataFrame(rows, columns=[topic, number, "window", "start", "end"])

    return posts.select(topic, number, text).groupBy(topic).applyInPandas(cut, f"{topic} {kinds[topic]}, {number} {kinds[number]}, window int, start int, end int")


def display_selection(edges: DataFrame, graph: str, a: str, b: str, weight: str, nodes: int, links: int, strongest: int = 20_000) -> DataFrame:
    """A connected part of each graph for display, chosen among its `strongest` edges (what a display can draw on is the
    feature, and bounds a task): grown from the node of greatest core number by most attachments, core number, degree
    and id; a spanning tree of it first, then its strongest other edges."""
    edges = first_per(edges, [graph], [F.desc(weight), F.col(a), F.col(b)], strongest)
    kinds = dict(edges.dtypes)

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        best: dict = {}
        for x, y, w in zip(pdf[a], pdf[b], pdf[weight]):
            if x != y:
                near.setdefault(x, set()).add(y)
                near.setdefault(y, set()).add(x)
                key = (min(x, y), max(x, y))
                best[key] = max(best.get(key, w), w)
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
        rank = lambda n: (-core[n], -len(near[n]), n)
        kept = [min(near, key=rank)] if near else []
        tree = []
        while kept and len(kept) < nodes:
            have = set(kept)
            border = {m for n in kept for m in near[n]} - have
            if not border:
                break
            new = min(border, key=lambda n: (-len(near[n] & have), *rank(n)))
            tree.append(max(((min(new, m), max(new, m)) for m in near[new] & have), key=lambda e: (best[e], e)))
            kept.append(new)
        have = set(kept)
        extra = sorted((e for e in best if e[0] in have and e[1] in have and e not in set(tree)), key=lambda e: (-min(core[e[0]], core[e[1]]), -best[e], e))
        chosen = (tree + extra)[: max(links, len(tree))]
        return pd.DataFrame({graph: [pdf[graph].iloc[0]] * len(chosen), a: [e[0] for e in chosen], b: [e[1] for e in chosen], weight: [best[e] for e in chosen]})

    return edges.select(graph, a, b, weight).groupBy(graph).applyInPandas(select, ", ".join(f"{c} {kinds[c]}" for c in (graph, a, b, weight)))
