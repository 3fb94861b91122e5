"""Quotes found again in their source although typography or spacing differ, and metadata that a text bears out."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Dashes and quotation marks that count as the plain ones.
PLAIN = str.maketrans({**dict.fromkeys("‐‑–—−", "-"), **dict.fromkeys("‘’", "'"), **dict.fromkeys("“”", '"')})
_BLANK = re.compile(r"\s+")
_HAN = re.compile("[㐀-鿿]")


def folded(text: str) -> tuple[str, list[int], list[int]]:
    """A text with plain dashes and quotation marks, each run of blanks as one space, or as none at an end or next to a Han
    character; and the map back: where each piece without blanks begins, in the folded text and in the source."""
    plain = text.translate(PLAIN)
    out, at, source, length, end = [], [], [], 0, 0
    pieces = [(m.start(), m.end()) for m in re.finditer(r"\S+", plain)]
    for a, b in pieces:
        if out and not (_HAN.match(plain[end - 1]) or _HAN.match(plain[a])):
            out.append(" ")
            length += 1
        at.append(length)
        source.append(a)
        out.append(plain[a:b])
        length, end = length + b - a, b
    return "".join(out), at, source


def recovered(text: str | None, quote: str | None, ignore_case: bool = False, near: int | None = None) -> tuple[int, int] | None:
    """Where the source holds a quote but for typography, as (start, end); the first place, or of all places, those that
    overlap too, the one that begins nearest to `near`, the first of two. With ignore_case and no `near`, places that read
    differently in the source are ambiguous, and there is none."""
    if not text or not quote or not quote.strip():
        return None
    body, at, source = folded(text)
    needle = folded(quote)[0]
    # A match begins and ends with characters, never with the space between two pieces.
    back = lambda i: source[bisect_right(at, i) - 1] + i - at[bisect_right(at, i) - 1]
    if near is not None:
        starts = [m.start() for m in re.finditer(f"(?={re.escape(needle)})", body, re.I if ignore_case else 0)]
        if not starts:
            return None
        start = min(starts, key=lambda i: abs(back(i) - near))
        return back(start), back(start + len(needle) - 1) + 1
    spans = []
    for m in re.finditer(re.escape(needle), body, re.I if ignore_case else 0):
        spans.append((back(m.start()), back(m.end() - 1) + 1))
        if not ignore_case:
            break
    if not spans or len({text[a:b] for a, b in spans}) > 1:
        return None
    return spans[0]


def recovered_span(text: Column, quote: Column, ignore_case: bool = False, near: Column | None = None) -> Column:
    """recovered as a struct (start, end); null where there is none. A null in `near` is no hint."""

    @F.pandas_udf("struct<start:int,end:int>")
    def find(texts: pd.Series, quotes: pd.Series, places: pd.Series) -> pd.DataFrame:
        found = [recovered(t, q, ignore_case, None if pd.isna(n) else int(n)) for t, q, n in zip(texts, quotes, places)]
        return pd.DataFrame({c: pd.array([f[i] if f else None for f in found], dtype="Int32") for i, c in enumerate(("start", "end"))})

    span = find(text, quote, F.lit(None).cast("long") if near is None else near)
    return F.when(span["start"].isNotNull(), span)


def grounded_models(models: Column, body: Column) -> Column:
    """The models that the text names, spacing and case aside."""
    flat = F.lower(F.regexp_replace(body, r"\s+", ""))
    return F.filter(models, lambda m: F.contains(flat, F.lower(F.regexp_replace(m, r"\s+", ""))))


def grounded_years(years: Column, body: Column, date: Column) -> Column:
    """The years that the text, without its copyright lines, or the date names; if none, those of the date."""
    lines = F.filter(F.split(body, r"\r\n|[\n\r]"), lambda x: ~F.lower(x).rlike("copyright|©|all rights reserved"))
    dated = F.concat_ws("\n", F.array_join(lines, "\n"), date)
    named = F.transform(F.regexp_extract_all(dated, F.lit(r"\b([0-9]+)\b"), F.lit(1)), lambda x: x.try_cast("int"))
    kept = F.filter(years, lambda y: F.array_contains(named, y))
    own = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(date, F.lit("")), F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)), lambda x: x.cast("int"))))
    return F.when(F.size(kept) > 0, kept).otherwise(own)
