"""HTML to text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions.text import collapse

#: Entities that are resolved; &amp; comes last so that no entity is made by it.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
AMP = [("&amp;", "&")]


def unescape(c: Column, entities: list[tuple[str, str]] = ENTITIES) -> Column:
    for a, b in entities:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def title(c: Column, entities: list[tuple[str, str]] = ENTITIES) -> Column:
    """The title with white space collapsed; only the given entities are resolved, others stay as they are written."""
    return collapse(unescape(F.regexp_extract(c, r"(?s)<title>(.*?)</title>", 1), entities))


def strip_tags(c: Column) -> Column:
    """Line breaks become newlines, other tags go, entities are resolved."""
    return F.trim(unescape(F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), r"<[^>]*>", "")))


def main_text(c: Column) -> Column:
    """Text without scripts, styles, navigation, footers and comments; blocks end lines; white space within lines is collapsed."""
    out = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    for tag in ("script", "style", "nav", "footer", "head"):
        out = F.regexp_replace(out, rf"(?s)<{tag}[^>]*>.*?</{tag}>", "")
    out = F.regexp_replace(out, r"(?i)</?(p|div|br|li|ul|h[1-6]|tr|article|body|html)[^>]*>", "\n")
    out = unescape(F.regexp_replace(out, r"<[^>]*>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def anchors(c: Column) -> Column:
    """Targets of all links in a page, in order."""
    return F.regexp_extract_all(c, F.lit(r'<a href="([^"]*)"'), F.lit(1))


def without_query(c: Column) -> Column:
    return F.regexp_replace(c, r"[?#].*$", "")
