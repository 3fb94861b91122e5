"""URLs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(c: Column) -> Column:
    """Scheme and host in lower case, without default port and fragment, path / if there is none; null with user names or another scheme."""
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(c, r"^[A-Za-z]+://([^/?#]*)", 1))
    bare = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = F.regexp_extract(c, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(c, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(scheme.isin("http", "https") & ~host.contains("@") & (host != ""), F.concat(scheme, F.lit("://"), bare, F.when(path == "", F.lit("/")).otherwise(path), query))


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z]+://([^/?#:]*)", 1))


def in_domain(c: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    h = host(c)
    out = F.lit(False)
    for d in domains:
        out = out | (h == d) | h.endswith(f".{d}")
    return out


def query_value(c: Column, name: str) -> Column:
    """The value of a query parameter, null if absent."""
    found = F.regexp_extract(c, rf"[?&]{name}=([^&#]*)", 1)
    return F.when(found != "", found)


def at_seconds(c: Column, seconds: Column) -> Column:
    """A deep link: parameters t and start dropped, t set to the whole seconds, fragment dropped."""
    plain = F.regexp_replace(c, "#.*$", "")
    bare = F.regexp_replace(F.regexp_replace(plain, r"([?&])(?:t|start)=[^&]*&?", "$1"), r"[?&]$", "")
    return F.concat(bare, F.when(bare.contains("?"), F.lit("&t=")).otherwise(F.lit("?t=")), F.floor(seconds).cast("long").cast("string"))


def links(c: Column) -> Column:
    """All URLs in a text, without trailing punctuation and fragments, once each, in order."""
    found = F.regexp_extract_all(c, F.lit(r"https?://[^\s\"'<>)]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(F.regexp_replace(u, "#.*$", ""), r"[.,;:!?]+$", "")))


def document_kind(c: Column) -> Column:
    """Kind of a page by keywords of its URL, the first that fits."""
    u = F.lower(c)
    return F.when(u.rlike("manual|guide"), "manual").when(u.rlike("spec"), "specification").when(u.rlike("faq|support"), "support").when(u.rlike("page="), "listing").otherwise("article")
