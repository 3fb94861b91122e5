"""Text as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def collapse(c: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def nfkc(c: Column) -> Column:
    """Unicode compatibility form and case folding, which no built-in function has; nulls stay."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")

    return F.pandas_udf(run, StringType())(c)


def fold(c: Column) -> Column:
    """Key for comparing names: NFKC, case-folded, white space collapsed."""
    return collapse(nfkc(c))


def compact(c: Column) -> Column:
    """Lower-case letters and digits only (ASCII word characters without the underscore)."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")


def match_key(c: Column) -> Column:
    """For quote matching: NFKC, case-folded, dashes and quotes made plain, no white space."""
    plain = F.translate(nfkc(c), "‐‑‒–—‘’“”", "-----''\"\"")
    return F.regexp_replace(plain, r"\s+", "")


def escape_like(c: Column | str, mark: str = "\\") -> Column | str:
    """Text in which % and _ stand for themselves in LIKE."""
    if isinstance(c, str):
        for x in (mark, "%", "_"):
            c = c.replace(x, mark + x)
        return c
    for x in (mark, "%", "_"):
        c = F.replace(c, F.lit(x), F.lit(mark + x))
    return c


def first_sentence(c: Column) -> Column:
    """The first line up to its first full stop: a title for texts that have none."""
    return F.regexp_extract(c, r"^([^\n.]*)", 1)


def preview(c: Column, n: int) -> Column:
    """At most n characters, and whether more followed."""
    return F.struct(F.substring(c, 1, n).alias("text"), (F.length(c) > n).alias("truncated"))


def snippet(c: Column, terms: list[str], width: int = 300) -> Column:
    """Collapsed text of up to width characters around the earliest term (case-insensitive), with ellipses where cut.

    Short texts come whole; without a term the head is given.
    """
    text = collapse(c)
    places = [F.locate(t.lower(), F.lower(text)) for t in terms]
    known = [F.when(p > 0, p) for p in places]
    at = F.least(*known) if len(known) > 1 else known[0] if known else F.lit(None).cast("int")
    start = F.greatest(at - F.lit(width // 3), F.lit(1))
    body = F.substring(text, start, F.lit(width))
    cut = F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), body, F.when(start + width <= F.length(text), F.lit("…")).otherwise(F.lit("")))
    return F.when(F.length(text) <= width, text).when(at.isNull(), F.concat(F.substring(text, 1, width), F.lit("…"))).otherwise(cut)


def list_values(c: Column) -> Column:
    """Parts of a list written with commas, semicolons or slashes; trimmed, without blanks and words for nothing, in order, once each."""
    parts = F.transform(F.split(c, r"[,;/]"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & ~F.lower(x).isin("none", "null", "n/a", "unknown")))


def years(c: Column, latest: int) -> Column:
    """Years from 1900 to latest named in a text, ascending, once each."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda y: y <= latest)))


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != "")


def bilingual_tokens(text: Column) -> Column:
    """Words of letters and digits, and of Han and kana runs each character and each two neighbours."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(r"([぀-ヿ㐀-鿿]+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))))
    single = F.flatten(F.transform(runs, lambda r: F.filter(F.split(r, ""), lambda x: x != "")))
    more = F.when(low.rlike("[぀-ヿ㐀-鿿]"), F.concat(single, F.filter(pairs, lambda g: F.length(g) > 1))).otherwise(F.array().cast("array<string>"))
    return F.concat(words(text), more)


def token_count(c: Column) -> Column:
    """White-space tokens, at least 1."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")))


def matches_term(c: Column, term: str, lowered: bool = False) -> Column:
    """Whether an ASCII term stands in c with no letter or digit next to it; spaces in it match any white space.

    The longest word of the term must be in c at all, which is looked for first: most texts are refused by that.
    lowered says that c is lower-case already.
    """
    parts, low = term.lower().split(), c if lowered else F.lower(c)
    found = low.rlike(r"(^|[^a-z0-9])" + r"\s+".join(map(_quote, parts)) + r"([^a-z0-9]|$)")
    return low.contains(max(parts, key=len)) & found if parts else found


def may_match(c: Column, terms: list[str]) -> Column:
    """Necessary condition for any of the terms to match the lower-case text c."""
    found = F.lit(False)
    for w in dict.fromkeys(max(t.lower().split(), key=len) for t in terms if t.split()):
        found = found | c.contains(w)
    return found


def _quote(s: str) -> str:
    return "".join(x if x.isalnum() or x == "_" else "\\" + x for x in s)


def measures(c: Column) -> Column:
    """Numbers with units g, kg, min, h, mm, cm, m as structs (number, unit) in g, min and mm, once each, in order."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*(kg|g|min|h|mm|cm|m)\b"), F.lit(0))

    def one(x: Column) -> Column:
        number = F.regexp_extract(x, r"^([0-9.]+)", 1).cast("double")
        unit = F.regexp_extract(x, r"([a-z]+)$", 1)
        factor = F.when(unit == "kg", 1000.0).when(unit == "h", 60.0).when(unit == "cm", 10.0).when(unit == "m", 1000.0).otherwise(1.0)
        base = F.when(unit.isin("kg", "g"), "g").when(unit.isin("h", "min"), "min").otherwise("mm")
        return F.struct((number * factor).alias("number"), base.alias("unit"))

    return F.array_distinct(F.transform(found, one))


def clamp(c: Column) -> Column:
    """Into [0, 1]; NaN and null become 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))))


def language(c: Column) -> Column:
    """Language by script and letters: kana ja, hangul ko, Han zh; else by accented letters; short or bare texts und."""
    count = lambda p: F.regexp_count(c, F.lit(p))
    return (
        F.when(F.length(F.trim(c)) < 15, "und")
        .when(count(r"[぀-ヿ]") > 0, "ja")
        .when(count(r"[가-힯]") > 0, "ko")
        .when(count(r"[一-鿿]") > 0, "zh")
        .when(count("[äöüß]") > F.greatest(count("[éèêç]"), count("[ñíóá]")), "de")
        .when(count("[éèêç]") > count("[ñíóá]"), "fr")
        .when(count("[ñíóá]") > 0, "es")
        .when(count("[a-z]") > 0, "en")
        .otherwise("und")
    )


def seconds_of(c: Column) -> Column:
    """h:mm:ss.mmm or mm:ss.mmm as seconds."""
    p = F.split(F.replace(c, F.lit(","), F.lit(".")), ":")
    part = lambda i: F.element_at(p, -i).cast("double")
    return F.when(F.size(p) >= 3, part(3) * 3600).otherwise(0.0) + F.when(F.size(p) >= 2, part(2) * 60).otherwise(0.0) + part(1)


def json_object(c: Column) -> Column:
    """The text from the first { to the last }, from model output with a fence or talk around it."""
    return F.regexp_extract(c, r"(?s)(\{.*\})", 1)


def date_line(c: Column, within: int = 5000) -> Column:
    """The first line among the first characters that says when a page was updated, published or released; copyright lines don't count."""
    lines = F.split(F.substring(c, 1, within), "\n")
    fits = F.filter(lines, lambda x: F.lower(x).rlike(r"(updated|published|released).*(19|20)[0-9]{2}") & ~F.lower(x).rlike(r"copyright|©"))
    return F.try_element_at(fits, F.lit(1))
