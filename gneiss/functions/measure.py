"""Measurements told from names: an automaton over the words before a component's name, and whose part it is."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of components, words that join measurements without meaning, and words for parts of several owners.
CORES = ["battery", "camera", "display", "gimbal", "lens", "motor", "propeller", "screen", "sensor"]
FILLERS = {"a", "an", "and", "equivalent", "the", "with"}
SHARED = re.compile(r"\b(all|both|common|compatible|each|every|respectively|shared|universal)\b", re.I)
_COUNTS = {"single", "dual", "double", "triple", "quad"}
_TOKEN = re.compile(r"f/[0-9]+(?:\.[0-9]+)?|[0-9]+(?:/[0-9]+)?(?:\.[0-9]+)?|[A-Za-z]+|[^\sA-Za-z0-9]", re.I)
_UNITS = {"inch": "size", "in": "size", '"': "size", "mm": "focal", "mp": "pixels", "megapixel": "pixels", "megapixels": "pixels", "k": "format", "p": "format", "fps": "rate", "x": "zoom", "mah": "capacity", "hz": "rate"}


def parsed(words: str) -> dict[str, str] | None:
    """The measurements that words consist of, {attribute: text}; None if anything else is among them, or one attribute
    has two values.

    The automaton reads tokens in two states: between measurements, where a number opens one, an aperture or a count
    word is one by itself, and fillers, commas and hyphens pass; and after a number, which a hyphen may follow and a
    unit must close.
    """
    out: dict[str, str] = {}
    number = None
    for token in _TOKEN.findall(words):
        low, done = token.lower(), None
        if number is not None:
            if low == "-":
                continue
            kind = _UNITS.get(low)
            if kind is None:
                return None
            done, number = (kind, f"{number}{'' if low in ('k', 'p', 'x', chr(34)) else ' '}{low}"), None
        elif low.startswith("f/"):
            done = ("aperture", low)
        elif low in _COUNTS:
            done = ("count", low)
        elif low[0].isdigit():
            number = low
        elif low not in FILLERS and low not in ",-":
            return None
        if done:
            if out.get(done[0], done[1]) != done[1]:
                return None
            out[done[0]] = done[1]
    return None if number is not None else out


def core_name(surface: str | None) -> tuple[str | None, dict[str, str]]:
    """A component's name without the measurements before it, and these; a name with other words before it stays whole."""
    m = re.search(rf"\b({'|'.join(CORES)})s?\s*$", surface or "", re.I)
    found = parsed(surface[: m.start()]) if m else None
    return (surface[m.start() :].strip(), found) if found else (surface, {})


def owner(text: str | None, core: str | None, products: list[str]) -> str | None:
    """The one product that a text names before a component; none if the words around say that it is shared, if two
    products are named, or none is. A product inside a longer one's name, or going on with letters or digits, is not named."""
    if not text or not core:
        return None
    at = text.lower().find(core.lower())
    if at < 0:
        return None
    start = text.rfind("\n", 0, at) + 1
    before, after = text[start:at], text[at + len(core) : at + len(core) + 40].split("\n")[0]
    if SHARED.search(before) or SHARED.search(after):
        return None
    taken, named = [], set()
    for p in sorted((p for p in products if p), key=lambda p: (-len(p), p)):
        for m in re.finditer(rf"(?<![A-Za-z0-9]){re.escape(p)}(?![A-Za-z0-9])", before, re.I):
            if all(m.end() <= a or b <= m.start() for a, b in taken):
                taken.append((m.start(), m.end()))
                named.add(p)
    return named.pop() if len(named) == 1 else None


def separated(surface: Column, text: Column, products: Column) -> Column:
    """A struct (core, attributes, owner, name): name is the core with its owner before it."""

    @F.pandas_udf("struct<core:string,attributes:map<string,string>,owner:string,name:string>")
    def split(s: pd.Series, t: pd.Series, p: pd.Series) -> pd.DataFrame:
        rows = []
        for x, said, known in zip(s, t, p):
            core, found = core_name(x)
            whose = owner(said, x, list(known) if known is not None else [])
            rows.append((core, found, whose, f"{whose} {core}" if whose and core else core))
        return pd.DataFrame(rows, columns=["core", "attributes", "owner", "name"]).astype(object)

    return split(surface, text, products)
