"""Predicates that are more than one comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(df: DataFrame, **values) -> DataFrame:
    """Equality on every given column that is not None; an unknown name is an error."""
    unknown = set(values) - set(df.columns)
    if unknown:
        raise ValueError(f"no such filter: {', '.join(sorted(unknown))}")
    for name, v in values.items():
        if v is not None:
            df = df.filter(F.col(name) == v)
    return df


def contains_all(tags: Column, wanted: list[str]) -> Column:
    """Whether an array holds every wanted value."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0


def triple_faults(subject: Column, predicate: Column, object_: Column, most_chars: int = 80, predicate_chars: int = 60, most_words: int = 8) -> Column:
    """Reasons why a triple is not well formed, in a fixed order; none if it is."""
    empty = lambda c: F.trim(c) == ""
    reasons = [
        ("empty", empty(subject) | empty(predicate) | empty(object_)),
        ("self_loop", F.lower(subject) == F.lower(object_)),
        ("pronoun", F.lower(subject).isin("it", "this", "that", "they") | F.lower(object_).isin("it", "this", "that", "they")),
        ("long", (F.length(subject) > most_chars) | (F.length(object_) > most_chars)),
        ("sentences", subject.rlike(r"[.!?]\s+\S") | object_.rlike(r"[.!?]\s+\S")),
        ("predicate", (F.length(predicate) > predicate_chars) | (F.size(F.split(predicate, " ")) > most_words)),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in reasons)))
