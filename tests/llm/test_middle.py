import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.llm import middle as md


def contract(doc_id, text):
    """form, output, n, prefix_chars, middle_chars from the definition, with Python strings."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return "plain", text, n, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return ("spm", f"<S>{s}<P>{p}<M>{m}", n, a, b - a) if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}", n, a, b - a)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**12), st.text(alphabet=st.sampled_from("ab<PSM>\n é\U0001f600́"), max_size=40))
def test_contract_and_round_trip(i, text):
    got = md.rearranged(text, i)
    assert (got[0], got[1], got[2], got[3], got[4]) == contract(i, text)
    assert md.restored(got[1], got[0]) == text


@pytest.mark.parametrize("unit, pattern", [("char", r"(?s)."), ("word", r"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"), ("line", r"[^\n]*\n|[^\n]+")])
@settings(max_examples=100, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("ab \t\né\U0001f600"), max_size=40))
def test_boundaries_are_those_of_a_plain_search(unit, pattern, text):
    want = [0, *(m.end() for m in re.finditer(pattern, text))]
    assert md.boundaries(md.code_points(text), unit).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.sampled_from(["word", "line"]), st.integers(0, 10**6), st.text(alphabet=st.sampled_from("ab< \nSM>"), max_size=60))
def test_units_are_never_cut(unit, i, text):
    form, output, _, a, m = md.rearranged(text, i, unit, rate=100, spm=50)
    assert md.restored(output, form) == text
    if form != "plain":
        at = md.boundaries(md.code_points(text), unit)
        assert a in at and a + m in at


def test_unknown_unit():
    with pytest.raises(ValueError):
        md.boundaries(np.zeros(2, np.uint32), "sentence")


def test_rows_of_a_table(make):
    rows = [*((i, f"text number {i}\nsecond \U0001f600 line") for i in range(300)), (7, "again"), (7, "again"), (None, "no id"), (400, None), (401, ""), (402, "has <S> in it"), (403, "x" * 2_000_000), (404, "<S"), (405, ">")]
    got = sorted(((r["row"]["doc_id"], r["form"], r["output"], r["n"], r["prefix_chars"], r["middle_chars"]) for r in md.fill_in_middle(make(rows)).collect()), key=repr)
    assert got == sorted(((i, *contract(i, t or "")) for i, t in rows), key=repr)
    forms = [g[1] for g in got]
    assert min(forms.count(f) for f in ("psm", "spm", "plain")) > 20


def test_extra_columns_and_empty_tables(spark, make):
    df = spark.createDataFrame([("t", 5, 1, 2, 3)], "text string, doc_id long, n long, form long, row long")
    row = md.fill_in_middle(df).first()
    assert row["row"].asDict() == {"text": "t", "doc_id": 5, "n": 1, "form": 2, "row": 3} and row["n"] == 1
    assert md.fill_in_middle(make([])).count() == 0


def test_query_gives_digests(spark, tmp_path):
    rows = [(i, f"doc {i} ü" * (i % 7)) for i in range(200)] + [(900, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in rows:
        form, output, n, a, m = contract(i, t or "")
        want.append((i, n, form, a, m, sha(output), sha(t or "")))
    got = md.op12_fill_in_middle(spark, str(tmp_path)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
