import hashlib
import random

import pytest

from gneiss.llm import lines as ln

BLANK = " \t\n\x0b\x0c\r"
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, chars=1):
    """The contract, line by line: (doc_id, n_lines, n_dropped, kept)."""
    key = lambda x: x.strip(BLANK).translate(FOLD)
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    gone = {k for k, d in held.items() if len(k) >= chars and len(d) >= least}
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if key(x) not in gone]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def found(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.select("row.doc_id", "n_lines", "n_dropped", "kept").collect()), key=repr)


def planted(seed, n=120):
    r = random.Random(seed)
    stock = ["Subscribe now", "  subscribe NOW\t", "", " ", " ", "Ärger", "ärger", "x\r", "X", "all rights reserved", " ", "\x0bdone\x0c", "Done", "\U0001f600", "a" * 3000]
    rows = []
    for i in range(n):
        t = "\n".join(r.choice(stock) if r.random() < 0.5 else f"own {i} {r.randrange(4)}" for _ in range(r.randrange(1, 9)))
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("least, chars", [(2, 1), (10, 1), (10, 5), (1, 1)])
def test_equal_to_brute_force(make, least, chars):
    rows = [*planted(least), (500, None), (501, ""), (502, "\n\n"), (503, "Subscribe now"), (504, "Subscribe now\nSubscribe now\n"), (505, "kept\n" * 5000 + "x")]
    assert found(ln.without_common_lines(make(rows), least, chars)) == sorted(brute(rows, least, chars), key=repr)


def test_a_line_counts_once_a_document(make):
    rows = [(i, "nine hold this") for i in range(9)] + [(20, "once more\n" * 30), (21, "twice")]
    assert all(d == 0 for _, _, d, _ in found(ln.without_common_lines(make(rows))))
    assert [d for i, _, d, _ in found(ln.without_common_lines(make([*rows, (30, "NINE hold this ")]))) if i in (0, 30)] == [1, 1]


def test_repeated_rows_are_one_document_and_so_are_rows_without_id(make):
    rows = [(1, "a line\nown")] * 12 + [(None, "a line")] * 5 + [(i, "a line") for i in range(2, 9)]
    assert found(ln.without_common_lines(make(rows))) == sorted(brute(rows, 10), key=repr)
    rows.append((9, "a line\nb"))
    assert found(ln.without_common_lines(make(rows))) == sorted(brute(rows, 10), key=repr)


def test_a_hot_line_and_many_common_ones(make):
    """More than a thousand common lines, one of them in every row: both sides of the join by key are taken."""
    rows = [(i, f"everywhere\ncommon {i % 1200}\nown {i}") for i in range(6000)]
    got = found(ln.without_common_lines(make(rows), 5))
    assert got == sorted(brute(rows, 5), key=repr) and all(d == 2 for _, _, d, _ in got)


def test_columns_stay_whatever_their_names(spark):
    names = ["text", "id", "row", "keys", "places", "lines", "kept", "pos", "a", "b", "blank", "n", "documents", "n_lines", "n_dropped", "doc_id", "n_chars"]
    schema = ", ".join(f"{c} {'string' if c == 'text' else 'long'}" for c in names)
    rows = [[f"footer\nbody {i}", *range(14), i, 99] for i in range(10)] + [[None, *[None] * 14, 50, None], ["quiet", *[None] * 14, 51, 7]]
    got = {r["doc_id"]: r for r in ln.drop_common_lines(spark.createDataFrame(rows, schema)).collect()}
    assert list(got[0].asDict()) == names and got[3]["text"] == "body 3" and got[3]["n_chars"] == 6 and got[3]["places"] == 3
    assert got[50]["text"] is None and (got[51]["text"], got[51]["n_chars"]) == ("quiet", 7)


def test_empty_table(make):
    assert ln.without_common_lines(make([])).count() == 0 and ln.drop_common_lines(make([])).count() == 0


def test_only_built_in_functions(make):
    df = ln.without_common_lines(make([(1, "a")]))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "MapInArrow" not in plan


def test_query(spark, tmp_path):
    rows = [*planted(77), (900, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in ln.op11_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    assert got == sorted((i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in brute(rows, 10))
