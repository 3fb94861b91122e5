import hashlib
import random
from collections import Counter

from gneiss.llm import substring as sub


def brute(rows, window=35):
    count, words = Counter(), [(t or "").encode().split() for _, t in rows]
    for w in words:
        count.update(tuple(w[j : j + window]) for j in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for j in range(len(w) - window + 1):
            if count[tuple(w[j : j + window])] > 1:
                gone |= set(range(j, j + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def cases(prose):
    shared, line = prose(60, 1), "same line of ten words that every text here has"
    rows = [(i, f"{prose(50 + i, 100 + i)} {shared} {prose(40, 200 + i)}") for i in range(6)]
    rows += [(10 + i, prose(300, 5)) for i in range(4)]  # copies
    rows += [(20, " ".join([prose(20, 6)] * 6)), (21, "a " * 200), (22, "a b " * 18), (23, "x " * 35), (24, "x " * 34)]
    rows += [(30 + i, f"{prose(30, 300 + i)}\n{line}\n{prose(30, 400 + i)}") for i in range(30)]
    rows += [(70, None), (71, ""), (72, " \t\n"), (73, "ü " * 40), (74, prose(34, 1)), (75, prose(35, 1)), (None, prose(80, 8)), (None, prose(80, 8)), (76, prose(20000, 9, 50))]
    return rows


def test_equals_brute_force(spark, make, prose):
    rows = cases(prose)
    got = sorted((tuple(r) for r in sub.remove_repeats(make(rows)).collect()), key=str)
    assert got == brute(rows)


def test_hot_values_dealt_by_window(make, prose, monkeypatch):
    monkeypatch.setattr(sub, "HOT", 2)
    rows = cases(prose)
    got = sorted((tuple(r) for r in sub.remove_repeats(make(rows)).collect()), key=str)
    assert got == brute(rows)


def test_automaton_equals_brute_force():
    r = random.Random(4)
    for _ in range(150):
        texts = [[b"%d" % r.randrange(3) for _ in range(r.randrange(1, 25))] for _ in range(r.randrange(1, 5))]
        texts = [list(t) for t in dict.fromkeys(map(tuple, texts))]
        counts = [r.randrange(1, 3) for _ in texts]
        n = r.randrange(2, 6)
        seen = Counter()
        for t, c in zip(texts, counts):
            for j in range(len(t) - n + 1):
                seen[tuple(t[j : j + n])] += c
        for t, spans in zip(texts, sub.repeated_windows(texts, counts, n)):
            want = {k for j in range(len(t) - n + 1) if seen[tuple(t[j : j + n])] > 1 for k in range(j, j + n)}
            assert want == {k for a, b in spans for k in range(a, b)}


def test_texts_without_repeats_stay_as_they_are(make, prose):
    docs = make([(1, "A  text\twith\n\nspaces"), (2, prose(50, 3) + "\n" + prose(5, 7)), (3, prose(50, 3)), (4, None)])
    out = sub.cut_repeats(docs)
    assert out.schema == docs.schema
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] == "A  text\twith\n\nspaces" and got[4]["text"] is None and got[4]["n_chars"] is None
    assert got[2]["text"] == prose(5, 7) and got[3]["text"] == "" and got[2]["n_chars"] == len(got[2]["text"])
    assert got[2]["gneiss"] == "x" and sub.cut_repeats(make([])).count() == 0
