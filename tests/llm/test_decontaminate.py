import hashlib
import random
import re

from gneiss.llm import decontaminate as dec

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    pats = {}
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - 12) if w else 0):
            pats.setdefault(tuple(w[j : j + 13]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for p, who in pats.items():
            for j in range(len(w) - len(p) + 1):
                if tuple(w[j : j + len(p)]) == p:
                    hit |= set(range(j, j + len(p)))
                    found |= who
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def cases(prose):
    items = [(i, prose(13 + 3 * i, 50 + i)) for i in range(8)] + [(20, "Solo!"), (21, "two-words"), (22, ""), (23, None), (24, "...!"), (25, "été ñandú"), (26, "a b " * 20), (27, prose(13, 50))]
    docs = [(i, f"{prose(30, i)}. {items[i % 8][1].upper().replace(' ', ', ', 3)}; {prose(15 * i, 90 + i)}") for i in range(16)]
    docs += [(100, None), (101, ""), (102, "-"), (103, "solo"), (104, "SOLO two words"), (105, "Été ñandú été ñandú"), (106, "a b " * 40), (107, prose(500, 7)), (107, prose(500, 7)), (None, items[0][1]), (108, "two words " * 3000)]
    return docs, items


def test_equals_brute_force(spark, make, prose):
    docs, items = cases(prose)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in dec.find_contamination(make(docs), bench).collect()), key=str)
    assert got == brute(docs, items)


def test_items_in_several_blocks(spark, make, prose, monkeypatch):
    monkeypatch.setattr(dec, "BLOCK_BYTES", 150)
    docs, items = cases(prose)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(dec._blocks(bench))) > 2
    got = sorted((tuple(r) for r in dec.find_contamination(make(docs), bench).collect()), key=str)
    want = brute(docs, items)
    assert got == want
    kept = sorted(str(r["doc_id"]) for r in dec.drop_contaminated(make(docs), bench).collect())
    assert kept == sorted(str(r[0]) for r in want if not r[5])


def test_search_over_few_words():
    r = random.Random(5)
    for _ in range(200):
        n = r.randrange(1, 6)
        items = [(k, [b"%d" % r.randrange(2) for _ in range(r.randrange(1, 9))]) for k in range(3)]
        text = [b"%d" % r.randrange(2) for _ in range(r.randrange(0, 30))]
        search = dec.WordSearch(items, n)
        want = {(j, p) for p in search.owners for j in range(len(text) - len(p) + 1) if tuple(text[j : j + len(p)]) == p}
        assert set(search.find(text)) == want


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in dec.find_contamination(make([(1, "a"), (2, None)]), none).collect())
    assert dec.find_contamination(make([]), none).count() == 0
    assert dec.drop_contaminated(make([(1, "a")]), none).count() == 1
