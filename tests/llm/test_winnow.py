import hashlib
import random

import numpy as np

from gneiss.llm import winnow as win


def test_window_minima_are_rightmost():
    r = random.Random(1)
    for n in (0, 1, 2, 96, 97, 98, 300, 700):
        h = np.array([r.randrange(5) << 40 for _ in range(n)], np.uint64)
        w = min(97, n)
        want = []
        for s in range(n - w + 1 if n else 0):
            p = max((s + j for j in range(w)), key=lambda k: (-int(h[k]), k))
            if not want or want[-1] != p:
                want.append(p)
        assert win.window_least(h).tolist() == want


def test_long_texts_in_pieces(monkeypatch):
    r = random.Random(2)
    h = np.array([r.getrandbits(64) for _ in range(3000)], np.uint64)
    whole = win.window_least(h).tolist()
    monkeypatch.setattr(win, "PIECE", 500)
    assert win.window_least(h).tolist() == whole


def test_shared_passages_share_a_hash():
    r = random.Random(3)
    for _ in range(30):
        text = lambda n: "".join(r.choice("abcd ") for _ in range(n))
        shared = text(win.K + win.W - 1)
        a, b = win.fingerprint(text(300) + shared + text(200)), win.fingerprint(text(77) + shared)
        assert set(a[0].tolist()) & set(b[0].tolist())


def test_every_row_against_its_edit_and_its_next(make, prose):
    rows = [(i * 3, prose(20 + 9 * i, i % 9)) for i in range(120)] + [(1000, ""), (1001, None), (1002, "é日😀"), (1003, "x"), (-5, "first of all")]
    got = {r["doc_id"]: r for r in win.compare_edits(make(rows)).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        a, b, c = win.fingerprint(t), win.fingerprint(new), win.fingerprint(after)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (win.as_string(*a), win.as_string(*b))
        assert (r["near_edited"], r["near_next"]) == (win.likeness(a[0], b[0]), win.likeness(a[0], c[0]))


def test_repeated_and_null_ids(make):
    rows = [(1, "same text"), (1, "same text"), (None, "a"), (None, None), (2, "b")]
    assert win.compare_edits(make(rows)).count() == 5
    lone = win.compare_edits(make([(4, "alone here")])).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1.0
    assert win.compare_edits(make([])).count() == 0


def test_half_edited_short_texts_share_a_hash():
    r = random.Random(4)
    for n in range(60, 301):
        text, after = ("".join(r.choice("abcdefgh ") for _ in range(n)) for _ in range(2))
        a, b = win.fingerprint(text), win.fingerprint(win.edited(text, after))
        assert win.likeness(a[0], b[0]) > 0
