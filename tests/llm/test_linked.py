"""The pipeline's near-duplicate stage goes by SimHash links first, then by exact likeness."""

import corpus_pipeline as cp
from gneiss.llm.simhash import fingerprint


def test_linked_fingerprints_go_and_so_do_alike_rows_beyond_the_radius(spark, make, prose):
    far = lambda a, b: bin(fingerprint(a.encode()) ^ fingerprint(b.encode())).count("1")
    # One sentence many times and an end of its own: fingerprints are the sentence's, sets of shingles mostly differ.
    said = [f"{(prose(9, 50) + ' ') * 40}{prose(15, 60 + i)}" for i in range(2)]
    assert far(*said) <= 3
    words = prose(300, 1).split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in range(0, 300, 7)]
    beyond = max(near, key=lambda t: far(" ".join(words), t))
    assert far(" ".join(words), beyond) > 3
    rows = [(1, " ".join(words)), (2, beyond), (3, prose(200, 77)), (4, said[0]), (5, said[1])]
    assert {r["doc_id"] for r in cp.simhash_near_dedup(spark, make(rows), "").collect()} == {1, 3, 4}
