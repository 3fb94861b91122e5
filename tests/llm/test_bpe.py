import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from gneiss.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    with open(P.path(bpe.RANKS), "rb") as f:
        return bpe.load_ranks(f.read())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(1)
    signs = "aAthéßñ 日本語😀\n\t.,!!'s 0123٣̈‍\xa0 \r"
    out = ["", " ", "a", "<|endoftext|>", "don't WE'LL 12345", "x" * 5000, "́" * 40, "🏳️‍🌈" * 9, " " * 300 + "end", "Donaudampfschifffahrtsgesellschaft" * 20]
    out += ["".join(r.choice(signs) for _ in range(r.randrange(80))) for _ in range(3000)]
    out += ["".join(chr(r.choice((r.randrange(32, 0x250), r.randrange(0x370, 0xD7FF), r.randrange(0xE000, 0x1FFFF)))) for _ in range(60)) for _ in range(300)]
    return out + ["".join(r.choice(["th", "er", "on", "an", "re", "ed", "tion", " ", "heit", "sch"]) for _ in range(400)) for _ in range(60)]


def test_equals_the_library_and_decodes(ranks, reference):
    codec = bpe.Codec(ranks, P.PATTERN)
    for t in texts():
        ids = codec.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert codec.decode(ids) == (t.encode(), True)


def test_full_caches_change_nothing(ranks, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 50)
    monkeypatch.setattr(bpe, "MOST_PIECES", 20)
    codec = bpe.Codec(ranks, P.PATTERN)
    for t in texts()[:400]:
        assert codec.encode(t) == reference.encode_ordinary(t)


def test_transducer_equals_merging_for_any_bytes():
    r = random.Random(2)
    letters = [b"a", b"b", b"c"]
    for _ in range(40):
        vocabulary = list(letters)
        while len(vocabulary) < 25:
            t = r.choice(vocabulary) + r.choice(vocabulary)
            if t not in vocabulary:
                vocabulary.append(t)
        fst = bpe.MergeTransducer({t: i for i, t in enumerate(vocabulary)})
        for _ in range(60):
            piece = b"".join(r.choice(letters) for _ in range(r.randrange(1, 20)))
            want = (fst.ranks[piece],) if piece in fst.ranks else fst.merge(piece)
            assert fst.encode(piece) == want


def test_ids_come_before_the_end(ranks):
    fst = bpe.MergeTransducer(ranks)
    state, early = 0, []
    for byte in b"international cooperation agreements":
        state, ids = fst.step(state, byte)
        early += ids
    assert early and (*early, *fst.ends[state]) == fst.encode(b"international cooperation agreements")


def test_decoder_state_machine(ranks):
    codec = bpe.Codec(ranks, P.PATTERN)
    byte = lambda b: ranks[bytes((b,))]
    for good in ("é", "日", "😀", "퟿", "￿"):
        assert codec.decode([byte(b) for b in good.encode()]) == (good.encode(), True)
    for bad in (b"\xc3", b"\x80", b"\xe0\x80\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xc0\xaf", b"\xff", b"\xe6\x97a"):
        assert codec.decode([byte(b) for b in bad]) == (bad, False)


def test_decoding_in_parts_at_every_split(ranks):
    codec, byte = bpe.Codec(ranks, P.PATTERN), lambda b: ranks[bytes((b,))]
    for text in ("aé日😀z", "no 日本語 here", "🏳️‍🌈"):
        for ids in (codec.encode(text), [byte(b) for b in text.encode()]):
            for cut in range(len(ids) + 1):
                d = bpe.StreamDecoder(ranks)
                first = d.feed(ids[:cut])
                first.decode()  # only whole characters go out
                second = d.feed(ids[cut:])
                assert (first + second).decode() == text
                assert d.end() == (b"", True)


def test_a_character_that_never_ends_is_held(ranks):
    byte = lambda b: ranks[bytes((b,))]
    d = bpe.StreamDecoder(ranks)
    assert d.feed([byte(b) for b in b"a\xe6\x97"]) == b"a"
    assert d.end() == (b"\xe6\x97", False)
    assert d.feed([byte(b) for b in b"\xe6b\xc3\xa9"]) == "".join(["\ufffdb", "é"]).encode().replace("\ufffd".encode(), b"\xe6")
    assert d.end() == (b"", False)


def test_query_rows(make, reference):
    rows = [(1, "The end."), (2, None), (3, ""), (1, "The end."), (None, "é" * 3000)]
    got = sorted((tuple(r) for r in bpe.encode_decode(make(rows)).collect()), key=str)
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True))
    assert got == sorted(want, key=str)
    assert bpe.encode_decode(make([])).count() == 0
