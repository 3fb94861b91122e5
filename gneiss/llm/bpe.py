"""Operator 7, byte-level BPE as a lazily determinised finite-state transducer, with a streaming decoder.

A sequence of tokens is what the merges make of its bytes exactly if that holds for each token and for each two
neighbours alone, and every byte string has one such sequence. So the merges compile into a transducer with a state
per token last written, whose arcs read the bytes of a token that may follow. It is nondeterministic (a token may go
on or end), and determinised step by step as texts need it: a state is the set of live hypotheses (bytes of a token
begun, token before it, ids not yet certain). Ids on which all hypotheses agree are emitted, at most one longest
token after their last byte was read; the merges themselves run once for each pair of tokens that comes up.
"""

from __future__ import annotations

import base64
import hashlib
from functools import partial
from itertools import chain

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import map_batches, once, prepare, table

RANKS = "byte_bpe_multi_50k.tiktoken"
# Code points that the regex module's Unicode tables have as letters and numbers and those of version 16,
# which the tokeniser's library goes by, have not.
LATER_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A "
    "11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 "
    "1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E "
    "2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: States, and pieces with their output, that a worker keeps; at this many it starts over.
MOST_STATES, MOST_PIECES = 400_000, 300_000
#: Pairs of tokens whose verdict it keeps.
MOST_PAIRS = 500_000
#: Above every rank.
NONE = 1 << 40


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class MergeTransducer:
    START = ((b"", -1, ()),)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.begun = {t[:i] for t in ranks for i in range(1, len(t))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[tuple, int] = {self.START: 0}
        self.states: list[tuple] = [self.START]
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: list[tuple[int, ...]] = [()]

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The definition: the lowest rank among neighbours merges first, leftmost on ties."""
        rank, parts = self.ranks.get, [piece[i : i + 1] for i in range(len(piece))]
        costs = [rank(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
        while costs:
            best = min(costs)
            if best == NONE:
                break
            at = costs.index(best)
            joined = parts[at] + parts[at + 1]
            parts[at : at + 2] = (joined,)
            del costs[at]
            if at:
                costs[at - 1] = rank(parts[at - 1] + joined, NONE)
            if at < len(costs):
                costs[at] = rank(joined + parts[at + 1], NONE)
        return tuple(map(self.ranks.__getitem__, parts))

    def follows(self, before: int, token: int) -> bool:
        """Whether token (at the start: -1) stays as it is after the token before it."""
        found = self.pairs.get((before, token))
        if found is None:
            if before < 0:
                found = self.merge(self.bytes_of[token]) == (token,)
            else:
                found = self.follows(-1, token) and self.merge(self.bytes_of[before] + self.bytes_of[token]) == (before, token)
            self.pairs[(before, token)] = found
        return found

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Next state and the ids emitted on the way."""
        live = []
        for part, before, held in self.states[state]:
            read = part + bytes((byte,))
            if read in self.begun:
                live.append((read, before, held))
            token = self.ranks.get(read)
            if token is not None and self.follows(before, token):
                live.append((b"", token, (*held, token)))
        shared = 0
        first = live[0][2]
        while all(len(h) > shared and h[shared] == first[shared] for _, _, h in live):
            shared += 1
        state_set = tuple((part, before, held[shared:]) for part, before, held in live)
        number = self.numbers.get(state_set)
        if number is None:
            number = self.numbers[state_set] = len(self.states)
            self.states.append(state_set)
            self.ends.append(next(held for part, _, held in state_set if not part))
        found = self.moves[state << 8 | byte] = (number, first[:shared])
        return found

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece; a piece that is a token as a whole is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.states) > MOST_STATES:
            self._reset()
        if len(self.pairs) > MOST_PAIRS:
            self.pairs.clear()
        out: tuple[int, ...] = ()
        state, moves = 0, self.moves
        for byte in piece:
            found = moves.get(state << 8 | byte)
            state, ids = found if found is not None else self.step(state, byte)
            if ids:
                out += ids
        return out + self.ends[state]


def _utf8_step(state: tuple[int, int, int], byte: int) -> tuple[tuple[int, int, int], bool]:
    """One byte of the UTF-8 state machine. state: continuation bytes to come and the next one's range; and whether the byte fits."""
    left, low, high = state
    if left:
        return ((left - 1, 0x80, 0xBF) if left > 1 else (0, 0, 0), True) if low <= byte <= high else ((0, 0, 0), False)
    if byte < 0x80:
        return (0, 0, 0), True
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF), True
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF), True
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF), True
    return (0, 0, 0), False


class StreamDecoder:
    """ids to bytes by the UTF-8 state machine, some ids after others: a character goes out as its last byte comes in.

    Bytes of a character begun are held until it is whole, in whichever later call; bytes that fit no character go out
    as they are, and are remembered in well. Moves (state, id) are kept once made.
    """

    START = (0, 0, 0)

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        # Of usual tokens, which start and end between characters: their bytes; they leave the machine where it was.
        self.whole = [b if b and self._walk(self.START, 0, b) == (self.START, True, 0) else None for b in self.bytes_of]
        self.moves: dict[tuple, tuple] = {}
        self.begin()

    def begin(self) -> None:
        self.state, self.held, self.well = self.START, b"", True

    def _walk(self, state: tuple[int, int, int], begun: int, token: bytes) -> tuple[tuple[int, int, int], bool, int]:
        """From a state with begun bytes held: the state after token, whether all bytes fit, and how many to hold then."""
        ok, start = True, -begun
        for at, byte in enumerate(token):
            if not state[0]:
                start = at
            state, fits = _utf8_step(state, byte)
            if not fits:
                ok, start = False, at
                state, _ = _utf8_step(self.START, byte)  # a character broken off: this byte may begin one
        return state, ok, len(token) - start if state[0] else 0

    def feed(self, ids: list[int]) -> bytes:
        """The bytes of all characters that are complete with these ids."""
        whole, out = self.whole, []
        for i in ids:
            if not self.held and whole[i] is not None:
                out.append(whole[i])
                continue
            at = (self.state, len(self.held), i)
            move = self.moves.get(at)
            if move is None:
                if len(self.moves) > MOST_STATES:
                    self.moves.clear()
                move = self.moves[at] = self._walk(self.state, len(self.held), self.bytes_of[i])
            self.state, ok, hold = move
            self.well = self.well and ok
            ready = self.held + self.bytes_of[i]
            out.append(ready[: len(ready) - hold])
            self.held = ready[len(ready) - hold :]
        return b"".join(out)

    def end(self) -> tuple[bytes, bool]:
        """What is held of a character that never ended, and whether all was well-formed; the machine begins anew."""
        last = self.held, self.well and not self.held
        self.begin()
        return last

    def decode(self, ids: list[int]) -> tuple[bytes, bool]:
        """All bytes of one sequence, and whether they are well-formed UTF-8."""
        self.begin()
        out = self.feed(ids)
        rest, well = self.end()
        return out + rest, well


def exact_pattern(pattern: str) -> str:
    """The pattern with letters and numbers as Unicode 16 has them."""
    for name, later in ((r"\p{L}", LATER_LETTERS), (r"\p{N}", LATER_NUMBERS)):
        points = "".join("-".join(rf"\U{int(p, 16):08X}" for p in x.split("-")) for x in later.split())
        pattern = pattern.replace(name, f"[{name}--[{points}]]")
    return f"(?V1){pattern}"


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.fst, self.decoder = MergeTransducer(ranks), StreamDecoder(ranks)
        self.find_latin, self.find_any = regex.compile(pattern).findall, regex.compile(exact_pattern(pattern)).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def find(self, text: str) -> list[str]:
        """The pieces of a text. Latin-1 texts need no exceptions and take the quicker pattern."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find_any(text)
        return self.find_latin(text)

    def encode(self, text: str) -> list[int]:
        if len(self.pieces) > MOST_PIECES:  # two generations: what is in use moves over
            self.pieces, self.older = {}, self.pieces
        known, pieces, at = self.pieces, self.find(text), 0
        found = list(map(known.get, pieces))
        for _ in range(found.count(None)):
            at = found.index(None, at)
            p = pieces[at]
            found[at] = known[p] = known.get(p) or self.older.get(p) or self.fst.encode(p.encode())
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> tuple[bytes, bool]:
        return self.decoder.decode(ids)


def codec_of(spark: SparkSession, path: str | None = None, pattern: str | None = None):
    """A function giving a worker its codec, from a rank file of fixed size (a broadcast of under 1 MB)."""
    if path is None or pattern is None:
        import public_tokenizers as P

        path, pattern = path or P.path(RANKS), pattern or P.PATTERN
    with open(path, "rb") as f:
        data = f.read()
    sent, key = spark.sparkContext.broadcast(data), f"bpe-{hashlib.sha256(data + pattern.encode()).hexdigest()}"
    return partial(_codec, sent, key, pattern)


def _codec(sent, key: str, pattern: str) -> Codec:
    return once(key, lambda: Codec(load_ranks(sent.value), pattern))


def encode_decode(docs: DataFrame, path: str | None = None, pattern: str | None = None, ids: bool = False) -> DataFrame:
    """For each row of docs(doc_id, text): n_tokens, ids_sha256, decoded_sha256, well_formed (and, if asked for, ids).

    Null texts count as ""; an empty text has no tokens; repeated rows give a row each; an empty table gives none;
    other columns, whatever their names, are ignored. The decoded bytes are the text's UTF-8 bytes.
    """
    spark = docs.sparkSession
    prepare(spark)
    make, kind = codec_of(spark, path, pattern), dict(docs.dtypes)["doc_id"]

    def fn(cols: dict[str, list]) -> dict[str, list]:
        codec = make()
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "well_formed": [], "ids": []}
        name = DECIMALS.__getitem__
        for text in cols["text"]:
            tokens = codec.encode(text or "")
            if tokens and max(tokens) >= len(DECIMALS):
                DECIMALS.extend(map(str, range(len(DECIMALS), max(tokens) + 1)))
            back, well = codec.decode(tokens)
            out["n_tokens"].append(len(tokens))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(name, tokens)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            out["well_formed"].append(well)
            out["ids"].append(tokens if ids else None)
        return out

    more = ", ids array<int>" if ids else ""
    return map_batches(docs.select("doc_id", "text"), fn, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, well_formed boolean{more}")


#: Decimal texts of ids, filled as needed.
DECIMALS: list[str] = []


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode_decode of all documents by the ranks and pattern of the contract; edge cases as there."""
    return encode_decode(table(spark, sf_dir, "documents").select("doc_id", F.col("text")))
