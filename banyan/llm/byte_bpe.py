"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Two tokens may stand side by side in an encoding if no merge across their
border comes before the merges that made them, and a sequence of tokens is the
encoding of its bytes if all its neighbours may.  So the merges compile to a
transducer that reads bytes, guesses where tokens end and allows a token only
after one that it may follow.  Every head of a word has one encoding, so for
each border one guess is right at most.

The transducer is determinised while it runs: a state is the set of guesses
that are still alive, each with its last token and the bytes of the token that
it is in, and a transition gives the last token of what has been read.  A guess
lives as long as some token starts with its bytes,
so all borders that are open lie within one longest token, and what stands
before the last border that all of them share is decided: it is emitted at the
word's end, in a long word after every ``BLOCK`` bytes.  States and transitions
are kept as they are met; once there are ``STATES`` of them those stay, as common
words come first, and others are made anew each time, so memory is bounded and
results don't change.  When ``RENEW`` times as many were made so, other words may
have become common: all are forgotten and kept as they are met again.

Pieces are the matches of the vocabulary's pattern.  A piece that is a token is
that token, as in the tiktoken library.  The pattern's classes are those of that
library's Unicode version, which is asked once for each character.

Decoding feeds tokens to a UTF-8 state machine that keeps at most three bytes
between them: a character is given out when its last byte has come, and each
maximal part that can't be a character becomes U+FFFD.

Null texts count as empty: no ids.  Rows are encoded whole and one by one, texts
of any length in time that grows with their bytes; repeated rows, ties and
further columns change nothing; an empty table gives no rows.  Bytes of a text
that are no UTF-8 become U+FFFD before they are encoded.
"""

from __future__ import annotations

import base64
import hashlib
import string
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: A worker keeps so many states and answers on neighbours; the ids of so many words, of so many characters each.
STATES, PAIRS, CACHE, KEEP = 200_000, 1_000_000, 600_000, 48
#: States that are not kept, by those that are, after which all are forgotten.
RENEW = 4
#: Bytes of a long word whose last tokens wait at most before those that are decided go out.
BLOCK = 4096
#: What stands for a character whose class the pattern's library tells otherwise than ours: by letter, number, other.
STAND_INS = {"L": "x", "N": "7", "": "☃"}
REPLACEMENT = "�"
#: Marks that stand after words: a run of them is one piece.
MARKS = string.punctuation
NEVER = 1 << 60


class Merges:
    """Which tokens may follow which. ranks: by token its id, which is its merge's place in order."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self._joins: dict[int, tuple[int, int] | None] = {}
        #: By both tokens what follows told before.
        self.kept: dict[int, bool] = {}

    def joins(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins; None if merges never make it."""
        if token not in self._joins:
            parts, last = [bytes([b]) for b in self.tokens[token]], None
            while len(parts) > 1:
                rank, k = min(((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1)))
                if rank == NEVER:
                    break
                last = (self.ranks[parts[k]], self.ranks[parts[k + 1]])
                if any(len(p) > 1 and self.ranks[p] > rank for p in parts[k : k + 2]):
                    raise ValueError("a token comes before those that it is made of")
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self._joins[token] = last if len(parts) == 1 else None
        return self._joins[token]

    def made(self, token: int) -> bool:
        """Whether merges ever make a token."""
        return len(self.tokens[token]) == 1 or self.joins(token) is not None

    def _rank(self, token: int) -> int:
        return token if len(self.tokens[token]) > 1 else -1

    def follows(self, a: int, b: int) -> bool:
        """Whether an encoding can have tokens a (-1: none) and b as neighbours."""
        key = a << 32 | b
        found = self.kept.get(key)
        if found is None:
            if len(self.kept) >= PAIRS:
                self.kept.clear()
            found = self.kept[key] = self.made(b) and (a < 0 or self._tell(a, b))
        return found

    def _tell(self, a: int, b: int) -> bool:
        left = right = NEVER  # the merges that take a's last part and b's first part further
        while True:
            across = self.ranks.get(self.tokens[a] + self.tokens[b], NEVER)
            # of equal merges the left one comes first
            if across < left and across <= right:
                return False
            ra, rb = self._rank(a), self._rank(b)
            if ra > rb:
                left, a = ra, self.joins(a)[1]
            elif rb >= 0:
                right, b = rb, self.joins(b)[0]
            else:
                return True


#: Bits of a guess: above them its last token (-1: none), in them the place in the tokens' tree of the bytes after it.
NODE = 24
PLACE = (1 << NODE) - 1


class State(dict):
    """By byte the next state, which is made when it is first asked for."""

    __slots__ = ("guesses", "last", "size", "make")

    def __init__(self, guesses: tuple[int, ...], size: int, make):
        self.guesses = guesses
        #: The last token of what has been read (-1: none), and its bytes.
        self.last, self.size, self.make = guesses[-1] >> NODE, size, make

    def __missing__(self, byte: int) -> State:
        return self.make(self, byte)


class Transducer:
    """Bytes in, tokens out."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self.sizes = {i: len(t) for t, i in ranks.items()}
        #: The tree: by place and byte the next place; by place the token that ends there, the bytes so far, and whether longer tokens go on.
        self.child: dict[int, int] = {}
        self.token, self.depth, self.goes_on = [-1], [0], [False]
        for t, i in ranks.items():
            at = 0
            for byte in t:
                down = self.child.get(at << 8 | byte)
                if down is None:
                    down = self.child[at << 8 | byte] = len(self.token)
                    self.goes_on[at] = True
                    self.token.append(-1)
                    self.depth.append(self.depth[at] + 1)
                    self.goes_on.append(False)
                at = down
            self.token[at] = i
        if len(self.token) > PLACE:
            raise ValueError("too many tokens")
        self.start = State((-1 << NODE,), 0, self._step)
        #: By guesses.
        self.states: dict[tuple[int, ...], State] = {}
        self._clear()

    def _clear(self) -> None:
        for state in self.states.values():
            state.clear()  # states point at each other in circles
        self.states = {self.start.guesses: self.start}
        #: States made since the table is full.
        self.passed = 0

    def _step(self, state: State, byte: int) -> State:
        """The next state; kept while there is room."""
        alive = []
        whole = -1
        child, ends, goes_on, may_follow = self.child, self.token, self.goes_on, self.merges.kept
        for guess in state.guesses:
            down = child.get((guess & PLACE) << 8 | byte)
            if down is None:
                continue
            last = guess & ~PLACE
            # of all guesses one is right at most
            if whole < 0 and (token := ends[down]) >= 0:
                may = may_follow.get(last << 32 - NODE | token)
                if may or may is None and self.merges.follows(guess >> NODE, token):
                    whole = token
            if goes_on[down]:
                alive.append(last | down)
        alive.append(whole << NODE)
        guesses = tuple(alive)
        found = self.states.get(guesses)
        if found is None:
            found = State(guesses, self.sizes[whole], self._step)
            if len(self.states) >= STATES:
                self.passed += 1
                if self.passed < RENEW * STATES:
                    return found
                self._clear()
            self.states[guesses] = found
        state[byte] = found
        return found

    def _shared(self, path: list[State], at: State) -> int:
        """Bytes, of those that the path has a state for, up to the border that all guesses of its last state have."""
        borders = {len(path) - self.depth[guess & PLACE] for guess in at.guesses}
        while len(borders) > 1:
            far = max(borders)
            borders.remove(far)
            borders.add(far - path[far - 1].size)
        return borders.pop()

    @staticmethod
    def _tokens(path: list[State], end: int) -> list[int]:
        out = []
        while end > 0:
            state = path[end - 1]
            out.append(state.last)
            end -= state.size
        out.reverse()
        return out

    def __call__(self, word: bytes) -> bytes:
        """Packed unsigned 32-bit ids of the word's encoding by merges."""
        at = self.start
        if len(word) <= BLOCK:
            path = [at := at[byte] for byte in word]
            return array("I", self._tokens(path, len(path))).tobytes()
        out, path = array("I"), []
        for a in range(0, len(word), BLOCK):
            path += [at := at[byte] for byte in word[a : a + BLOCK]]
            n = self._shared(path, at)
            out.extend(self._tokens(path, n))
            del path[:n]
        out.extend(self._tokens(path, len(path)))
        return out.tobytes()


class Words(dict):
    """Packed ids of what was asked before; a full one keeps what it has and makes the rest anew."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= KEEP and len(self) < CACHE:
            self[key] = value
        return value


class Encoder:
    """Packed little-endian unsigned 32-bit ids of texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.ranks = ranks
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern).finditer
        single = {bytes([b]): b for b in range(256)}
        self.theirs = {k: tiktoken.Encoding(k, pat_str=rf"\p{{{k}}}", mergeable_ranks=single, special_tokens={}).encode_ordinary for k in "LN"}
        self.ours = {k: regex.compile(rf"\p{{{k}}}").match for k in "LN"}
        self.known: set[str] = set(map(chr, range(128)))
        self.stands: dict[int, str] = {}
        self.pieces = Words(self.piece)
        self.words = Words(self.word)
        self.heads = Words(self.head)
        self.newline = self.piece("\n")
        self.runs = regex.compile(r" (?:\s|$)").search

    def piece(self, piece: str) -> bytes:
        x = piece.encode()
        own = self.ranks.get(x)
        return self.transducer(x) if own is None else array("I", [own]).tobytes()

    def word(self, word: str) -> bytes:
        """What stands between two spaces, with the first of them."""
        if word.isalpha():
            return self.piece(f" {word}")
        core = word.rstrip(MARKS)
        if core != word and core.isalpha():
            return self.words[core] + self.pieces[word[len(core) :]]
        return self.whole(f" {word}")

    def head(self, word: str) -> bytes:
        """What stands before the first space of a line."""
        if word.isalpha():
            return self.piece(word)
        core = word.rstrip(MARKS)
        if core != word and core.isalpha():
            return self.heads[core] + self.pieces[word[len(core) :]]
        return self.whole(word)

    def masked(self, text: str) -> str:
        """The text, with stand-ins for characters whose class the two libraries tell apart."""
        if text.isascii():
            return text
        for c in set(text).difference(self.known):
            if len(self.known) < CACHE:
                self.known.add(c)
            theirs = next((k for k in "LN" if self.theirs[k](c)), "")
            if theirs != next((k for k in "LN" if self.ours[k](c)), ""):
                self.stands[ord(c)] = STAND_INS[theirs]
        return text.translate(self.stands) if self.stands else text

    def whole(self, text: str) -> bytes:
        return b"".join([self.pieces[text[m.start() : m.end()]] for m in self.split(self.masked(text))])

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.runs(text):
            return self.whole(text)
        lines = text.split("\n")
        # a newline beside no other white space is a piece, except that spaces after it belong to what follows
        if len(lines) > 1 and not (all(lines[1:-1]) and all(not x[-1:].isspace() for x in lines[:-1]) and all(x[:1] == " " or not x[:1].isspace() for x in lines[1:])):
            return self.whole(text)
        return self.newline.join(map(self.line, lines))

    def line(self, line: str) -> bytes:
        # one space belongs to the piece after it, so a line parts before each
        first, *rest = line.split(" ")
        return self.heads[first] + b"".join(map(self.words.__getitem__, rest))


#: By the bytes of a character so far: (least, greatest) next byte, by the Unicode standard's table of well-formed sequences.
SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}


def expected(lead: int) -> int:
    """How many bytes a character with this first byte has; 0: none starts so."""
    return 1 if lead < 0x80 else 0 if lead < 0xC2 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4 if lead < 0xF5 else 0


def utf8_step(state: bytes, byte: int) -> tuple[bytes, str]:
    """The state machine: the bytes of an unfinished character and the next byte to the same afterwards and the characters that are told."""
    if state:
        low, high = SECOND.get(state[0], (0x80, 0xBF)) if len(state) == 1 else (0x80, 0xBF)
        if low <= byte <= high:
            state += bytes((byte,))
            return (b"", state.decode()) if len(state) == expected(state[0]) else (state, "")
        after, told = utf8_step(b"", byte)
        return after, REPLACEMENT + told
    n = expected(byte)
    return (b"", chr(byte)) if n == 1 else (bytes((byte,)), "") if n else (b"", REPLACEMENT)


class Decoder:
    """Ids to text as they come; what a character lacks is waited for. Ids that no token has give U+FFFD."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {i: t for t, i in ranks.items()}
        self.texts = np.full(max(self.tokens, default=0) + 1, None, object)
        #: Ids whose tokens are whole characters.
        self.is_whole = np.zeros(len(self.texts), bool)
        for i, t in self.tokens.items():
            state, text = self._feed(b"", t)
            if not state and REPLACEMENT not in text:
                self.texts[i], self.is_whole[i] = text, True
        self.kept: dict[tuple[bytes, int], tuple[bytes, str]] = {}

    @staticmethod
    def _feed(state: bytes, more: bytes) -> tuple[bytes, str]:
        out = []
        for byte in more:
            state, told = utf8_step(state, byte)
            out.append(told)
        return state, "".join(out)

    def step(self, state: bytes, token: int) -> tuple[bytes, str]:
        found = self.kept.get((state, token))
        if found is None:
            if token not in self.tokens:
                return b"", REPLACEMENT * (1 + bool(state))
            # four states' worth of tokens at most would fit twice
            found = self._feed(state, self.tokens[token])
            if len(self.kept) < CACHE:
                self.kept[state, token] = found
        return found

    def stream(self, chunks: Iterable[np.ndarray]) -> Iterator[str]:
        """Texts of chunks of ids, which may end within a character."""
        state = b""
        for ids in chunks:
            out, at = [], 0
            inside = ids < len(self.texts)
            whole = inside.copy()
            whole[inside] = self.is_whole[ids[inside]]
            odd = np.flatnonzero(~whole).tolist()
            texts = self.texts.take(ids, mode="clip").tolist()
            numbers = ids.tolist() if state or odd else texts
            while state and at < len(numbers):
                state, told = self.step(state, numbers[at])
                out.append(told)
                at += 1
            for k in () if state else odd:
                if k < at:
                    continue
                out += texts[at:k]
                at = k
                # until the machine is between characters again
                while at < len(numbers) and (state or not whole[at]):
                    state, told = self.step(state, numbers[at])
                    out.append(told)
                    at += 1
                if state:
                    break
            if not state:
                out += texts[at:]
            yield "".join(out)
        if state:
            yield REPLACEMENT

    def __call__(self, ids: bytes, chunk: int = 65_536) -> str:
        x = np.frombuffer(ids, "<u4")
        return "".join(self.stream(x[a : a + chunk] for a in range(0, len(x), chunk)))


@lru_cache(maxsize=1)
def coder(name: str = "byte_bpe_50k") -> tuple[Encoder, Decoder]:
    """Read once a worker."""
    import public_tokenizers

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Encoder(ranks, public_tokenizers.PATTERN), Decoder(ranks)


def texts(b: pa.RecordBatch) -> list[str]:
    return [x.decode(errors="replace") for x in common.texts(b)]


def encode(docs: DataFrame, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit numbers) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, _ = coder(name)
        for b in batches:
            yield common.batch(schema, b.column("doc_id"), list(map(to_ids, texts(b))))

    return common.map_batches(common.doc_columns(docs), f, "doc_id long, ids binary")


def decode(encoded: DataFrame, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id and text of rows with ids as encode gives them; null ids give the empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, to_text = coder(name)
        for b in batches:
            yield common.batch(schema, b.column("doc_id"), [to_text(x or b"") for x in b.column("ids").to_pylist()])

    return common.map_batches(encoded.select("doc_id", "ids"), f, "doc_id long, text string")


def round_trip(docs: DataFrame, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and exact: whether decoding gives the text again."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("exact", pa.bool_())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, to_text = coder(name)
        for b in batches:
            rows = []
            for text in texts(b):
                ids = to_ids(text)
                back = to_text(ids)
                rows.append((len(ids) >> 2, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text))
            yield common.batch(schema, b.column("doc_id"), *(zip(*rows, strict=True) if rows else [[]] * 4))

    return common.map_batches(common.doc_columns(docs), f, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
