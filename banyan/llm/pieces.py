"""SentencePiece encoding and decoding by an Aho-Corasick automaton and one Viterbi pass.

The automaton over all pieces reads a text once; at each end position it yields
the longest piece that ends there and, along its output links, all shorter
ones, and each relaxes the best path to that position.

The model is of the merging kind (BPE): its scores are the merges' order, not
log-probabilities, and their sums would choose other pieces than the model
does.  So the score of a step is that of the transition: 0 if the piece and the
last one of the best path to its start stand side by side in an encoding of
the model, else minus infinity.  They do if no merge across their border comes
before the merges that made them, and a sequence is the model's encoding if all
its neighbours do.  Hence one path at most reaches a position with score 0, no
piece need be tried after it, and the ids are those of the sentencepiece library.

Spaces become U+2581 after one is put in front.  As no piece has that mark after
another character, a text parts before each run of marks, and the parts are
encoded by themselves and kept if they are short.  Pieces of several marks share
one rank below all others: runs of marks are merged from the left at the end.
A character without a piece is given by its bytes' pieces.  The library takes a
literal U+2581 for a space; here it is encoded by its bytes, so decoding returns
every text exactly.

Null texts count as empty: no ids, score 0.0.  Each row is encoded whole and by
itself; repeated rows and further columns change nothing; an empty table gives
no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

MARK = "▁"
#: Parts of texts whose ids a worker keeps, the characters that such a part has at most, and pairs of pieces that it keeps.
CACHE, KEEP, PAIRS = 400_000, 48, 1_000_000
#: Last piece of a path that ends with a character's bytes.
BYTES = -1


def merged(symbols: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """symbols after all merges, the lowest rank first and from the left; and the two that the last merge joined."""
    last = None
    while True:
        k = min((i for i in range(len(symbols) - 1) if symbols[i] + symbols[i + 1] in rank), key=lambda i: rank[symbols[i] + symbols[i + 1]], default=None)
        if k is None:
            return symbols, last
        last = (symbols[k], symbols[k + 1])
        symbols = [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2 :]]


class Kept(dict):
    """Values of short keys, made once; a full one keeps what it has and makes the rest anew."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= KEEP and len(self) < CACHE:
            self[key] = value
        return value


class Model:
    """Encodes and decodes with the pieces of a SentencePiece model file of the merging kind."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(m.get_piece_size())
        self.scores = np.array([m.get_score(i) for i in every])
        self.names = [m.id_to_piece(i).replace(MARK, " ") for i in every]
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in every if m.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self._set({m.id_to_piece(i): i for i in every if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))})

    def _set(self, pieces: dict[str, int]) -> None:
        self.runs = {len(p): i for p, i in pieces.items() if not p.strip(MARK)}
        self.pieces = {p: i for p, i in pieces.items() if p == MARK or p.strip(MARK)}
        if any(MARK in p[1:] for p in self.pieces):
            raise ValueError("a piece has a space after another character")
        long = sorted((p for p in self.pieces if len(p) > 1), key=lambda p: -self.scores[self.pieces[p]])
        rank = {p: k for k, p in enumerate(long, 1)}
        #: By id: the merge's rank (0: a single character), and the ids that it joins.
        self.rank = {i: rank.get(p, 0) for p, i in self.pieces.items()}
        self.joins: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for p in sorted(self.pieces, key=lambda p: rank.get(p, 0)):
            whole, last = merged(list(p), rank)
            if len(whole) > 1:
                continue  # merges never reach this piece
            if last:
                self.joins[self.pieces[p]] = tuple(self.pieces[x] for x in last)
                if max(rank.get(x, 0) for x in last) > rank[p]:
                    raise ValueError("a piece comes before the pieces that it is made of")
            self.automaton.add_word(p, (len(p), self.pieces[p]))
        self.automaton.make_automaton()
        self.marks = {i for i in self.pieces.values() if self.names[i] == " "}
        self.joined = {self.names[i].replace(" ", MARK): r for i, r in self.rank.items() if r}
        self.text_of = {i: p for p, i in self.pieces.items()}
        self.single = {p for p in self.pieces if len(p) == 1}
        self.whole = {self.text_of[i]: i for _, i in self.automaton.values()}
        self.sided: dict[int, bool] = {}
        self.kept, self.words = Kept(self.part), Kept(lambda word: self.part(MARK + word))
        self.parts = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether an encoding can have pieces a and b as neighbours: no merge across their border comes before those that made them."""
        rank, text = self.rank, self.text_of
        left = right = 1 << 60  # ranks of the merges that take a's last part and b's first one further
        while True:
            across = self.joined.get(text[a] + text[b])
            # of equal merges the left one comes first
            if across is not None and across < left and across <= right:
                return False
            if rank[a] > rank[b]:
                left, a = rank[a], self.joins[a][1]
            elif rank[b]:
                right, b = rank[b], self.joins[b][0]
            else:
                return True

    def viterbi(self, part: str) -> list[int]:
        """Ids of a part with one mark at most, in front."""
        n = len(part)
        # by a path's last character: the last piece of the path with score 0, and where it starts; None: no path so far
        last: list[int | None] = [None] * n
        start = [0] * n
        if not self.single.issuperset(part):
            for k, c in enumerate(part):
                if c not in self.single:
                    last[k], start[k] = BYTES, k
        # the path of no piece stands at -1, the last place of the list
        last.append(BYTES)
        sided = self.sided
        for end, (size, i) in self.automaton.iter(part):
            if last[end] is None and (before := last[end - size]) is not None:
                if before >= 0:
                    key = before << 20 | i
                    fits = sided.get(key)
                    if fits is None:
                        fits = self.side_by_side(before, i)
                        if len(sided) < PAIRS:
                            sided[key] = fits
                    if not fits:
                        continue
                last[end], start[end] = i, end - size + 1
        ids, e = [], n - 1
        while e >= 0:
            i = last[e]
            if i >= 0:
                ids.append(i)
            else:
                ids += [self.bytes[b] for b in reversed(part[e].encode())]
            e = start[e] - 1
        ids.reverse()
        return ids

    def run(self, n: int) -> list[int]:
        """Ids of n marks: neighbours that have a piece together are joined, the leftmost first."""
        sizes, after, before = [1] * n, [*range(1, n), -1], [-1, *range(n - 1)]
        todo = list(range(n - 1))
        while todo:
            i = heapq.heappop(todo)
            j = after[i] if sizes[i] else -1
            if j < 0 or sizes[i] + sizes[j] not in self.runs:
                continue
            sizes[i] += sizes[j]
            sizes[j], after[i] = 0, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            heapq.heappush(todo, i)
            if before[i] >= 0:
                heapq.heappush(todo, before[i])
        return [self.runs[x] for x in sizes if x]

    def part(self, part: str) -> bytes:
        """Packed ids of a part."""
        own = self.whole.get(part)
        if own is not None:
            return array("I", [own]).tobytes()
        if part.startswith(MARK + MARK):
            marks = len(part) - len(part.lstrip(MARK))
            ids = self.viterbi(part[marks - 1 :])
            # the mark next to the word is the run's if no merge took it
            ids = self.run(marks) + ids[1:] if ids[0] in self.marks else self.run(marks - 1) + ids
        else:
            ids = self.viterbi(part)
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Packed unsigned 32-bit ids."""
        if not text:
            return b""
        if MARK not in text and "  " not in text and text[0] != " ":
            return b"".join(map(self.words.__getitem__, text.split(" ")))
        out = []
        for k, span in enumerate(text.split(MARK)):
            if k:
                out.append(array("I", [self.bytes[b] for b in MARK.encode()]).tobytes())
            out += map(self.kept.__getitem__, self.parts((MARK if not k else "") + span.replace(" ", MARK)))
        return b"".join(out)

    def score(self, ids: np.ndarray) -> float:
        """The sum of the pieces' scores."""
        return float(self.scores[ids].sum())

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.byte_of.keys().isdisjoint(numbers):
            return "".join(map(self.names.__getitem__, numbers))[1:]
        return b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.names[i].encode() for i in numbers).decode(errors="replace")[1:]


@lru_cache(maxsize=1)
def model(name: str = "piece_bpe_32k") -> Model:
    """Read once a worker."""
    import public_tokenizers

    return Model(public_tokenizers.path(f"{name}.model"))


def encode(docs: DataFrame, name: str = "piece_bpe_32k") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit numbers) and score of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("score", pa.float64())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(name)
        for b in batches:
            found = [m.encode(x or "") for x in b.column("text").to_pylist()]
            yield common.batch(schema, b.column("doc_id"), found, [m.score(np.frombuffer(x, "<u4")) for x in found])

    return common.map_batches(common.doc_columns(docs), f, "doc_id long, ids binary, score double")


def decode(encoded: DataFrame, name: str = "piece_bpe_32k") -> DataFrame:
    """doc_id and text of rows with ids as encode gives them; null ids give the empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(name)
        for b in batches:
            yield common.batch(schema, b.column("doc_id"), [m.decode(x or b"") for x in b.column("ids").to_pylist()])

    return common.map_batches(encoded.select("doc_id", "ids"), f, "doc_id long, text string")


def round_trip(docs: DataFrame, name: str = "piece_bpe_32k") -> DataFrame:
    """doc_id, n_pieces, ids_crc32, n_fallback (pieces of single bytes), score, and exact: whether decoding gives the text again."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("n_fallback", pa.int64()), ("score", pa.float64()), ("exact", pa.bool_())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(name)
        low, high = min(m.byte_of), max(m.byte_of)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                text = text or ""
                ids = m.encode(text)
                x = np.frombuffer(ids, "<u4")
                rows.append((len(x), zlib.crc32(ids), int(((x >= low) & (x <= high)).sum()), m.score(x), m.decode(ids) == text))
            yield common.batch(schema, b.column("doc_id"), *(zip(*rows, strict=True) if rows else [[]] * 5))

    return common.map_batches(common.doc_columns(docs), f, "doc_id long, n_pieces long, ids_crc32 long, n_fallback long, score double, exact boolean")
