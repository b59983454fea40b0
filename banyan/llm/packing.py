"""Harmonic packing of tokenized documents into sequences.

A document is cut into whole sequences of ``capacity`` ids and one rest.  The
rests fall into reciprocal-capacity classes: class ``k`` has the lengths in
(capacity / (k + 1), capacity / k].  A bin of class ``k`` takes exactly ``k``
rests, and each task fills its own bins (no shuffle, no state between tasks).
As a document may be cut anywhere, the gap that a bin of full count leaves, at
most capacity / (k + 1) ids, isn't padded: the next document's rest, instead of
going to its class, is cut to fill it, and what is left of it is a rest like
any other.  What is left of all classes when a task ends, fewer than ``k`` rests
each, isn't packed by classes but laid end to end and cut at ``capacity``; the
last, unfilled sequence is split at powers of two.  So no sequence needs padding.

Null and empty texts have the end id alone.  Repeated rows, equal doc_ids and
ties are packed one by one.  An empty table gives no rows; further columns of
the input are ignored.  Ids of a sequence depend on the split that a task reads,
so they are the same when a lost task runs again.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bin_class long"
ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])
#: Scripts whose letters, numbers and spaces are the same in every Unicode version since 3.2; a text with others is
#: left to the tokenizers library as a whole.
STABLE = "\x00-ȠΑ-ΡΣ-ώА-яঅ-ঌা-ৄ‐-‧ぁ-ゔ一-龥가-힣"
#: UTF-8 bytes of white space in those scripts; the BPE library's pattern overflows its stack on very long runs of it.
SPACES = bytes(32 if c in b"\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\xc2" else 120 for c in range(256))
LONG_RUN = b" " * 1000
#: A worker keeps the ids of so many words, of so many characters at most.
CACHE, KEEP = 400_000, 48


class Words(dict):
    """Ids of words, each after a space; a full one keeps what it has and encodes the rest anew."""

    def __init__(self, single, ordinary):
        self.single, self.ordinary = single, ordinary

    def __missing__(self, word: str) -> bytes:
        ids = self.single(f" {word}".encode()) if word.isalpha() else self.ordinary(f" {word}")
        ids = np.array(ids, "<u4").tobytes()
        if len(word) <= KEEP and len(self) < CACHE:
            self[word] = ids
        return ids


class Encoder:
    """Ids of texts as packed unsigned 32-bit integers, equal to those of the tokenizers library.

    The pre-tokenizer joins one space to the word after it. So where no white
    space follows a space, a text can be cut before each space, and the ids of
    what stands between are kept and looked up.
    """

    def __init__(self, json_path: str, tiktoken_path: str, pattern: str):
        import base64
        import re

        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(json_path)
        with open(tiktoken_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ordinary = fast.encode_ordinary
        self.words = Words(fast._core_bpe.encode_single_piece, fast.encode_ordinary)
        self.other = re.compile(f"[^{STABLE}]").search
        self.runs = re.compile(r" (?:\s|$)").search
        self.special = [x.content for x in self.whole.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> bytes:
        odd = (not text.isascii() and self.other(text)) or any(x in text for x in self.special)
        if odd or (len(text) >= len(LONG_RUN) and LONG_RUN in text.encode().translate(SPACES)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.runs(text):
            return np.array(self.ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.ordinary(first), "<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))


def encoder(name: str = "byte_bpe_50k") -> Encoder:
    import public_tokenizers

    return Encoder(public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN)


@dataclass
class Piece:
    """Ids of a document from start on, packed; doc_tokens: how many the document has."""

    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) >> 2

    def cut(self, n: int) -> Piece:
        """The first n ids, which this piece loses."""
        head = Piece(self.doc_id, self.start, self.ids[: 4 * n], self.doc_tokens)
        self.start, self.ids = self.start + n, self.ids[4 * n :]
        return head


class Packer:
    """Bins of one task. Both methods give the rows of the sequences that are complete."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        #: Rests that wait, by class; and a bin of full count whose gap the next rest fills, with its class.
        self.open: dict[int, list[Piece]] = {}
        self.gap: tuple[int, list[Piece], int] | None = None

    def rows(self, parts: list[Piece], k: int) -> list[tuple]:
        out, at = [], 0
        for p in parts:
            out.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, self.next, at, k))
            at += len(p)
        self.next += 1
        return out

    def add(self, doc: Piece) -> list[tuple]:
        """A document: whole sequences go at once, the rest to the gap and then to its class."""
        out: list[tuple] = []
        whole = len(doc) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            out += self.rows([Piece(doc.doc_id, at, doc.ids[4 * at : 4 * (at + self.capacity)], doc.doc_tokens)], 1)
        doc = Piece(doc.doc_id, whole, doc.ids[4 * whole :], doc.doc_tokens)
        if self.gap and len(doc):
            room, parts, k = self.gap
            parts.append(doc.cut(min(room, len(doc))))
            room -= len(parts[-1])
            self.gap = (room, parts, k) if room else None
            if not room:
                out += self.rows(parts, k)
        if not len(doc):
            return out
        k = self.capacity // len(doc)
        waiting = self.open.setdefault(k, [])
        waiting.append(doc)
        if len(waiting) == k:
            del self.open[k]
            room = self.capacity - sum(map(len, waiting))
            if not room:
                out += self.rows(waiting, k)
            else:
                # no gap is open here: this document would have filled it
                self.gap = (room, waiting, k)
        return out

    def finish(self) -> list[tuple]:
        """What is left, end to end, the longest first; bin_class 0."""
        rest = [p for k in sorted(self.open) for p in self.open[k]] + (self.gap[1] if self.gap else [])
        left, out = sum(map(len, rest)), []
        parts: list[Piece] = []
        room = 0
        for p in rest:
            while len(p):
                if not room:
                    # full sequences while enough is left, then the largest powers of two
                    room = min(self.capacity, 1 << (left.bit_length() - 1))
                parts.append(p.cut(min(room, len(p))))
                room -= len(parts[-1])
                left -= len(parts[-1])
                if not room:
                    out += self.rows(parts, 0)
                    parts = []
        self.open, self.gap = {}, None
        return out


def harmonic_pack(docs: DataFrame, capacity: int = 1024, tokenizer: str = "byte_bpe_50k", end_id: int = 0) -> DataFrame:
    """One row per piece of every document; capacity is a power of two. bin_class: the class of the piece's sequence, 0 if it is of a task's leftovers."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return common.batch(ARROW, *(zip(*found, strict=True) if found else [[]] * len(ARROW)))

        for b in batches:
            found = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + end
                found += packer.add(Piece(doc_id, 0, ids, len(ids) >> 2))
            if found:
                yield rows(found)
        yield rows(packer.finish())

    return common.map_batches(common.doc_columns(docs), pack, SCHEMA)
