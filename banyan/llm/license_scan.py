"""License scans: base phrases, and fuzzy search for short notices.

Each notice of the list is split into ``errors + 1`` pieces; by the pigeonhole
principle a text with a copy of at most ``errors`` edits holds one piece
exactly.  Pieces are sought as exact substrings of the text's words joined by
single spaces; a copy starts within ``errors`` bytes of the place that a find
points to.  At each start of a word there, the regex library matches the notice
with bounded errors up to an end of a word, and gives span and edits.  Of
overlapping copies of a notice the one of fewest edits stays, then the first.  A
notice found adds its label; the score is 1.0 with a base phrase, else the best
1 - edits / length of a match, else 0.0.

Null texts count as empty: no words, no labels, score 0.0.  Each row is scanned
whole and by itself; repeated rows and further columns change nothing; an empty
table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: UTF-8 bytes of words: digits, letters in lower case, and all of non-ASCII; others part words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    errors: int


NOTICES = (
    Notice("gpl", "gnu general public license", 3),
    Notice("gpl", "free software you can redistribute it and or modify it under the terms of", 7),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 7),
    Notice("mit", "released under the mit license", 3),
    Notice("cc-by", "creative commons attribution", 3),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 7),
    Notice("mpl", "mozilla public license", 2),
)


def pieces(n: Notice) -> list[tuple[int, str]]:
    """(place, text) of errors + 1 parts of about equal length."""
    k, size = n.errors + 1, len(n.text)
    cuts = [size * i // k for i in range(k + 1)]
    return [(a, n.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Searcher:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        pattern = lambda n: regex.compile(rb"(?:" + regex.escape(n.text.encode(), literal_spaces=True) + rb"){e<=" + str(n.errors).encode() + rb"}(?![^ ])", regex.BESTMATCH)
        self.notices = [(n, n.text.encode(), [(a, p.encode()) for a, p in pieces(n)], pattern(n)) for n in notices]

    def starts(self, line: bytes, parts: list[tuple[int, bytes]], errors: int) -> set[int]:
        """Starts of words within errors of where a copy would start by one of its pieces."""
        out: set[int] = set()
        for a, p in parts:
            at = line.find(p)
            while at >= 0:
                low, high = max(0, at - a - errors), at - a + errors
                if not low:
                    out.add(0)
                s = line.find(b" ", max(0, low - 1), max(0, high)) + 1
                while s:
                    out.add(s)
                    s = line.find(b" ", s, high) + 1
                at = line.find(p, at + 1)
        return out

    def copies(self, line: bytes, n: Notice, text: bytes, parts: list[tuple[int, bytes]], pattern: regex.Pattern) -> list[tuple[int, int, int]]:
        """(start, end, edits) of n's copies."""
        found = []
        for s in self.starts(line, parts, n.errors):
            e = s + len(text)
            if line.startswith(text, s) and (e == len(line) or line[e] == 32):
                found.append((0, s, e))
                continue
            # up to an end of a word, so that the pattern's edge means the same as in the whole line
            end = line.find(b" ", e + n.errors)
            m = pattern.match(line, s, len(line) if end < 0 else end)
            if m:
                found.append((sum(m.fuzzy_counts), s, m.end()))
        kept: list[tuple[int, int, int]] = []
        for edits, a, b in sorted(found):
            k = bisect.bisect_left(kept, (a,))
            if (k == len(kept) or kept[k][0] >= b) and (not k or kept[k - 1][1] <= a):
                kept.insert(k, (a, b, edits))
        return kept

    def __call__(self, line: bytes) -> list[tuple[int, int, int, Notice]]:
        """(start, end, edits, notice) of each copy in line, the words joined by spaces; bytes, end exclusive."""
        out = [(*x, n) for n, *rest in self.notices for x in self.copies(line, n, *rest)]
        return sorted(out, key=lambda x: (x[0], x[1], x[3].label))


def base_places(line: bytes) -> list[tuple[int, str]]:
    """(word, label) of each phrase in line, the words joined by spaces."""
    out, wide = [], b" " + line + b" "
    for phrase, label in PHRASES:
        sought = f" {phrase} ".encode()
        at = wide.find(sought)
        while at >= 0:
            out.append((wide.count(b" ", 0, at), label))
            at = wide.find(sought, at + 1)
    return out


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def find_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and fuzzy (label:start:end:edits in bytes of the joined words)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("fuzzy", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher()
        for b in batches:
            rows = []
            for text in common.texts(b):
                words = words_of(text)
                line = b" ".join(words)
                base = base_places(line)
                near = search(line)
                own = {x for _, x in base}
                places = [x for x, _ in base]
                score = 1.0 if base else max((1 - e / len(n.text) for _, _, e, n in near), default=0.0)
                rows.append((len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(own | {n.label for *_, n in near})), score, ",".join(f"{n.label}:{a}:{z}:{e}" for a, z, e, n in near)))
            yield common.batch(schema, b.column("doc_id"), *(zip(*rows, strict=True) if rows else [[]] * 8))

    return common.map_batches(common.doc_columns(docs), scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, fuzzy string")
