"""Secret scans: fixed forms, and windows of high Shannon entropy in candidate strings.

Base kinds are ``assign``, ``access`` and ``hex``, leftmost and not overlapping
within a kind.  The method adds kind ``entropy``: a candidate is a maximal run
of one character class; a window slides over it, its character counts and the
sum of their c*log2(c) updated by one step in and one out, so each step costs
the same whatever the window's length.  Windows at or above the class's
threshold merge to one span; a run shorter than the window, of as many characters
as the shortest window at least, is one window with a threshold scaled to its
length.  The part around a sample word (between = / _ -, and no farther than one
window) is cut out of a run, and what is left on either side is a candidate of
its own.  Candidates that match the allow list (word-like, repeated or
hyphen-grouped id forms) are suppressed, and so are those inside a base span.

Places are code points, end exclusive.  Null texts count as empty and give no
spans.  Every row is scanned whole and by itself, so ties, repeated rows and
further columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: One of these stands in every text with an ASSIGN match, in lower case.
KEYWORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: c * log2(c) in units of 2^-40: sums of whole numbers don't drift, however long a run is.
UNIT = 1 << 40
LOG = [0] + [round(c * math.log2(c) * UNIT) for c in range(1, 4096)]


@dataclass(frozen=True)
class CharClass:
    name: str
    chars: str
    window: int
    bits: float


CLASSES = (
    CharClass("hex", "0-9A-Fa-f", 20, 3.0),
    CharClass("base64", "0-9A-Za-z+/_=-", 24, 4.0),
)
#: Words of samples, and what parts a run.
SAMPLE, PARTS = re.compile(r"example|sample|placeholder|changeme|xxxx|0123456789|abcdef0123", re.I), "=/_-"
#: Candidates that are no secrets: one letter case and no digit, one character over and over, grouped ids.
ALLOW = (
    re.compile(r"[A-Za-z]?[a-z_/=+-]*+|[A-Z_/=+-]*+"),
    re.compile(r"(.)\1*"),
    re.compile(r"[0-9]+"),
    re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"),
    # a part between separators has one parse, and possessive repeats never give back: linear in the run's length
    re.compile(r"(?:(?:[A-Za-z][a-z]*+)?+[-_/+=])*+(?:[A-Za-z][a-z]*+)?+"),
)


def windows(s: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged places of s whose window of so many characters has an entropy of so many bits or more; a shorter s is one window."""
    n = min(window, len(s))
    if not n:
        return []
    counts: dict[str, int] = {}
    # entropy = log2(n) - total / n, so bits or more is a total of most or less; a tie counts
    total, most, out = 0, round((math.log2(n) - bits) * n * UNIT) + 4096, []
    for i, c in enumerate(s):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += LOG[k + 1] - LOG[k]
        if i >= n:
            c = s[i - n]
            k = counts[c]
            counts[c] = k - 1
            total += LOG[k - 1] - LOG[k]
        if i >= n - 1 and total <= most:
            start, end = i - n + 1, i + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
    return out


def without_samples(s: str, window: int) -> list[tuple[int, int]]:
    """Places of the pieces of s that are left beside its sample words."""
    out, at = [], 0
    for m in SAMPLE.finditer(s):
        a, b = m.span()
        while a > max(at, m.start() - window) and s[a - 1] not in PARTS:
            a -= 1
        while b < min(len(s), m.end() + window) and s[b] not in PARTS:
            b += 1
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return [*out, (at, len(s))]


def within(spans: list[tuple[int, int, str]]) -> Callable[[int, int], bool]:
    """Whether a place lies within one of the spans: of those that start no later, the farthest end tells."""
    starts, ends = [], []
    for a, b, _ in sorted(spans):
        starts.append(a)
        ends.append(max(b, ends[-1]) if ends else b)

    def inside(a: int, b: int) -> bool:
        k = bisect.bisect_right(starts, a)
        return k > 0 and ends[k - 1] >= b

    return inside


class Scanner:
    """Spans of a text. run and table find the texts without any candidate fast."""

    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[re.Pattern, ...] = ALLOW):
        self.allow = allow
        self.least = least = min(c.window for c in classes)
        self.classes = [(c, re.compile(f"[{c.chars}]{{{least},}}")) for c in classes]
        inside = [re.compile(f"[{''.join(c.chars for c in classes)}]", re.A).match(chr(b)) is not None for b in range(128)] + [False] * 128
        self.table, self.run = bytes(120 if x else 46 for x in inside), b"x" * least

    def __call__(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind), by start, then kind as listed."""
        flat = text.lower()
        found = []
        if any(k in flat for k in KEYWORDS):
            found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        if "AKIA" in text:
            found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        # no run of any class's characters is long enough in most texts; bytes of other characters count as gaps
        if self.run in text.encode().translate(self.table):
            found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
            inside = within(found)
            extra: set[tuple[int, int]] = set()
            for c, pattern in self.classes:
                for m in pattern.finditer(text):
                    run = m.group()
                    for at, end in without_samples(run, c.window):
                        s = run[at:end]
                        if len(s) < self.least or any(a.fullmatch(s) for a in self.allow):
                            continue
                        bits = c.bits * min(1.0, math.log(len(s), c.window))
                        for a, b in windows(s, c.window, bits):
                            a, b = a + at + m.start(), b + at + m.start()
                            if not inside(a, b):
                                extra.add((a, b))
            spans: list[tuple[int, int]] = []
            for a, b in sorted(extra):
                if spans and a < spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
            found += [(a, b, "entropy") for a, b in spans]
        return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def as_string(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            found = [scanner(x or "") for x in b.column("text").to_pylist()]
            base = [[s for s in x if s[2] != "entropy"] for x in found]
            yield common.batch(
                schema,
                b.column("doc_id"),
                *([sum(s[2] == k for s in x) for x in base] for k in KINDS[:3]),
                [hashlib.sha256(as_string(x).encode()).hexdigest() for x in base],
                [as_string(x) for x in found],
            )

    return common.map_batches(common.doc_columns(docs), scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[int, int, str]], by: str = "[SECRET]") -> str:
    """text with overlapping spans joined and each replaced."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], by]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns kept, with secrets replaced in text; null texts stay null."""

    @F.pandas_udf("string")
    def masked(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner()
        for s in parts:
            yield s.map(lambda x: x if x is None else mask(x, scanner(x)))

    common.bounded_batches(docs.sparkSession)
    return docs.withColumn("text", masked(F.col("text").cast("string")))
