"""Corpus metrics: platform fidelity, BLEU, chrF++ and TER.

Counts are pooled over the corpus before any formula; each row's n-grams are
counted within the row, so no n-gram is ever shuffled.  Texts are parted and
n-grams counted by slices of a batch, a bounded number of bytes or one row: items
are numbered, an n-gram is the number of its first part and of its last item, and
equal numbers mean equal n-grams.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import scores as S
from ..functions import text as X
from ..sources.storage import bounded_batches

PFS = ("overall", "emoji_preservation", "verbatim_preservation", "hashtag_count_preservation")


def fidelity_rows(df: DataFrame, source: str = "source_text", output: str = "translated_text") -> DataFrame:
    tokens = df.withColumns({"_s": X.protected(F.col(source)), "_o": X.protected(F.col(output))})
    return tokens.withColumns(S.fidelity(F.col("_s"), F.col("_o"))).drop("_s", "_o")


def fidelity_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """dimension, mean over rows that it applies to, n_applicable and n_total."""
    summed = rows.groupBy(*keys).agg(F.count("*").alias("n_total"), *[f(c).alias(f"{n}_{c}") for c in PFS for n, f in (("m", F.avg), ("n", F.count))])
    each = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(f"m_{c}").alias("mean"), F.col(f"n_{c}").alias("n_applicable")) for c in PFS])
    return summed.select(*keys, "n_total", F.inline(each))


def clipped(ids: np.ndarray, owner: np.ndarray, is_ref: np.ndarray, rows: int, orders: int) -> list[np.ndarray]:
    """By order, each row's n-grams of the hypothesis that the reference has, each at most as often.

    ids: numbers of all items, those of a text together; owner: their row.
    """
    width = (int(ids.max(initial=0)) + 1).bit_length()
    if width * orders + rows.bit_length() <= 62:
        return _clipped_by_one_sort(ids, owner, is_ref, rows, orders, width)
    out, width = [], max(1, int(ids.max(initial=0)).bit_length())
    text = owner + rows * is_ref
    at, gram, bits = np.arange(len(ids)), ids, width
    for n in range(1, orders + 1):
        if n > 1:
            last = at + n - 1
            inside = last < len(ids)
            inside[inside] = text[at[inside]] == text[last[inside]]
            at, gram = at[inside], gram[inside]
            if bits + width + rows.bit_length() > 61:
                # numbered anew, so that a gram, a row and a side fit in 64 bits
                gram = np.unique(gram, return_inverse=True)[1]
                bits = max(1, int(gram.max(initial=0)).bit_length())
            gram, bits = gram << width | ids[at + n - 1], bits + width
        # equal n-grams of a row stand together, the hypothesis' before the reference's
        key, times = np.unique((owner[at] << bits | gram) << 1 | is_ref[at], return_counts=True)
        both = np.flatnonzero(key[1:] >> 1 == key[:-1] >> 1)
        out.append(np.bincount(key[both] >> (bits + 1), np.minimum(times[both], times[both + 1]), rows).astype(np.int64))
    return out


def _clipped_by_one_sort(ids: np.ndarray, owner: np.ndarray, is_ref: np.ndarray, rows: int, orders: int, width: int) -> list[np.ndarray]:
    """The same where a row, its longest n-gram and a side fit in 63 bits: sorted by those, n-grams of every order stand together."""
    text = owner + rows * is_ref
    gram = np.zeros(len(ids), np.int64)
    for n in range(orders):
        # items from 1 on; what a text's end leaves out is 0
        item, m = np.zeros(len(ids), np.int64), max(0, len(ids) - n)
        item[:m] = np.where(text[n:] == text[:m], ids[n:] + 1, 0)
        gram = gram << width | item
    key = np.sort((owner << (width * orders) | gram) << 1 | is_ref)
    side, key, out = key & 1, key >> 1, []
    for n in range(1, orders + 1):
        head = key >> (width * (orders - n))
        starts = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if len(head) else np.zeros(0, np.int64)
        refs = np.add.reduceat(side, starts) if len(starts) else starts
        least = np.minimum(refs, np.diff(starts, append=len(head)) - refs)
        # n-grams that the text's end cuts short are none
        least[head[starts] & ((1 << width) - 1) == 0] = 0
        out.append(np.bincount(head[starts] >> (width * n), least, rows).astype(np.int64))
    return out


#: Bytes of texts that are counted at once: a slice's arrays stay small, and its numbers fit one sort.
SLICE = 1 << 18
_WIDE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WIDE_SPACE = re.compile(f"[{_WIDE}]")
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
_POINT = np.isin(np.arange(256), list(b".,"))
#: What BLEU's tokens set apart wherever it stands, and marks that chrF's words lose at an end.
_APART = np.isin(np.arange(256), list(b"{|}~[\\]^_`!\"#$%&()*+:;<=>?@/"))
_MARK = np.isin(np.arange(256), list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
Items = tuple[np.ndarray, np.ndarray]


def _utf8(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts, white space beyond ASCII as spaces and a space after each text, and where each text ends."""
    parts = [(t if t.isascii() else _WIDE_SPACE.sub(" ", t)).encode() for t in texts]
    return np.frombuffer(b" ".join([*parts, b""]), np.uint8), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)


def _numbered(data: np.ndarray, ends: np.ndarray, space: np.ndarray, start: np.ndarray) -> Items:
    """Numbers of words, equal for equal ones, and the text of each; start: where words begin."""
    at, inside = np.flatnonzero(start), np.cumsum(~space, dtype=np.int32)
    offsets = np.append(inside[at] - 1, inside[-1] if len(inside) else 0).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(ends, at, "right")


def _before(x: np.ndarray, first: bool) -> np.ndarray:
    return np.concatenate([[first], x[:-1]]) if len(x) else x


def items_13a(texts: list[str]) -> Items:
    """tokens_13a of texts, as numbers."""
    for a, b in (("<skipped>", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        texts = [t.replace(a, b) for t in texts]
    data, ends = _utf8(texts)
    space, digit, alone = _SPACE[data], _DIGIT[data], _APART[data]
    alone |= (data == 45) & _before(digit, False)
    point = np.flatnonzero(_POINT[data])
    if len(point):
        # a point or comma stands apart, but one before a digit that no pair of the rules takes: pairs of a non-digit and a mark are taken from the left
        first = np.concatenate([[True], np.diff(point) != 1])
        start = point[np.maximum.accumulate(np.where(first, np.arange(len(point)), 0))]
        taken = (point - start) % 2 == np.where(_before(digit, False)[start], 1, 0)
        alone[point[taken | ~digit[point + 1]]] = True
    return _numbered(data, ends, space, ~space & (alone | _before(space, True) | _before(alone, False)))


def items_chrf(texts: list[str]) -> Items:
    """chrF's words of texts, as numbers: one mark of ASCII punctuation at an end is a word of its own."""
    data, ends = _utf8(texts)
    space = _SPACE[data]
    start = ~space & _before(space, True)
    first, last = np.flatnonzero(start), np.flatnonzero(~space[:-1] & space[1:])
    long = first != last
    behind = long & _MARK[data[last]]
    start[last[behind]] = True
    start[first[long & ~behind & _MARK[data[first]]] + 1] = True
    return _numbered(data, ends, space, start)


def items_letters(texts: list[str]) -> Items:
    """Code points of texts but white space, as numbers."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    there = np.zeros(int(points.max(initial=0)) + 1, bool)
    there[points] = True
    for a, b in ((9, 14), (32, 33), (0x85, 0x86), (0xA0, 0xA1), (0x1680, 0x1681), (0x2000, 0x200B), (0x2028, 0x202A), (0x202F, 0x2030), (0x205F, 0x2060), (0x3000, 0x3001)):
        there[a:b] = False
    kept = there[points]
    return (np.cumsum(there, dtype=np.int64) - 1)[points[kept]], owner[kept]


def items_of_lists(lists: list[list[str] | None]) -> Items:
    """Words of lists, as numbers."""
    flat = pa.array([w for x in lists for w in x or ()], pa.string()).dictionary_encode()
    return flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lists)), [len(x or ()) for x in lists])


ITEMS = {"13a": items_13a, "chrf": items_chrf, "letters": items_letters, "lists": items_of_lists}


def _slices(b: pa.RecordBatch, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts have SLICE bytes at most, but for one row that has more."""
    size = np.zeros(b.num_rows, np.int64)
    for c in columns:
        x = b.column(c)
        size += pc.fill_null(pc.binary_length(x) if pa.types.is_string(x.type) else pc.multiply(pc.list_value_length(x), 16), 0).to_numpy(zero_copy_only=False)
    total, a = np.cumsum(size), 0
    while a < b.num_rows:
        to = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + SLICE, "right")))
        yield b.slice(a, to - a)
        a = to


def _compared(h: list, r: list, kind: str, orders: int) -> list[np.ndarray]:
    """By row the items of both sides, and by order their matches. Sides that are equal match wholly and are read once."""
    n, none = len(h), [] if kind == "lists" else ""
    h, r = ([none if x is None else x for x in side] for side in (h, r))
    same = np.fromiter((x == y for x, y in zip(h, r, strict=True)), bool, n)
    other = np.flatnonzero(~same)
    ids, text = ITEMS[kind](h + [r[k] for k in other])
    sizes = np.bincount(text, minlength=n + len(other))
    hyp, ref = sizes[:n], sizes[:n].copy()
    ref[other] = sizes[n:]
    # rows that differ, in order; a text beyond the hypotheses is a reference
    place = np.cumsum(~same) - 1
    is_ref = text >= n
    used = is_ref.copy()
    used[~is_ref] = ~same[text[~is_ref]]
    owner = np.where(is_ref, text - n, place[np.minimum(text, n - 1)])[used]
    found = clipped(ids[used], owner, is_ref[used], len(other), orders)
    matches = [np.where(same, np.maximum(hyp - k, 0), 0) for k in range(orders)]
    for m, x in zip(matches, found, strict=True):
        m[other] = x
    return [hyp, ref, *matches]


def _counted(rows: DataFrame, keys: tuple[str, ...], parts: dict[str, tuple[str, int, str, str]]) -> DataFrame:
    """keys and, for each part, of a kind of ITEMS and so many orders, between two columns: lengths h{part}, r{part} and matches m{part}1, ..."""
    own = rows.select(*keys).schema
    names = [c for p, (_, n, *_) in parts.items() for c in (f"h{p}", f"r{p}", *(f"m{p}{k}" for k in range(1, n + 1)))]
    schema = StructType([*own.fields, *(StructField(c, LongType()) for c in names)])
    read = sorted({c for _, _, *both in parts.values() for c in both})

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, read):
                texts = {c: b.column(c).to_pylist() for c in read}
                columns = [b.column(k) for k in keys]
                for kind, orders, h, r in parts.values():
                    columns += map(pa.array, _compared(texts[h], texts[r], kind, orders))
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, *names])

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(f, schema)


def tokens_13a(text: Column) -> Column:
    """The usual BLEU tokens: ASCII punctuation apart, but no point or comma within numbers."""
    x = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(text, "<skipped>", ""), "\n", " "), F.lit(" "))
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = F.replace(x, F.lit(a), F.lit(b))
    for pattern, by in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        x = F.regexp_replace(x, pattern, by)
    return F.filter(F.split(X.strip(x), r"(?U)\s+"), lambda w: w != "")


def _bleu_sums() -> list[Column]:
    sums = {"hyp_len": F.col("h_"), "ref_len": F.col("r_")} | {f"m{n}": F.col(f"m_{n}") for n in range(1, 5)} | {f"t{n}": F.greatest(F.lit(0), F.col("h_") - n + 1) for n in range(1, 5)}
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in sums.items()]


def bleu_counts(df: DataFrame, hypothesis: str, reference: str, *keys: str, tokens=tokens_13a) -> DataFrame:
    """Pooled matches m1-m4, totals t1-t4 and lengths, by keys."""
    # the usual tokens are found where they are counted
    of, kind = ((lambda c: c.cast("string")), "13a") if tokens is tokens_13a else (tokens, "lists")
    rows = df.select(*keys, of(F.col(hypothesis)).alias("_h"), of(F.col(reference)).alias("_r"))
    return _counted(rows, keys, {"_": (kind, 4, "_h", "_r")}).groupBy(*keys).agg(*_bleu_sums())


def bleu(counts: DataFrame) -> DataFrame:
    """Adds bleu, 0 to 100; an order without a match counts half, a quarter, ... of one; without any match at all 0."""
    logs, halves = F.lit(0.0), F.lit(1.0)
    for n in range(1, 5):
        m, t = F.col(f"m{n}"), F.col(f"t{n}")
        halves = F.when((m == 0) & (t > 0), halves * 2).otherwise(halves)
        logs = logs + F.log(F.when(m > 0, m / t).when(t > 0, 1 / (halves * t)).otherwise(F.lit(None))) / 4
    brevity = F.when(F.col("hyp_len") < F.col("ref_len"), F.exp(1 - F.col("ref_len") / F.col("hyp_len"))).otherwise(1.0)
    return counts.withColumn("bleu", F.when((F.col("hyp_len") == 0) | (F.col("m1") == 0), 0.0).otherwise(F.coalesce(100 * brevity * F.exp(logs), F.lit(0.0))))


def chrf_counts(df: DataFrame, hypothesis: str, reference: str, *keys: str, chars: int = 6, words: int = 2) -> DataFrame:
    """Pooled matches (m), hypothesis (h) and reference (r) n-grams of characters (c1..) and words (w1..)."""
    rows = df.select(*keys, F.col(hypothesis).cast("string").alias("_h"), F.col(reference).cast("string").alias("_r"))
    each = _counted(rows, keys, {"c": ("letters", chars, "_h", "_r"), "w": ("chrf", words, "_h", "_r")})
    return each.groupBy(*keys).agg(*_chrf_sums(chars, words))


def _chrf_sums(chars: int = 6, words: int = 2) -> list[Column]:
    orders = [("c", n) for n in range(1, chars + 1)] + [("w", n) for n in range(1, words + 1)]
    sums = {f"m{k}{n}": F.col(f"m{k}{n}") for k, n in orders} | {f"{s}{k}{n}": F.greatest(F.lit(0), F.col(f"{s}{k}") - n + 1) for k, n in orders for s in "hr"}
    return [F.sum(c).alias(k) for k, c in sums.items()]


def chrf(counts: DataFrame, chars: int = 6, words: int = 2, beta: float = 2.0) -> DataFrame:
    """Adds chrf, 0 to 100: the F score of mean precision and recall over orders that both sides have."""
    p, r, used = F.lit(0.0), F.lit(0.0), F.lit(0)
    for k, n in [("c", n) for n in range(1, chars + 1)] + [("w", n) for n in range(1, words + 1)]:
        m, h, f = (F.col(f"{x}{k}{n}") for x in "mhr")
        both = (h > 0) & (f > 0)
        p, r, used = p + F.when(both, m / h).otherwise(0.0), r + F.when(both, m / f).otherwise(0.0), used + F.when(both, 1).otherwise(0)
    p, r = p / used, r / used
    return counts.withColumn("chrf", F.coalesce(F.when(p + r > 0, 100 * (1 + beta**2) * p * r / (beta**2 * p + r)), F.lit(0.0)))


#: A run that moves has so many words at most, and moves so far.
LONGEST, FARTHEST = 10, 50
#: Cells that a block of rows or of moves has at once.
CELLS = 4_000_000
FAR = 1 << 29


class Band:
    """Edit distances of heads and tails of h and r in a band: by row i the columns i - width to i + width.

    A path of cost c leaves the diagonal by c at most, so a distance up to width
    is exact, and a greater one isn't told as smaller than it is.
    """

    def __init__(self, h: np.ndarray, r: np.ndarray, width: int):
        self.h, self.r, self.width = h, r, width
        size = 2 * width + 1
        self.place = np.arange(size, dtype=np.int32)
        edge = np.full(len(h) + width + 1, -1)
        #: By row the words of r before its columns; those after them are a row further. A view, no copy.
        self.ends = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(width + 1, -1), r, edge]), size)

    def _bounded(self, row: np.ndarray, i: int) -> np.ndarray:
        low, high = self.width - i, len(self.r) - i + self.width
        if low > 0:
            row[:low] = FAR
        row[max(0, high + 1) :] = FAR
        return row

    def down(self, row: np.ndarray, i: int, word: int) -> np.ndarray:
        """Row i + 1 of heads, but for what is put in, from row i and the word that follows; of many rows at once if all three are arrays."""
        new = row + (self.ends[i + 1] != word)
        np.minimum(new[..., :-1], row[..., 1:] + 1, out=new[..., :-1])
        return new

    def across(self, row: np.ndarray) -> np.ndarray:
        return np.minimum.accumulate(row - self.place, axis=-1) + self.place

    def head(self) -> np.ndarray:
        return self._bounded(self.place - self.width, 0)

    def heads(self, row: np.ndarray, first: int, last: int) -> np.ndarray:
        """Rows first to last, given the first."""
        out = np.empty((last - first + 1, len(row)), np.int32)
        out[0] = row
        for i in range(first, last):
            out[i - first + 1] = self.across(self._bounded(self.down(out[i - first], i, self.h[i]), i + 1))
        return out

    def tails(self, row: np.ndarray, last: int, first: int) -> np.ndarray:
        """Rows first to last of tails, given the last."""
        out = np.empty((last - first + 1, len(row)), np.int32)
        out[-1] = row
        for i in range(last - 1, first - 1, -1):
            below = out[i - first + 1]
            new = below + (self.ends[i + 1] != self.h[i])
            np.minimum(new[1:], below[:-1] + 1, out=new[1:])
            new = self._bounded(new, i)
            out[i - first] = (np.minimum.accumulate((new + self.place)[::-1]))[::-1] - self.place
        return out

    def tail(self) -> np.ndarray:
        n, m = len(self.h), len(self.r)
        return self._bounded((m - n + self.width - self.place).astype(np.int32), n)

    def stops(self) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """Some rows, from the first to the last, with their heads and tails: what lies between two is made anew when it is needed."""
        n = len(self.h)
        step = max(1, min(CELLS // len(self.place), n))
        at = sorted({*range(0, n, step), n})
        heads, tails = [self.head()], [self.tail()]
        for a, b in itertools.pairwise(at):
            heads.append(self.heads(heads[-1], a, b)[-1])
        for a, b in reversed([*itertools.pairwise(at)]):
            tails.append(self.tails(tails[-1], b, a)[0])
        return at, heads, tails[::-1]


def distance(h: np.ndarray, r: np.ndarray) -> int:
    """Edit distance: in a band that doubles until it holds the whole path, so in time that grows with words times edits."""
    if not len(h) or not len(r):
        return max(len(h), len(r))
    width = max(8, abs(len(h) - len(r)))
    while True:
        width = min(width, max(len(h), len(r)))
        band = Band(h, r, width)
        row, step = band.head(), max(1, CELLS // len(band.place))
        for a in range(0, len(h), step):
            row = band.heads(row, a, min(len(h), a + step))[-1]
        found = int(row[len(r) - len(h) + width])
        if found <= width:
            return found
        width *= 2


def _aligned(band: Band, at: list[int], heads: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of h and of r that an edit touches, and for each word of r the last word of h up to it on the path."""
    h, r, width = band.h, band.r, band.width
    wrong_h, wrong_r, until = np.zeros(len(h), bool), np.zeros(len(r), bool), np.zeros(len(r), np.int64)
    i, j = len(h), len(r)
    for k in range(len(at) - 2, -1, -1):
        first = at[k]
        d = band.heads(heads[k], first, at[k + 1])
        cell = lambda i, j: d[i - first, j - i + width] if abs(j - i) <= width else FAR  # noqa: B023, E731
        while (i > first or first == 0) and (i or j):
            here = cell(i, j)
            if i and j and here == cell(i - 1, j - 1) + (h[i - 1] != r[j - 1]):
                i, j = i - 1, j - 1
                wrong_h[i] = wrong_r[j] = h[i] != r[j]
                until[j] = i
            elif i and here == cell(i - 1, j) + 1:
                i -= 1
                wrong_h[i] = True
            else:
                j -= 1
                wrong_r[j], until[j] = True, i - 1
    return wrong_h, wrong_r, until


def _moved(h: np.ndarray, start: int, n: int, to: int) -> tuple[int, int, np.ndarray]:
    """Where h changes if n words from start on are put behind the first `to` words that stay: from, until, and the words there."""
    to = min(to, len(h) - n)
    a, b = min(start, to), max(start, to) + n
    run, rest = h[start : start + n], np.concatenate([h[a:start], h[start + n : b]])
    return a, b, np.concatenate([rest[: to - a], run, rest[to - a :]])


def _moves(h: np.ndarray, r: np.ndarray, aligned: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """(start, n, to): runs of h that stand elsewhere in r, where both places have an error, to behind the words aligned before or within that place."""
    wrong_h, wrong_r, until = aligned
    places: dict[int, list[int]] = {}
    for j, w in enumerate(r.tolist()):
        places.setdefault(w, []).append(j)
    words, others = h.tolist(), r.tolist()
    errors_h, errors_r = (np.concatenate([[0], np.cumsum(x)]).tolist() for x in (wrong_h, wrong_r))
    until = until.tolist()
    for start, w in enumerate(words):
        # no error within the longest run from here: no move
        if errors_h[min(len(words), start + LONGEST)] == errors_h[start]:
            continue
        own = places.get(w, ())
        for at in own[bisect.bisect_left(own, start - FARTHEST) : bisect.bisect_right(own, start + FARTHEST)]:
            n = 0
            while n < LONGEST and start + n < len(words) and at + n < len(others) and words[start + n] == others[at + n]:
                n += 1
                if errors_h[start + n] == errors_h[start] or errors_r[at + n] == errors_r[at] or start <= until[at] < start + n:
                    continue
                seen = set()
                for j in range(at - 1, at + n):
                    behind = until[j] + 1 if j >= 0 else 0
                    # within the run itself, it goes as many words to the right
                    to = behind if behind <= start + n else behind - n
                    if to != start and to not in seen:
                        seen.add(to)
                        yield start, n, to


def _costs(band: Band, at: list[int], heads: list[np.ndarray], tails: list[np.ndarray], moves: list[tuple[int, int, int]]) -> list[int]:
    """The distance after each move that changes something, exact where it is at most the band's width: rows that the move changes between rows of heads and of tails that it doesn't."""
    out = [FAR] * len(moves)
    size = len(band.place)
    changed = [(a, b, words, k) for k, m in enumerate(moves) for a, b, words in [_moved(band.h, *m)] if not np.array_equal(band.h[a:b], words)]
    changed.sort(key=lambda x: (x[0], x[1], x[3]))
    block = max(1, CELLS // size)
    for c in range(0, len(changed), block):
        part = changed[c : c + block]
        firsts, lasts = [x[0] for x in part], [x[1] for x in part]
        rows = np.stack(_picked(band.heads, at, heads, firsts, True))
        ends = _picked(band.tails, at, tails, lasts, False)
        length = max(b - a for a, b, *_ in part)
        for t in range(length):
            on = [k for k, (a, b, *_) in enumerate(part) if a + t < b]
            i = np.array([part[k][0] + t for k in on])
            new = band.down(rows[on], i, np.array([part[k][2][t] for k in on])[:, None])
            column = band.place[None, :] + (i + 1 - band.width)[:, None]
            new[(column < 0) | (column > len(band.r))] = FAR
            rows[on] = band.across(new)
        for k, (*_, move) in enumerate(part):
            out[move] = int((rows[k] + ends[k]).min())
    return out


def _picked(make, at: list[int], stops: list[np.ndarray], wanted: list[int], down: bool) -> list[np.ndarray]:
    """Rows of numbers, made between the stops around them."""
    found: dict[int, np.ndarray] = {}
    for i in sorted(set(wanted)):
        if i not in found:
            k = min(bisect.bisect_right(at, i) - 1, len(at) - 2)
            near = [x for x in set(wanted) if at[k] <= x <= at[k + 1]]
            if len(at) == 1:
                found[i] = stops[0]
                continue
            made = make(stops[k], at[k], at[k + 1]) if down else make(stops[k + 1], at[k + 1], at[k])
            found.update({x: made[x - at[k]].copy() for x in near})
    return [found[i] for i in wanted]


def ter_edits(hyp: list[str], ref: list[str]) -> int:
    """Edits from hyp to ref: words put in, taken out or changed, and runs of words moved (one edit each), the most helpful first, while one saves an edit.

    Of equal moves the longest, then the leftmost, goes first.  Distances are
    exact and every move is weighed, whatever the lengths; memory is bounded.
    """
    number = {w: i for i, w in enumerate(dict.fromkeys([*hyp, *ref]))}
    h, r = (np.fromiter((number[w] for w in x), np.int64, len(x)) for x in (hyp, ref))
    moves = 0
    best = distance(h, r)
    # words that the other side lacks are wrong in any order: no move gets below that
    own, other = np.bincount(h, minlength=len(number)), np.bincount(r, minlength=len(number))
    floor = max(len(h), len(r)) - int(np.minimum(own, other).sum())
    while best > floor and len(h) and len(r):
        band = Band(h, r, max(best, 1))
        at, heads, tails = band.stops()
        found = sorted(set(_moves(h, r, _aligned(band, at, heads))), key=lambda m: -m[1])
        least, chosen = best, None
        for a in range(0, len(found), 256):
            part = found[a : a + 256]
            # a run of n words that moves saves 2 n edits at most
            if best - 2 * part[0][1] > least or best - 2 * part[0][1] >= best:
                break
            for cost, m in zip(_costs(band, at, heads, tails, part), part, strict=True):
                if cost < best and (chosen is None or (cost, -m[1], m[0], m[2]) < (least, -chosen[1], chosen[0], chosen[2])):
                    least, chosen = cost, m
        if chosen is None:
            break
        a, b, words = _moved(h, *chosen)
        h = np.concatenate([h[:a], words, h[b:]])
        moves, best = moves + 1, least
    return moves + best


@F.pandas_udf(LongType())
def edits(h: pd.Series, r: pd.Series) -> pd.Series:
    """TER's edits of texts by their words in lower case."""
    words = lambda x: re.sub(r"\s+", " ", (x or "").lower()).split()
    return pd.Series([ter_edits(words(a), words(b)) for a, b in zip(h, r, strict=True)])


def _ter_items(hypothesis: str, reference: str) -> list[Column]:
    length = F.size(F.filter(F.split(X.strip(F.lower(reference)), r"(?U)\s+"), lambda w: w != ""))
    return [edits(F.col(hypothesis), F.col(reference)).alias("_edits"), length.alias("_words")]


def _ter_sums() -> list[Column]:
    return [F.sum("_edits").alias("edits"), F.sum("_words").alias("ref_words")]


def with_ter(counts: DataFrame) -> DataFrame:
    """Adds ter: pooled edits over reference words, times 100."""
    return counts.withColumn("ter", F.when(F.col("ref_words") > 0, 100 * F.col("edits") / F.col("ref_words")).otherwise(F.when(F.col("edits") > 0, 100.0).otherwise(0.0)))


def ter(df: DataFrame, hypothesis: str, reference: str, *keys: str) -> DataFrame:
    """Pooled edits over reference words, times 100."""
    bounded_batches(df.sparkSession)
    return with_ter(df.select(*keys, *_ter_items(hypothesis, reference)).groupBy(*keys).agg(*_ter_sums()))


def report(df: DataFrame, source: str, hypothesis: str, reference: str, *keys: str, edits: bool = True) -> DataFrame:
    """keys, bleu, chrf, ter and pfs (mean fidelity), from one pass over the rows and one sum of counts. Without edits there is no ter, by far the dearest."""
    rows = fidelity_rows(df.select(*keys, source, hypothesis, reference), source, hypothesis)
    ters, passed = (_ter_items(hypothesis, reference), ("_edits", "_words")) if edits else ([], ())
    items = rows.select(*keys, F.col("overall").alias("_pfs"), *ters, F.col(hypothesis).cast("string").alias("_h"), F.col(reference).cast("string").alias("_r"))
    both = ("_h", "_r")
    each = _counted(items, (*keys, "_pfs", *passed), {"_": ("13a", 4, *both), "c": ("letters", 6, *both), "w": ("chrf", 2, *both)})
    counts = each.groupBy(*keys).agg(*_bleu_sums(), *_chrf_sums(), *(_ter_sums() if edits else ()), F.avg("_pfs").alias("pfs"))
    scored = chrf(bleu(counts))
    return (with_ter(scored) if edits else scored).select(*keys, "bleu", "chrf", *(("ter",) if edits else ()), "pfs")
