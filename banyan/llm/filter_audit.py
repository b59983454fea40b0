"""How filters of documents interact: what each removes, repeats and alone catches, in every order.

Filters A to D read a text alone.  E fails a text that some smaller doc_id has
as well.  Texts are routed by XXH64 of their bytes (``routed``): a task keeps
collision chains, by hash the different texts with the least doc_id so far,
and passes on whatever isn't the least.  Each task of the reading side does so
first, so that of a text with any number of copies one row a task is shuffled,
and copies that are known as such go without their text and anywhere.  A text
goes compressed; equal bytes compress equally, so chains compare texts whole.

What a document fails is a mask of bits.  ``combineByKey`` merges each part's
vector of counts by mask (all, good, toxic), which has the same size whatever
the part has; from it every order and step follows.

Null and empty texts are equal texts without words.  A null doc_id is larger
than any other, so such a row fails E where a row with doc_id has its text, and
labels nothing.  Rows equal in doc_id and text are documents of their own, and
E fails none of them for another.  Of several labels of a doc_id the greatest
holds.  A null lang is the part of the empty text.  An empty table has no
parts; further columns are ignored.  A very long text is held by one task at a
time, and compressed where it waits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import xxhash
import zstandard
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
E = 1 << FILTERS.index("E")
CAPITALS, MARKS = bytes(range(65, 91)), b"#$%&*|"
#: UTF-8 bytes that go on with a character.
WITHIN = bytes(range(0x80, 0xC0))
#: Bytes of texts that a reading task holds before it passes on what it has, and that a routed partition should have.
HELD, ROUTED = 32_000_000, 64_000_000
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails: few words, few different words, many capitals, marks."""
    words = text.split()
    n = len(words)
    few, repeated = n < 200, 100 * len(set(words)) < 50 * n
    capitals = len(text) - len(text.translate(None, CAPITALS))
    loud = 100 * capitals > 3 * len(text.translate(None, WITHIN))
    marked = len(text.translate(None, MARKS)) < len(text)
    return few | repeated << 1 | loud << 2 | marked << 3


class Chains:
    """By hash the different texts, each with its mask, the least doc_id, and that id's rows by lang."""

    def __init__(self):
        self.by_hash: dict[int, list[list]] = {}
        self.size = 0

    def add(self, h: int, text: bytes, mask: int | None, doc_id: int | None, rows: Counter) -> Iterator[tuple]:
        """Puts rows in; gives (doc_id, lang, mask, n) of rows that aren't of the least doc_id. mask: None, to be told here."""
        chain = self.by_hash.setdefault(h, [])
        own = next((c for c in chain if c[0] == text), None)
        if own is None:
            chain.append([text, text_mask(text) if mask is None else mask, doc_id, rows])
            self.size += len(text) + 100
            return
        if doc_id == own[2]:
            own[3].update(rows)
            return
        if own[2] is None or doc_id is not None and doc_id < own[2]:
            own[2], doc_id = doc_id, own[2]
            own[3], rows = rows, own[3]
        for lang, n in rows.items():
            yield doc_id, lang, own[1] | E, n

    def __iter__(self) -> Iterator[tuple]:
        for h, chain in self.by_hash.items():
            for own in chain:
                yield h, *own

    def clear(self) -> None:
        self.by_hash, self.size = {}, 0


def _read(rows: Iterator[tuple]) -> Iterator[tuple[int, tuple]]:
    """Keyed rows: a text that may be the first of its kind under its hash; a copy without its text under a running number."""
    chains, pack, n = Chains(), zstandard.ZstdCompressor(level=1).compress, 0

    def held() -> Iterator[tuple[int, tuple]]:
        for h, text, mask, doc_id, own in chains:
            yield h, (pack(text), mask, doc_id, dict(own))
        chains.clear()

    for doc_id, lang, text in rows:
        text = bytes(text or b"")
        for copy in chains.add(xxhash.xxh64_intdigest(text), text, None, doc_id, Counter({lang: 1})):
            n += 1
            yield n, copy
        if chains.size > HELD:
            yield from held()
    yield from held()


def _settled(rows: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
    chains = Chains()
    for h, row in rows:
        if isinstance(row[0], bytes):
            yield from chains.add(h, *row[:3], Counter(row[3]))
        else:
            yield row
    for _, _, mask, doc_id, own in chains:
        for lang, n in own.items():
            yield doc_id, lang, mask, n


def routed(docs: DataFrame) -> RDD:
    """(doc_id, lang, mask, n) of all documents: n rows that fail the filters of mask."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // ROUTED))
    return own.rdd.map(tuple).mapPartitions(_read).partitionBy(parts, lambda h: h).mapPartitions(_settled)


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, lang, mask and n, as routed gives them."""
    return docs.sparkSession.createDataFrame(routed(docs), "doc_id long, lang string, mask int, n long", verifySchema=False)


def exact_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, and n rows of it, whose text a smaller doc_id has."""
    return masks(docs).where(F.col("mask").bitwiseAND(E) > 0).groupBy("doc_id").agg(F.sum("n").alias("n"))


def orders_of(counts: np.ndarray) -> Iterator[tuple]:
    """Rows of every order and step from counts[all, good or toxic][mask]."""
    every, good, toxic = counts
    at = np.arange(MASKS)
    share = {f: int(sum(every[m] * (len(ORDERS) // int(m).bit_count()) for m in at if m >> k & 1)) for k, f in enumerate(FILTERS)}
    for order in ORDERS:
        before, kept = 0, int(every.sum())
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            fails = at & bit > 0
            here = fails & (at & before == 0)
            removed = int(every[here].sum())
            kept -= removed
            yield order, step, kept, removed, int(every[fails].sum()) - removed, int(every[bit]), int(good[here].sum()), int(toxic[here].sum()), share[f]
            before |= bit


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step: what is kept, removed here, removed before although it fails here, and fails here alone; labelled rows removed; and what the filter removes, summed over all orders."""
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = masks(docs).groupBy("doc_id", "lang", "mask").agg(F.sum("n").alias("n")).join(known, "doc_id", "left")
    keyed = rows.select("lang", "mask", "n", F.coalesce("good", F.lit(False)), F.coalesce("toxic", F.lit(False))).rdd.map(lambda r: (r[0], tuple(r[1:])))

    def more(counts: np.ndarray, row: tuple[int, int, bool, bool]) -> np.ndarray:
        mask, n, good, toxic = row
        counts[:, mask] += (n, n * good, n * toxic)
        return counts

    def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a += b
        return a

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = keyed.combineByKey(lambda row: more(np.zeros((3, MASKS), np.int64), row), more, merged, parts)
    return spark.createDataFrame(counted.flatMap(lambda x: ((x[0], *row) for row in orders_of(x[1]))), RESULT, verifySchema=False)
