"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

A text's features are the distinct hashes of its words (lower case, without
ASCII punctuation), of neighbouring pairs and of pairs with one word between,
plus a bias.  A feature's value is ``1 / sqrt(features)`` to the power
``scale``, so that long texts take steps of bounded size.  Training reads a
bounded sample of labelled rows (``rows``, the lowest of a hash of doc_id, any
label) once a pass in one task, which spools their features to a file; rates
are per coordinate, and L1 leaves few weights above zero.  Those weights, at
most ``2 ** bits``, go to all tasks, which score every whole text.

Null and empty texts have the bias alone.  Labels of null and of documents that
are not there are ignored; of several labels of a doc_id the highest counts.
With no labelled rows every score is 0.5.  Repeated rows score alike; rows of
equal hash are chosen by doc_id, and a score of 0.5 is predicted as 1.  A very
long text is one row of features, held by one task at a time.  An empty table
gives no rows; further columns are never read.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 20
#: Labelled rows that training reads at most.
ROWS = 12_000
PASSES = 3
#: ASCII punctuation and white space part words; A-Z become a-z.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PAIR, SKIP, LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: Words whose hashes a worker keeps.
CACHE = 500_000


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE:
            self[word] = h
        return h


class Features:
    """Sorted distinct feature numbers of a text; 0 is the bias."""

    def __init__(self, bits: int = BITS):
        self.hash, self.shift, self.size = Hashes().__getitem__, np.uint64(64 - bits), 1 << bits

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.translate(WORDS).split()
        h = np.fromiter(map(self.hash, words), np.uint64, len(words))
        every = np.concatenate([h, h[:-1] * PAIR + h[1:], h[:-2] * SKIP + h[2:]]) * LAST
        seen = (every >> self.shift).astype(np.int64) % (self.size - 1) + 1
        return np.concatenate([np.zeros(1, np.int64), np.unique(seen)]).astype(np.int32)


def value(n: int, scale: float) -> float:
    return n ** (-scale / 2)


class Ftrl:
    def __init__(self, size: int, alpha: float = 6.0, beta: float = 1.0, l1: float = 2.0, l2: float = 0.1, scale: float = 0.3, positive: float = 2.0):
        """positive: weight of a toxic row's gradient, as such rows are few."""
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2, self.scale, self.positive = alpha, beta, l1, l2, scale, positive

    def weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, y: int) -> None:
        w, x = self.weights(i), value(len(i), self.scale)
        g = (sigmoid(float(w.sum()) * x) - y) * x * (self.positive if y else 1.0)
        root = np.sqrt(self.n[i])
        self.n[i] += g * g
        self.z[i] += g - (np.sqrt(self.n[i]) - root) / self.alpha * w


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """r (the order), text and toxic of so many labelled rows that aren't held out."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out()).withColumn("r", F.xxhash64("doc_id", F.lit(11)))
    # so few rows that every task can have them, and texts stay where they are
    chosen = known.orderBy("r", "doc_id").limit(rows)
    return common.doc_columns(docs).join(F.broadcast(chosen), "doc_id").orderBy("r", "doc_id", F.xxhash64("text")).limit(rows).select("text", "toxic")


def train(rows: DataFrame, bits: int = BITS, passes: int = PASSES, **settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Numbers and values of the weights that aren't zero, and the power that values are scaled by. One task learns."""
    schema = pa.schema([("i", pa.int32()), ("w", pa.float64())])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model, index = Features(bits), Ftrl(1 << bits, **settings), []
        with tempfile.TemporaryFile() as spool:
            for b in batches:
                for text, y in zip(common.texts(b), b.column("toxic").to_pylist(), strict=True):
                    i = features(text)
                    spool.write(i.tobytes())
                    index.append((len(i), 1 if y else 0))
            for _ in range(passes):
                spool.seek(0)
                for n, y in index:
                    model.learn(np.frombuffer(spool.read(4 * n), np.int32), y)
        w = model.weights(slice(None))
        kept = np.flatnonzero(w)
        yield common.batch(schema, kept.astype(np.int32), w[kept])

    common.bounded_batches(rows.sparkSession)
    found = rows.coalesce(1).mapInArrow(learn, "i int, w double").toArrow()
    return found.column("i").to_numpy(), found.column("w").to_numpy(), Ftrl(1, **settings).scale


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    numbers, values, scale = model

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(bits), np.zeros(1 << bits)
        w[numbers] = values
        for b in batches:
            found = []
            for text in common.texts(b):
                i = features(text)
                found.append(sigmoid(float(w[i].sum()) * value(len(i), scale)))
            yield common.batch(schema, b.column("doc_id"), b.column("held_out"), found, [int(x >= 0.5) for x in found])

    rows = common.doc_columns(docs).withColumn("held_out", held_out())
    return common.map_batches(rows, scored, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    return score(docs, train(training_rows(docs, labels, rows)))
