"""Text embeddings: words weighted by inverse document frequency under a seeded sparse projection.

A word has ``NONZERO`` places of a vector, each with a sign, by the digits of md5
of seed and word; a text's vector is the sum of its words', each times the
word's weight, log((texts + 1) / (texts that have it + 1)) + 1.  So no matrix is
kept, vectors of any two runs agree, and alike texts have a cosine near that of
their whole weighted word counts.  Weights of the ``WORDS`` most common words,
a bounded number, go to all tasks; another word counts as one of no text.

``vectors`` adds up a batch of texts at once, each different word looked up once
a batch, so ``SIZE`` numbers a text are shuffled.  ``Embedder`` does the same for
single texts in a worker, as a hook.

Null texts count as empty; a text without words has the zero vector, whose
similarity is 1.0 to an equal text and 0.0 to others.  Rows equal in id and text
give one row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import text as X
from ..sources.storage import bounded_batches

SIZE, NONZERO, SEED, WORDS = 64, 4, 42, 200_000
WORD = r"[\p{L}\p{M}\p{N}]+"


def words(text: Column) -> Column:
    return X.find_all(F.lower(F.coalesce(text, F.lit(""))), WORD)


def frequencies(df: DataFrame, text: str, most: int = WORDS) -> DataFrame:
    """word, df (the texts that have it) and n (all texts) of the most common words."""
    texts = df.agg(F.count("*").alias("n"))
    common = df.select(F.explode(F.array_distinct(words(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "word").limit(most)
    return common.crossJoin(F.broadcast(texts))


def weight(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def places(word: Column, value: Column) -> Column:
    """A word's places with value or its opposite."""
    digit = lambda h, at, n: F.conv(F.substring(h, at, n), 16, 10).cast("int")
    return X.bind(F.md5(F.concat(F.lit(f"{SEED}|"), word)), lambda h: F.array(*[F.struct((digit(h, 3 * k + 1, 2) % SIZE).alias("at"), F.when(digit(h, 3 * k + 3, 1) % 2 == 0, value).otherwise(-value).alias("x")) for k in range(NONZERO)]))


def vectors(df: DataFrame, id_col: str, text: str, known: DataFrame) -> DataFrame:
    """id, _text (a hash of the text) and vector of each text; known: what frequencies gave, WORDS rows at most."""
    spark = df.sparkSession
    found = known.select("word", weight(F.col("n"), F.col("df")).alias("w"), "n").limit(WORDS).toArrow()
    other = math.log((found.column("n")[0].as_py() if found.num_rows else 0) + 1) + 1
    shared = spark.sparkContext.broadcast(dict(zip(found.column("word").to_pylist(), found.column("w").to_pylist(), strict=True)))
    rows = df.select(F.col(id_col), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text"), words(F.col(text)).alias("_words"))
    schema = StructType([*rows.drop("_words").schema.fields, StructField("vector", ArrayType(DoubleType()))])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Embedder(shared.value, other)
        for b in batches:
            vector = own.sums(b.column("_words"))
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("_text"), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * SIZE), pa.array(vector.ravel()))], names=[id_col, "_text", "vector"])

    bounded_batches(spark)
    return rows.mapInArrow(f, schema).groupBy(id_col, "_text").agg(F.first("vector").alias("vector"))


def similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors; of two of which one is zero, 1.0 if both are, else 0.0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return X.bind(F.array(dot(a, b), dot(a, a), dot(b, b)), lambda d: F.when((d[1] == 0) | (d[2] == 0), F.when(d[1] == d[2], 1.0).otherwise(0.0)).otherwise(d[0] / F.sqrt(d[1] * d[2])))


class Embedder:
    """Vectors of single texts. weights: of known words; other: of any other one."""

    def __init__(self, weights: dict[str, float] | None = None, other: float = 1.0):
        self.weights, self.other = weights or {}, other
        self._places: dict[str, list[tuple[int, int]]] = {}

    def places(self, word: str) -> list[tuple[int, int]]:
        found = self._places.get(word)
        if found is None:
            h = hashlib.md5(f"{SEED}|{word}".encode()).hexdigest()
            found = [(int(h[3 * k : 3 * k + 2], 16) % SIZE, -1 if int(h[3 * k + 2], 16) % 2 else 1) for k in range(NONZERO)]
            if len(self._places) < WORDS:
                self._places[word] = found
        return found

    def sums(self, lists: pa.ListArray) -> np.ndarray:
        """A vector for each list of words: each different word is looked up once."""
        n = len(lists)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        different = coded.dictionary.to_pylist()
        number, owner = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(n), sizes)
        found = np.array([self.places(w) for w in different], np.int64).reshape(-1, NONZERO, 2)
        weights = np.array([self.weights.get(w, self.other) for w in different], np.float64)
        out = np.zeros(n * SIZE)
        for k in range(NONZERO):
            out += np.bincount(owner * SIZE + found[number, k, 0], (found[:, k, 1] * weights)[number], n * SIZE)
        return out.reshape(n, SIZE)

    def __call__(self, text: str) -> np.ndarray:
        out = np.zeros(SIZE)
        # letters, marks and numbers; the underscore is none
        for word in re.findall(r"[^\W_]+", text.lower()) if text.isascii() else _words()(text.lower()):
            w = self.weights.get(word, self.other)
            for at, sign in self.places(word):
                out[at] += sign * w
        return out

    def similarity(self, a: str, b: str) -> float:
        """Cosine of two texts' vectors; equal texts: 1.0."""
        if a == b:
            return 1.0
        x, y = self(a), self(b)
        size = math.sqrt(float(x @ x) * float(y @ y))
        return float(x @ y) / size if size else float(not x.any() and not y.any())


def _words() -> Callable[[str], list[str]]:
    import regex

    return regex.compile(WORD).findall


def embedder(known: DataFrame) -> Callable[[str, str], float]:
    """The similarity of two texts as a hook of the round trip: weights, WORDS at most, go to all workers once."""
    n = known.agg(F.max("n")).first()[0] or 0
    rows = known.select("word", weight(F.col("n"), F.col("df")).alias("w")).limit(WORDS).collect()
    shared = known.sparkSession.sparkContext.broadcast({r.word: r.w for r in rows})
    other = math.log(n + 1) + 1
    made: list[Embedder] = []

    def of(a: str, b: str) -> float:
        if not made:
            made.append(Embedder(shared.value, other))
        return made[0].similarity(a, b)

    return of
