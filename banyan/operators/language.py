"""A language identifier: hashed character n-grams under a linear softmax.

A text is its letters in lower case, whatever else is one space, with a space at
both ends; its grams are all runs of one to ``LONGEST`` characters, numbered by
a remainder of their code points.  A label's weight of a gram is the logarithm
of the gram's share among the label's grams, so weights are fitted by one pass
of counts over all labelled rows: each task adds up a bounded array, and the sum
of those, labels times ``BUCKETS`` numbers, is the model.  A text's score for a
label is the mean weight of its grams; the softmax of the scores, sharper for a
text of more grams up to ``SHARP``, is the confidence.

A script that stands for one language goes before that: where most letters are
of it, the language is told by the script and the confidence is its share.

Null and empty texts and those without letters have no label and confidence
0.0.  Rows without a label, and null texts, aren't learnt from.  Ties go to the
first label in order.  With no rows to learn from only scripts are told.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.storage import bounded_batches

LONGEST, PRIME = 3, 16_381
BUCKETS = LONGEST * PRIME
#: What is added to each count; grams from which on scores are as sharp as they get.
SMOOTH, SHARP = 0.5, 64
#: Labels that a model has at most: so its weights, which go to all workers, have 100 MB at most.
LABELS = 256
# Scripts that stand for one language each.
SCRIPTS = {"Bengali": "bn", "Devanagari": "hi", "Gurmukhi": "pa", "Gujarati": "gu", "Oriya": "or", "Tamil": "ta", "Telugu": "te", "Kannada": "kn", "Malayalam": "ml", "Sinhala": "si", "Thai": "th", "Arabic": "ar", "Hebrew": "he", "Greek": "el", "Hangul": "ko", "Hiragana": "ja"}


def letters(text: Column) -> Column:
    """A text as its grams are read from it."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " ")), F.lit(" "))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all grams of texts that letters() gave, and the text that each is of; a space alone is none."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    numbers, owners, value = [], [], points
    kept = (sizes > 2)[owner]
    for n in range(1, LONGEST + 1):
        size = max(0, len(points) - n + 1)
        if n > 1:
            # the remainder of value << 20 + point from that of value, in 32 bits
            value = _remainder(value[:size] * np.uint32((1 << 20) % PRIME) + rest[n - 1 :])
        else:
            rest = value = _remainder(points)
        own = kept[:size] & (owner[:size] == owner[n - 1 :])
        if n == 1:
            own &= points != 32
        # between words there is one space: no longer run is all spaces but that of a text without letters
        numbers.append(value[own].astype(np.int64) + (n - 1) * PRIME)
        owners.append(owner[:size][own])
    return np.concatenate(numbers), np.concatenate(owners)


def _remainder(x: np.ndarray) -> np.ndarray:
    """By PRIME, of 32-bit numbers."""
    return x - x // np.uint32(PRIME) * np.uint32(PRIME)


#: Characters of texts whose grams are numbered at once, but for one text that has more.
SLICE = 1 << 18


def runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Where runs of texts of SLICE characters at most start and end."""
    a = size = 0
    for k, t in enumerate(texts):
        if k > a and size + len(t) > SLICE:
            yield a, k
            a, size = k, 0
        size += len(t)
    if texts:
        yield a, len(texts)


@dataclass(frozen=True)
class Model:
    """labels in order; weights[bucket, label]."""

    labels: tuple[str, ...]
    weights: np.ndarray

    def predict(self, texts: list[str]) -> list[tuple[str | None, float]]:
        """Label and confidence of texts that letters() gave."""
        if not self.labels:
            return [(None, 0.0)] * len(texts)
        return [x for a, b in runs(texts) for x in self._predict(texts[a:b])]

    def _predict(self, texts: list[str]) -> list[tuple[str | None, float]]:
        number, of = grams(texts)
        n = np.bincount(of, minlength=len(texts))
        mean = np.stack([np.bincount(of, w[number], len(texts)) for w in self.weights.T], 1) / np.maximum(n, 1)[:, None]
        best = mean.argmax(1)
        sharp = np.minimum(n, SHARP)[:, None] * (mean - mean.max(1, keepdims=True))
        confidence = 1 / np.exp(sharp).sum(1)
        return [(self.labels[b], float(c)) if k else (None, 0.0) for b, c, k in zip(best, confidence, n, strict=True)]


def counts(rows: DataFrame, text: str, label: str) -> DataFrame:
    """label, bucket and n over all labelled rows."""
    own = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("label"), letters(F.col(text)).alias("t"))
    schema = pa.schema([("label", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            texts, labels = b.column("t").to_pylist(), b.column("label").to_pylist()
            for first, last in runs(texts):
                number, of = grams(texts[first:last])
                named = np.array(labels[first:last], object)
                for x in dict.fromkeys(named):
                    totals[x] = totals.get(x, 0) + np.bincount(number[(named == x)[of]], minlength=BUCKETS)
        for x, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at), pa.array(total[at].astype(np.int64))], schema=schema)

    bounded_batches(rows.sparkSession)
    return own.mapInArrow(f, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, text: str, label: str) -> Model:
    """A model of all labelled rows; more than LABELS labels are an error."""
    names = sorted(r[0] for r in rows.where(F.col(label).isNotNull()).select(F.col(label).cast("string")).distinct().limit(LABELS + 1).collect())
    if len(names) > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    # labels times buckets at most
    found = counts(rows, text, label).toArrow()
    total = np.zeros((BUCKETS, len(names)))
    number = {x: k for k, x in enumerate(names)}
    at = np.array([number[x] for x in found.column("label").to_pylist()], np.int64)
    total[found.column("bucket").to_numpy(), at] = found.column("n").to_numpy()
    return Model(tuple(names), np.log((total + SMOOTH) / (total.sum(0) + SMOOTH * BUCKETS)))


def save(model: Model, spark: SparkSession, path: str) -> None:
    """The weights as a table: label, bucket, weight."""
    rows = pa.table({"label": np.repeat(np.array(model.labels, object), BUCKETS), "bucket": np.tile(np.arange(BUCKETS), len(model.labels)), "weight": model.weights.T.ravel()})
    spark.createDataFrame(rows).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    found = spark.read.parquet(path).orderBy("label", "bucket").toArrow()
    names = tuple(dict.fromkeys(found.column("label").to_pylist()))
    return Model(names, found.column("weight").to_numpy().reshape(len(names), BUCKETS).T.copy())


def script(text: Column) -> Column:
    """language and share of the script that most letters are of; null where there is none that tells a language."""
    own = F.regexp_replace(F.coalesce(text, F.lit("")), r"\P{L}", "")
    shares = lambda t: F.array(*[F.struct((F.length(F.regexp_replace(t, rf"[^\p{{Is{s}}}]", "")) / F.length(t)).alias("share"), F.lit(lang).alias("language")) for s, lang in SCRIPTS.items()])
    most = X.bind(own, lambda t: F.when(t != "", F.array_max(shares(t))))
    return X.bind(most, lambda m: F.when(m["share"] >= 0.5, m))


def identified(df: DataFrame, model: Model, text: str, label: str = "predicted", confidence: str = "confidence") -> DataFrame:
    """df with a text's language and how sure it is."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.withColumns({"_script": F.when(F.col(text).rlike(r"[^\x00-ɏ]"), script(F.col(text))), "_letters": letters(F.col(text))})
    schema = df.sparkSession.createDataFrame([], rows.schema).drop("_letters").schema.add("_label", "string").add("_sure", "double")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value.predict(b.column("_letters").to_pylist())
            kept = b.drop_columns(["_letters"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*kept.schema.names, "_label", "_sure"])

    bounded_batches(df.sparkSession)
    done = rows.mapInArrow(f, schema)
    told = F.col("_script").isNotNull()
    return done.withColumns({label: F.when(told, F.col("_script.language")).otherwise(F.col("_label")), confidence: F.when(told, F.col("_script.share")).otherwise(F.col("_sure"))}).drop("_script", "_label", "_sure")


def predictor(model: Model) -> Callable[[str], tuple[str | None, float]]:
    """The same for one text in a worker: a hook of the gate."""
    import regex

    apart = regex.compile(r"[^\p{L}\p{M}]+")
    scripts = {lang: regex.compile(rf"\p{{Script={s}}}") for s, lang in SCRIPTS.items()}

    def predict(text: str) -> tuple[str | None, float]:
        own = [c for c in text if c.isalpha()]
        if own and not text.isascii():
            share, lang = max((sum(map(bool, map(r.match, own))) / len(own), lang) for lang, r in scripts.items())
            if share >= 0.5:
                return lang, share
        return model.predict([f" {apart.sub(' ', text.lower()).strip(' ')} "])[0]

    return predict


def brute_force(model: Model, text: str) -> dict[str, float]:
    """Mean weights of a prepared text by label, gram by gram: what tests hold predict against."""
    at = [(n - 1) * PRIME + sum(ord(c) << 20 * (n - 1 - i) for i, c in enumerate(text[a : a + n])) % PRIME for n in range(1, LONGEST + 1) for a in range(len(text) - n + 1) if n > 1 or text[a] != " "]
    return {x: math.fsum(model.weights[b, k] for b in at) / len(at) for k, x in enumerate(model.labels)}
