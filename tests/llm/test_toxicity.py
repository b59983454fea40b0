import math
import random
import re
import zlib

import pytest
import xxhash
from cases import frame, rows

from banyan.llm import toxicity as t

LABELS = "doc_id long, quality int, toxic int"


def test_learns_held_out(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    data, labels = [], []
    for i in range(1500):
        bad = i % 6 == 0
        body = [r.choice(words) for _ in range(r.randint(5, 60))]
        if bad:
            body.insert(r.randrange(len(body)), r.choice(["vile", "nasty"]))
        data.append((i, " ".join(body), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    got = t.toxicity(frame(spark, data), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 1500
    held = [x for x in got if x.held_out]
    assert {x.doc_id for x in held} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum(x.predicted == labels[x.doc_id][2] for x in held)
    assert right > 0.95 * len(held) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)] + [(None, 1, 1), (2, 1, None), (999, 1, 1)], LABELS)
    got = t.toxicity(frame(spark), labels).collect()
    assert len(got) == len(rows()) and all(0 <= x.score <= 1 for x in got)
    empty = spark.createDataFrame([], LABELS)
    assert {x.score for x in t.toxicity(frame(spark), empty).collect()} == {0.5}
    assert t.toxicity(frame(spark, []), labels).collect() == []


def test_sample_is_bounded(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)], LABELS)
    assert t.training_rows(frame(spark), labels, 7).count() <= 7


def test_held_out_labels_are_not_read(spark):
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y
    a = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], LABELS)
    b = spark.createDataFrame([(i, 1, flip(i, i % 2)) for i in range(40)], LABELS)
    scores = [sorted((x.doc_id or -1, x.score) for x in t.toxicity(frame(spark), y).collect()) for y in (a, b)]
    assert scores[0] == scores[1]


def brute_features(text, bits):
    """Sorted numbers of the distinct words, neighbouring pairs and pairs with one word between, and the bias."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    h = [xxhash.xxh64_intdigest(w.encode()) for w in words]
    every = h + [a * 0x9E3779B97F4A7C15 + b for a, b in zip(h, h[1:], strict=False)] + [a * 0xC2B2AE3D27D4EB4F + b for a, b in zip(h, h[2:], strict=False)]
    return sorted({0} | {((x * 0xD6E8FEB86659FD93) % 2**64 >> (64 - bits)) % (2**bits - 1) + 1 for x in every})


class BruteFtrl:
    """Follow the regularised leader, a coordinate at a time."""

    def __init__(self, alpha=6.0, beta=1.0, l1=2.0, l2=0.1, scale=0.3, positive=2.0):
        self.a, self.b, self.l1, self.l2, self.scale, self.positive, self.z, self.n = alpha, beta, l1, l2, scale, positive, {}, {}

    def weight(self, i):
        z = self.z.get(i, 0.0)
        if abs(z) <= self.l1:
            return 0.0
        return -(z - math.copysign(self.l1, z)) / ((self.b + math.sqrt(self.n.get(i, 0.0))) / self.a + self.l2)

    def score(self, features):
        return 1 / (1 + math.exp(-sum(self.weight(i) for i in features) * len(features) ** (-self.scale / 2)))

    def learn(self, features, y):
        p, x = self.score(features), len(features) ** (-self.scale / 2)
        g = (p - y) * x * (self.positive if y else 1.0)
        for i in features:
            w, n = self.weight(i), self.n.get(i, 0.0)
            self.z[i] = self.z.get(i, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.a * w
            self.n[i] = n + g * g


@pytest.mark.parametrize("bits", [20, 6])
def test_against_brute_force_ftrl(spark, bits):
    r = random.Random(9)
    words = ["vile", "nasty", "kind", "Good", "a", "of", "the", "é", "b,c", "ok"]
    data = [(i, None if i == 7 else " ".join(r.choice(words) for _ in range(r.randint(0, 25))), "en", "s", 1) for i in range(300)] + [(5, "vile repeated row of five", "en", "s", 1)]
    labels = [(i, 1, int("vile" in (t or ""))) for i, t, *_ in data[:280]]
    docs, y = frame(spark, data), spark.createDataFrame(labels, LABELS)
    rows_ = t.training_rows(docs, y)
    order = rows_.collect()
    assert len(order) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, *_ in labels) + (zlib.crc32(b"5") % 5 != 0)
    brute = BruteFtrl()
    for _ in range(t.PASSES):
        for x in order:
            brute.learn(brute_features(x.text, bits), x.toxic)
    numbers, values, scale = model = t.train(rows_, bits)
    want = {i: brute.weight(i) for i in brute.z if brute.weight(i)}
    assert dict(zip(numbers.tolist(), values.tolist(), strict=True)) == pytest.approx(want, rel=1e-9)
    assert len(want) > 5
    got = sorted((x.doc_id, x.score) for x in t.score(docs, model, bits).collect())
    expected = sorted((i, brute.score(brute_features(text, bits))) for i, text, *_ in data)
    assert [i for i, _ in got] == [i for i, _ in expected]
    assert [x for _, x in got] == pytest.approx([x for _, x in expected], rel=1e-9)


def test_repeated_labels(spark):
    """Of several labels of a doc_id the highest counts, in whatever order they stand."""
    docs = frame(spark, [(i, f"text {i}", "en", "s", 1) for i in range(20)])
    a = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(i, 1, 1) for i in range(0, 20, 3)], LABELS)
    b = spark.createDataFrame([(i, 1, 1) for i in range(0, 20, 3)] + [(i, 0, 0) for i in range(20)], LABELS)
    first, second = (sorted((x.text, x.toxic) for x in t.training_rows(docs, y).collect()) for y in (a, b))
    assert first == second and all(y == (int(x.split()[1]) % 3 == 0) for x, y in first)
