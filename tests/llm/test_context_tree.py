import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from cases import frame, rows

from banyan.llm import context_tree as ct


def sequences(data):
    return [(i, (t or "").encode().translate(ct.common.LOWER).split()) for i, t, *_ in data]


def train_rows(data):
    return [(i, w) for i, w in sequences(data) if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]


class Brute:
    """The tree as recursion over dictionaries."""

    def __init__(self, data, depth):
        self.depth, self.n = depth, defaultdict(lambda: [0, 0])
        for _, words in train_rows(data):
            s = ct.END * depth + ct.sequence(words)
            for i in range(depth, len(s)):
                for d in range(depth + 1):
                    node = 1
                    for j in range(7, -1, -1):
                        bit = s[i] >> j & 1
                        self.n[s[i - d : i], node][bit] += 1
                        node = 2 * node + bit
        self.children = defaultdict(list)
        for c, node in self.n:
            if c:
                self.children[c[1:], node].append(c)
        self.memo = {}

    def kt(self, c, node):
        a, b = self.n[c, node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def longer(self, c, node):
        return sum(self.weighted(x, node) for x in self.children[c, node])

    def weighted(self, c, node):
        if (c, node) not in self.memo:
            own = self.kt(c, node)
            self.memo[c, node] = own if len(c) == self.depth else np.logaddexp(own, self.longer(c, node)) - math.log(2)
        return self.memo[c, node]

    def bit_one(self, context, node):
        mix, used, left = 0.0, 0.0, 1.0
        for d in range(self.depth + 1):
            c = context[len(context) - d :]
            if (c, node) not in self.n:
                break
            a, b = self.n[c, node]
            trust = 1.0 if d == self.depth else 1 / (1 + math.exp(min(700, self.longer(c, node) - self.kt(c, node))))
            mix, used, left = mix + left * trust * (b + 0.5) / (a + b + 1), used + left * trust, left * (1 - trust)
        return mix / used if used else 0.5

    def log10(self, words):
        s, total = ct.END * self.depth + ct.sequence(words), 0.0
        for i in range(self.depth, len(s)):
            node = 1
            for j in range(7, -1, -1):
                bit, p = s[i] >> j & 1, self.bit_one(s[i - self.depth : i], node)
                total += math.log10(p if bit else 1 - p)
                node = 2 * node + bit
        return total


def base(data):
    c = Counter(w for _, words in train_rows(data) for w in [*words, b""])
    n, v = sum(c.values()), len(c)
    for _, words in sequences(data):
        t = [*words, b""]
        yield len(t), sum(x in c for x in t), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)


@pytest.mark.parametrize("heavy", [8, 1 << 18])
def test_scores(spark, monkeypatch, heavy):
    monkeypatch.setattr(ct, "HEAVY", heavy)
    data = rows()[:10] + rows()[40:52]
    brute = Brute(data, 3)
    got = sorted(ct.score(frame(spark, data), 3).collect(), key=lambda x: (x.doc_id is None, x.doc_id or 0, x.n_tokens, x.score))
    want = sorted(((i, *b, brute.log10(w)) for (i, w), b in zip(sequences(data), base(data), strict=True)), key=lambda x: (x[0] is None, x[0] or 0, x[1], x[5]))
    assert len(got) == len(want)
    for g, (i, n, known, total, score, tree) in zip(got, want, strict=True):
        assert (g.doc_id, g.n_tokens, g.n_known, g.train_tokens) == (i, n, known, total)
        assert g.held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1)
        assert g.base_score == pytest.approx(score, rel=1e-9)
        assert g.score == pytest.approx(tree, rel=1e-6)


@pytest.mark.parametrize("depth", [2, 4, 5])
def test_every_node_scores(spark, monkeypatch, depth):
    monkeypatch.setattr(ct, "CHUNK", 3000, raising=False)
    monkeypatch.setattr(ct, "PART", 1000, raising=False)
    # runs of few grams, and buckets dealt to several tasks
    monkeypatch.setattr(ct, "HELD", 500)
    monkeypatch.setattr(ct, "TOGETHER", 2)
    r = random.Random(3)
    data = [(i, " ".join(f"{r.getrandbits(64):x}" for _ in range(12)) + " the same words", "en", "s", 1) for i in range(60)] + rows()[40:52]
    brute = Brute(data, depth)
    by = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    got = sorted(((x.doc_id, x.n_tokens, x.score) for x in ct.score(frame(spark, data), depth).collect()), key=by)
    want = sorted(((i, len(w) + 1, brute.log10(w)) for i, w in sequences(data)), key=by)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-6)


def test_byte_probabilities_sum_to_one(spark, sf):
    counts = ct.count(spark.read.parquet(f"{sf}/documents.parquet"), 5).cache()
    model = ct.Model(*ct.build(counts, 5), 5)
    for context in (b"\n\n\n\n\n", b" the ", b"qqzq!", b"\xc3\xa9 \x00a"):
        keys = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert (10 ** model.compute(keys)).sum() == pytest.approx(1, abs=1e-3)
        assert model.logs(keys) == pytest.approx(model.compute(keys), rel=1e-5)


def test_held_out_code_length(spark, sf):
    got = ct.score(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    held = [x for x in got if x.held_out and x.n_tokens > 200]
    assert held and sum(x.bits_per_byte for x in held) / len(held) < 3.5


def test_empty(spark):
    assert ct.score(frame(spark, [])).collect() == []
    untrained = [(i, "some words", "en", "s", 1) for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    for x in ct.score(frame(spark, untrained)).collect():
        assert x.n_known == 0 and x.score == pytest.approx(11 * 8 * math.log10(0.5))


def test_bits_that_are_nearly_sure(spark):
    """A node of very many equal bits: its estimate is the method's, not cut off at some least probability."""
    data = [(0, "a" * 3_000_000, "en", "s", 1)]
    own = [x for x in range(20) if zlib.crc32(str(x).encode()) % 5 != 1][0]
    counts = ct.count(frame(spark, [(own, *data[0][1:])]), 2)
    model = ct.Model(*ct.build(counts, 2), 2)
    (log,) = model.compute(np.array([int.from_bytes(b"aab", "big")], np.uint64))
    # "a" is 01100001 and "b" 01100010: seven bits alike but for the last two
    assert log < math.log10(0.5 / 2_000_000)
    (sure,) = model.compute(np.array([int.from_bytes(b"aaa", "big")], np.uint64))
    assert -8 / 2_000_000 < sure < 0


def test_copies_of_trees_stay_within_the_chunks_grams(spark, monkeypatch):
    """However many tasks there might be, the copies of a bucket's tree have no more grams than its chunks."""
    monkeypatch.setattr(ct, "CHUNK", 2000)
    r = random.Random(5)
    data = [(i, " ".join(r.choice(["data", "lake", "river", f"{r.getrandbits(40):x}"]) for _ in range(60)), "en", "s", 1) for i in range(120)]
    counts = ct.count(frame(spark, data), 4, 64).cache()
    grams = counts.where("kind = 'g'").select("bucket", "chunk", "m", "a", "b")
    built = ct.trees(grams, 1, 4).cache()
    for together, held in ((1, 1), (1, 200), (4, 1), (2048, 1_000_000)):
        monkeypatch.setattr(ct, "TOGETHER", together)
        monkeypatch.setattr(ct, "HELD", held)
        rows = ct.dealt(grams, built).join(built.select("bucket", "m"), "bucket").join(grams.groupBy("bucket").agg(F.sum("m").alias("grams")), "bucket").collect()
        assert rows and all(x.parts == 1 or x.parts * x.m <= x.grams for x in rows)
        assert (max(x.parts for x in rows) > 1) == (together < 100)
