"""Vector codes against plain rounds over all distances."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from banyan.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """(vec_id, code, error, label_error, digest) by whole numbers of Python."""
    good = [r for r in rows if r[1] and len(r[1]) % 16 == 0 and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    d = len(good[0][1]) // 16 if good else 0
    xs = [[[math.floor(256 * float(np.float32(x))) for x in r[1][p * d : (p + 1) * d]] for p in range(16)] for r in good]
    books = [[x[p] for x in xs[:64]] for p in range(16)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    for k in range(3):
        codes = [[min((far(x[p], e), j) for j, e in enumerate(books[p])) for p in range(16)] for x in xs]
        for p in range(16) if k < 2 else ():
            for j in range(len(books[p])):
                own = [x[p] for x, c in zip(xs, codes, strict=True) if c[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(i) for b in books for e in b for i in e).encode()).hexdigest()
    errors = [sum(d for d, _ in c) for c in codes]
    totals = {}
    for r, e in zip(good, errors, strict=True):
        totals[r[2]] = totals.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{j:02x}" for _, j in c), e, totals[r[2]], digest) for r, c, e in zip(good, codes, errors, strict=True)), key=str)


def coded(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in ("code", "error", "_n", "part", "x", "lower", "_label")})
    return sorted(map(tuple, vector_codes.vector_codes(df).collect()), key=str)


def some(n, length=32, seed=0, near=False):
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(length)] for _ in range(20)]
    at = lambda k: [m + r.gauss(0, 0.05) for m in middles[k % 20]] if near else [r.gauss(0, 0.3) for _ in range(length)]
    return [(k * 3, at(k), (None, 1, 2)[k % 3]) for k in range(n)]


@pytest.mark.parametrize("near", [False, True])
def test_against_plain_rounds(spark, near):
    rows = some(260, seed=1, near=near)
    rows += [(1, None, 1), (4, [], 1), (5, [0.1] * 31 + [float("nan")], 1), (7, [0.1] * 31 + [float("inf")], None), (8, [0.1] * 31 + [None], 2), (10, [0.5] * 17, 1), (11, [0.25] * 48, 2)]
    rows += [(None, [0.5] * 32, None), (9, rows[0][1], 1), (9, rows[1][1], 2), (9, rows[1][1], 2), (13, [1e30] * 16 + [-0.5] * 16, 1)][: 11 if near else 4]
    assert [r[:3] + r[4:] for r in coded(spark, rows) if r[2] < 1 << 40] and coded(spark, [r for r in rows if r[0] != 13]) == plain([r for r in rows if r[0] != 13])


def test_ties_and_equal_vectors(spark):
    """Points halfway between entries, entries that are equal, and a third of all vectors the same."""
    rows = [(k, [float(k % 5)] * 16, k % 2) for k in range(70)] + [(100 + k, [0.5 + k % 4] * 16, None) for k in range(40)] + [(200 + k, [2.0] * 16, 1) for k in range(50)]
    assert coded(spark, rows) == plain(rows)


def test_few_vectors_and_none(spark):
    rows = some(5, length=16)
    assert coded(spark, rows) == plain(rows)
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []


def test_components_that_are_too_large(spark):
    (row,) = coded(spark, [(1, [3e38] * 32 + [-3e38] * 32, 1)])
    assert row[2:4] == (0, 0)
    assert all(r[2] >= 0 for r in coded(spark, [(1, [3e38] * 64, 1), (2, [-3e38] * 64, 1), (3, [0.0] * 64, 1)] + [(k, [float(k)] * 64, 2) for k in range(4, 90)]))


def test_bounds_hold_and_spare_distances():
    """What is stored bounds what is measured, after entries moved too; and few distances are measured again."""
    r = np.random.default_rng(5)
    middles = r.normal(0, 300, (64, 4))
    x = np.floor(middles[r.integers(0, 64, 3000)] + r.normal(0, 20, (3000, 4))).astype(np.int64)
    entries = np.floor(middles + r.normal(0, 15, (64, 4))).astype(np.int64)
    d = vector_codes.measured(x, entries)
    up, unit, low = vector_codes.stored(np.sqrt(d.min(1)) * (1 + 1e-9), np.sqrt(d) * (1 - 1e-9))
    assert (up.astype(np.float64) ** 2 >= d.min(1)).all() and ((low * unit[:, None].astype(np.float64)) ** 2 <= d).all()
    book = vector_codes.Codebook(np.stack([entries] * 16), np.zeros((16, 64)))
    shift = np.floor(r.normal(0, 6, entries.shape)).astype(np.int64)
    moved = book.after({(0, j): e for j, e in enumerate((entries + shift).tolist())})
    code = d.argmin(1)
    u, lower = up.astype(np.float64) + moved.moved[0][code], np.maximum(0, low * unit[:, None].astype(np.float64) - moved.moved[0])
    new = vector_codes.measured(x, moved.entries[0])
    assert (u**2 >= new[np.arange(len(x)), code] * (1 - 1e-9)).all() and (lower**2 <= new * (1 + 1e-9)).all()
    got, _, _, n = vector_codes.assigned(x, moved.entries[0], moved.between()[0], code, u, lower)
    assert (got == new.argmin(1)).all()
    assert n < 0.15 * new.size
