"""Vector codes by product quantization, its codebooks learnt by Elkan's bounded Lloyd rounds in whole numbers.

Each component becomes floor(256 * x), vectors are cut into ``PARTS`` parts,
and each part position has a codebook that starts from the vectors of least
vec_id.  With each vector is stored, for each of its parts, an upper bound of
the distance to its entry and a lower bound to every entry.  A round moves the
entries; the bounds move along by how far (``Codebook.moved``), and an entry is
measured only if no bound tells that it is farther than the vector's own:
its lower bound, or half the distance between the two entries, is strictly
greater.  Bounds are rounded outwards and what is measured is measured in whole
numbers, so ties are told exactly and go to the lower index.  The bounds are
columns of a table in the shared folder, written once a round.

Sums of components by entry are added up in each task, so a few thousand
numbers a task are shuffled; entries, a bounded number, go to all tasks.

Rows whose vector is null, or holds null, NaN or infinite components, go, and
so do those whose length isn't a positive multiple of ``PARTS`` or isn't that
of the kept vector of least vec_id: they can't be cut alike.  Components beyond
what keeps a vector's error within 64 bits (2**27 in size for 64 of them) are
taken as that, and a label's error that doesn't fit is null.  With fewer
vectors than entries the codebooks have as many entries as there are vectors;
equal vectors make equal entries, of which the first wins.  Null vec_ids come
last; rows of equal vec_id are vectors of their own, in the order of their
components.  Null labels are one label.  An empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Numbers of a block of distances.
BLOCK = 4_000_000
#: A lower bound is a byte, in units of this share of the distance that the vector had to its entry when it was stored.
FINE = 1 / 24
#: What bounds are widened by, for the rounding of square roots.
SLACK = 1e-9

STATE = "vec_id long, label string, x binary, code binary, upper binary, unit binary, lower binary"
STATE_ARROW = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), *((c, pa.binary()) for c in ("x", "code", "upper", "unit", "lower"))])


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """[row, component]"""
    limit = math.isqrt((1 << 62) // (4 * max(1, values.shape[1])))
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -limit, limit).astype(np.int64)


def kept(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, label and embedding of the vectors that can be coded, and their length."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding").where(good)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding").alias("n")).limit(1).collect()
    length = first[0].n if first else 0
    return rows.where(F.size("embedding") == length), length


@dataclass(frozen=True)
class Codebook:
    """entries[part, entry, position]; moved[part, entry]: how far an entry has come since bounds were stored, rounded up."""

    entries: np.ndarray
    moved: np.ndarray

    @staticmethod
    def first(seeds: np.ndarray) -> Codebook:
        """seeds[entry, component]."""
        entries = seeds.reshape(len(seeds), PARTS, seeds.shape[1] // PARTS).transpose(1, 0, 2).copy()
        return Codebook(entries, np.zeros(entries.shape[:2]))

    def after(self, means: dict[tuple[int, int], list[int]]) -> Codebook:
        """The entries of means put in place of the old ones; others stay."""
        new = self.entries.copy()
        for (part, entry), mean in means.items():
            new[part, entry] = mean
        return Codebook(new, np.sqrt(((new - self.entries) ** 2).sum(2)) * (1 + SLACK))

    def between(self) -> np.ndarray:
        """[part, entry, entry]: half the distances, rounded down."""
        e = self.entries
        return np.stack([np.sqrt(((c[:, None] - c[None]) ** 2).sum(2)) for c in e]) / 2 * (1 - SLACK)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def measured(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """[row, entry]: squared distances."""
    out = np.empty((len(x), len(entries)), np.int64)
    rows = max(1, BLOCK // max(1, entries.size))
    for a in range(0, len(x), rows):
        out[a : a + rows] = ((x[a : a + rows, None] - entries[None]) ** 2).sum(2)
    return out


def assigned(x: np.ndarray, entries: np.ndarray, half: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One part's new codes and bounds (not rounded), and how many distances were measured. half: half the distances between entries."""
    code, upper, lower = code.copy(), upper.copy(), lower.copy()
    every = np.arange(len(x))

    def open_(rows: np.ndarray) -> np.ndarray:
        u = upper[rows, None]
        near = (lower[rows] <= u) & (half[code[rows]] <= u)
        near[np.arange(len(rows)), code[rows]] = False
        return near

    rows = np.flatnonzero(open_(every).any(1))
    n = len(rows)
    own = ((x[rows] - entries[code[rows]]) ** 2).sum(1)
    upper[rows] = np.sqrt(own) * (1 + SLACK)
    near = open_(rows)
    r, c = np.nonzero(near)
    n += len(r)
    far = np.full(near.shape, np.iinfo(np.int64).max)
    far[np.arange(len(rows)), code[rows]] = own
    for a in range(0, len(r), BLOCK // max(1, x.shape[1])):
        i, j = r[a : a + BLOCK // x.shape[1]], c[a : a + BLOCK // x.shape[1]]
        far[i, j] = ((x[rows[i]] - entries[j]) ** 2).sum(1)
    # the first of equal ones has the lowest index
    code[rows] = far.argmin(1)
    known = far < np.iinfo(np.int64).max
    lower[rows] = np.where(known, np.sqrt(np.where(known, far, 0)) * (1 - SLACK), lower[rows])
    upper[rows] = np.sqrt(far.min(1)) * (1 + SLACK)
    return code, upper, lower, n


def stored(upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds as they are stored: upper and unit in 32 bits, lower in bytes; rounded outwards."""
    up = np.nextafter(upper.astype(np.float32), np.float32(np.inf))
    unit = (np.maximum(up, 1) * np.float32(FINE)).astype(np.float32)
    return up, unit, np.clip(np.floor(lower / unit[..., None].astype(np.float64)), 0, 255).astype(np.uint8)


def _numbers(column: pa.Array, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def first_codes(rows: DataFrame, book: Codebook) -> DataFrame:
    """All rows with codes and bounds: every distance is measured once."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = whole_numbers(b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            parts = x.reshape(b.num_rows, PARTS, -1)
            d = np.stack([measured(parts[:, p], book.entries[p]) for p in range(PARTS)], 1)
            code = d.argmin(2)
            up, unit, low = stored(np.sqrt(d.min(2)) * (1 + SLACK), np.sqrt(d) * (1 - SLACK))
            yield common.batch(STATE_ARROW, b.column("vec_id"), b.column("label"), *_binary(x.astype("<i4"), code.astype(np.uint8), up, unit, low))

    return common.map_batches(rows, f, STATE)


def _binary(*arrays: np.ndarray) -> list[list[bytes]]:
    return [[row.tobytes() for row in a] for a in arrays]


def _moved_on(b: pa.RecordBatch, book: Codebook, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x by part, codes and bounds of stored rows after the entries moved."""
    n = b.num_rows
    x = _numbers(b.column("x"), "<i4", n).astype(np.int64).reshape(n, PARTS, -1)
    code = _numbers(b.column("code"), "u1", n).astype(np.int64)
    upper, unit = (_numbers(b.column(c), "<f4", n).astype(np.float64) for c in ("upper", "unit"))
    lower = _numbers(b.column("lower"), "u1", n).reshape(n, PARTS, -1) * unit[:, :, None]
    out = []
    for p in range(PARTS):
        u, low = upper[:, p] + book.moved[p][code[:, p]], np.maximum(0, lower[:, p] - book.moved[p]) * (1 - SLACK)
        out.append(assigned(x[:, p], book.entries[p], half[p], code[:, p], u * (1 + SLACK), low)[:3])
    return x, *(np.stack(z, 1) for z in zip(*out, strict=True))


def next_codes(state: DataFrame, book: Codebook) -> DataFrame:
    """The same rows after a round."""
    half = book.between()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, code, upper, lower = _moved_on(b, book, half)
                yield common.batch(STATE_ARROW, *(b.column(c) for c in ("vec_id", "label", "x")), *_binary(code.astype(np.uint8), *stored(upper, lower)))

    return common.map_batches(state, f, STATE)


def last_codes(state: DataFrame, book: Codebook) -> DataFrame:
    """vec_id, label, code in hexadecimal digits, and error, the squared distances of all parts."""
    half = book.between()
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, code, _, _ = _moved_on(b, book, half)
                error = sum(((x[:, p] - book.entries[p][code[:, p]]) ** 2).sum(1) for p in range(PARTS))
                yield common.batch(schema, b.column("vec_id"), b.column("label"), [c.tobytes().hex() for c in code.astype(np.uint8)], error)

    return common.map_batches(state, f, "vec_id long, label string, code string, error long")


def means(state: DataFrame) -> dict[tuple[int, int], list[int]]:
    """By part and entry, for entries with vectors, floor(sum / count) of their components."""
    schema = pa.schema([(c, pa.int64()) for c in ("part", "entry", "at", "total", "n")])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = counts = None
        for b in batches:
            if not b.num_rows:
                continue
            x = _numbers(b.column("x"), "<i4", b.num_rows).astype(np.int64).reshape(b.num_rows, PARTS, -1)
            slot = _numbers(b.column("code"), "u1", b.num_rows).astype(np.int64) + np.arange(PARTS) * ENTRIES
            if totals is None:
                totals, counts = np.zeros((PARTS * ENTRIES, x.shape[2]), np.int64), np.zeros(PARTS * ENTRIES, np.int64)
            counts += np.bincount(slot.ravel(), minlength=len(counts))
            np.add.at(totals, slot.ravel(), x.reshape(-1, x.shape[2]))
        if totals is not None:
            s, at = (z.ravel() for z in np.meshgrid(np.flatnonzero(counts), np.arange(totals.shape[1]), indexing="ij"))
            yield common.batch(schema, s // ENTRIES, s % ENTRIES, at, totals[s, at], counts[s])

    sums = common.map_batches(state.select("x", "code"), f, "part long, entry long, at long, total long, n long").groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out: dict[tuple[int, int], list[int]] = {}
    # entries times a part's components: as many as a codebook has numbers
    for r in sums.orderBy("part", "entry", "at").collect():
        out.setdefault((r.part, r.entry), []).append(int(r.total) // r.n)
    return out


def quantize(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Codebook]:
    """vec_id, label, code and error of all vectors, and the codebooks after the rounds."""
    rows, length = kept(vectors)
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).select("embedding").collect()
    book = Codebook.first(whole_numbers(np.array([r.embedding for r in seeds], np.float64).reshape(len(seeds), length or PARTS)))
    state = common.cut(first_codes(rows, book)) if seeds else first_codes(rows, book)
    for k in range(rounds if seeds else 0):
        if k:
            last, state = state, common.cut(next_codes(state, book))
            common.drop(last)
        book = book.after(means(state))
    return last_codes(state, book), book


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (the sum over an equal label) and codebooks_sha256."""
    found, book = quantize(vectors)
    found = common.cut(found.select("vec_id", "code", "error", F.col("label").isNull().alias("_none"), F.coalesce("label", F.lit("")).alias("_label")))
    totals = found.groupBy("_none", "_label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("_n"))
    return common.join_counted(found, totals, ["_none", "_label"], "_n").select("vec_id", "code", "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))
