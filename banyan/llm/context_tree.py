"""Context-tree weighting over bytes, beside a smoothed unigram base.

A text is its words (lower-case A-Z) joined by single spaces, then one end
symbol (newline); before it stand newlines as context.  A byte is coded as its
eight bits along a binary tree.  Each (context of 0 to ``DEPTH`` bytes, place in
the binary tree) is a node with Krichevsky-Trofimov counts of the training
texts.  A node's weighted probability is half its own estimate and half the
product of those of its longer contexts; the odds of the two tell how much a
bit's prediction trusts the node, else longer contexts.  Where training has not
seen a longer context, the weights of the shorter ones are scaled to one.

Counting: each task cuts its texts into chunks and sends each chunk's distinct
(context, byte) grams, with their counts in training texts, in parts: grams that
agree in the ``NEAR`` nearest context bytes share a bucket, and so do all longer
contexts of a node.  Buckets grow with the number of chunks.  Each bucket adds up
its grams as they come, so a task holds distinct grams only, and keeps them as
the exact tree of its contexts of ``NEAR`` bytes and more.  Shallower nodes, at
most 16.7 million (60,000 of them in half a gigabyte of text), are put together
on the driver and sent to all tasks.  Scoring goes the same way: the chunks' own
grams pass by their bucket's tree, in runs of bounded size, and get their log
probabilities by it; each chunk adds them up along its texts.  The rows of one
bucket are dealt to several tasks where there are many chunks, so a frequent
context fills none.  No node is left out.

Base: log10 of (c + 0.5) / (N + 0.5 (V + 1)) per token.  Tokens of a count over
N / ``HEAVY``, fewer than ``HEAVY``, are broadcast; all others are joined by a
64-bit hash.

Null texts count as empty: the end alone.  Rows are told apart by doc_id and
text; equal rows and ties of any kind score alike, and null doc_ids train.  A
text of any length is cut into rows of the chunk that has it.  With no training rows the
model gives each bit one half, and base_score is that of c = N = V = 0.  An empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DEPTH = 5
#: Nearest context bytes that a bucket's grams share, and the number of buckets at least and at most.
NEAR, BUCKETS, MOST = 3, 1024, 65_536
#: Chunks whose grams of a bucket go to one task, and how often a task's chunks' grams may be those of its tree, before they are dealt to more tasks.
TOGETHER, TIMES = 2048, 2
HEAVY = 1 << 18
#: Bytes of text of a chunk, unless one text has more, and of a row that holds texts of it.
CHUNK, PART = 8_000_000, 1_000_000
#: Bytes of text that a task turns into grams at once, and entries that it holds before it sends them on.
SLICE, HELD = 1_000_000, 1_000_000
#: Words whose hashes a worker keeps.
WORDS = 200_000
#: The least probability of a bit: what differs from 1 in a double. A node would need some 10**15 equal bits to get there.
EPS = 2.0**-53
END = b"\n"
LOWEST = -(1 << 63)
MULT = np.uint64(0x9E3779B97F4A7C15)
CHUNK_SCHEMA = "kind string, chunk long, bucket int, m int, key long, n long, a binary, b binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(common.LOWER).split()


def sequence(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def is_training(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 != 1


def token_hash(word: bytes) -> int:
    """Signed; the end token is the empty word."""
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


class Hashes(dict):
    """token_hash of words, kept for short ones up to a number."""

    def __missing__(self, word: bytes) -> int:
        h = token_hash(word)
        if len(word) <= 32 and len(self) < WORDS:
            self[word] = h
        return h


def hashed(words: list[list[bytes]], hashes: Hashes) -> np.ndarray:
    """Hashes of the words of texts, each text's end after its own."""
    n = sum(map(len, words)) + len(words)
    return np.fromiter(map(hashes.__getitem__, itertools.chain.from_iterable((*w, b"") for w in words)), np.int64, n)


def grams(sequences: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram, number of its sequence) of all bytes of the sequences in order, in slices; a gram's lowest byte is the coded one, context above."""
    pad = END * depth
    group: list[bytes] = []

    def of(parts: list[bytes], first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x = np.frombuffer(pad + pad.join(parts), np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(sizes + depth) - sizes
        owner = np.repeat(np.arange(len(parts)), sizes)
        at = np.arange(len(owner)) + (starts - (np.cumsum(sizes) - sizes))[owner]
        for a in range(0, len(at), SLICE):
            # grams at all places of the stretch first, without a look-up a byte
            where = at[a : a + SLICE] - depth
            low, n = int(where[0]), int(where[-1] - where[0]) + 1
            g = np.zeros(n, np.uint64)
            for j in range(depth + 1):
                g = (g << np.uint64(8)) | x[low + j : low + j + n]
            yield g[where - low], owner[a : a + SLICE] + first

    size = first = 0
    for k, s in enumerate(sequences):
        group.append(s)
        size += len(s)
        if size >= SLICE:
            yield from of(group, first)
            group, size, first = [], 0, k + 1
    if group:
        yield from of(group, first)


def nearest_first(keys: np.ndarray, depth: int) -> np.ndarray:
    """Grams with their context bytes in reverse order, so that those of a bucket stand together when sorted; its own inverse."""
    out = np.zeros_like(keys)
    for j in range(1, depth + 1):
        out = (out << np.uint64(8)) | ((keys >> np.uint64(8 * j)) & np.uint64(255))
    return (out << np.uint64(8)) | (keys & np.uint64(255))


def squeeze(x: bytes) -> bytes:
    return pa.compress(x, codec="zstd", asbytes=True)


def expand(x: bytes, size: int) -> bytes:
    return pa.decompress(x, size, codec="zstd", asbytes=True)


def planes(x: np.ndarray) -> bytes:
    """Integers squeezed byte place by byte place."""
    return squeeze(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unplanes(x: bytes, m: int, dtype: type) -> np.ndarray:
    if not m:
        return np.zeros(0, dtype)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(expand(x, m * width), np.uint8).reshape(width, m).T).view(dtype).reshape(m)


def grams_in(x: bytes, m: int, depth: int) -> np.ndarray:
    """The grams of a row of kind g, in its order."""
    return nearest_first(np.cumsum(unplanes(x, m, np.uint64), dtype=np.uint64), depth)


def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, of = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(of, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)


def near(depth: int) -> int:
    return min(NEAR, depth)


def buckets_for(docs: DataFrame) -> int:
    """More buckets for more text, by the square root: their number times that of chunks is the rows' number."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    return int(min(MOST, max(BUCKETS, 32 * math.sqrt(size / CHUNK))))


def count(docs: DataFrame, depth: int, buckets: int = BUCKETS) -> DataFrame:
    """Rows of three kinds: 't' a token's key and its count n in training rows, to be added up; 'g' a chunk's m distinct grams of a bucket and
    their counts in training rows; 'd' n documents of a chunk, their sequences (m bytes) and their keys."""
    schema = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("m", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, tokens = Hashes(), []
        chunk = (TaskContext.get().partitionId() << 32) - 1
        held: list[tuple[bytes, int, int, bool, bool]] = []
        size = n_tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate([np.zeros(0, np.int64), *tokens]), return_counts=True)
            none = pa.nulls(len(keys))
            yield common.batch(schema, ["t"] * len(keys), *(none.cast(schema.field(k).type) for k in (1, 2, 3)), keys, n, none.cast(pa.binary()), none.cast(pa.binary()))
            tokens.clear()

        def documents() -> Iterator[pa.RecordBatch]:
            at = 0
            while at < len(held):
                end, part = at, 0
                while end < len(held) and (end == at or part + len(held[end][0]) <= PART):
                    part += len(held[end][0])
                    end += 1
                keys = np.array([(k, t, null, len(s)) for s, k, t, null, _ in held[at:end]], np.int64)
                yield common.batch(schema, ["d"], [chunk], [-1], [part], [None], [end - at], [squeeze(b"".join(x[0] for x in held[at:end]))], [squeeze(keys.tobytes())])
                at = end

        def distinct() -> Iterator[pa.RecordBatch]:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for trains in (True, False):
                for g, _ in grams([x[0] for x in held if x[4] == trains], depth):
                    keys, n = np.unique(g, return_counts=True)
                    found.append((nearest_first(keys, depth), n * trains))
            if not found:
                return
            keys, n = added(found)
            nearest = keys >> np.uint64(8 * (depth + 1 - near(depth)))
            bucket = ((nearest * MULT) >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            keys, n, bucket = keys[order], n[order], bucket[order].astype(np.int32)
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
                rows.append((int(bucket[a]), b - a, planes(np.diff(keys[a:b], prepend=np.uint64(0))), planes(n[a:b])))
            own, ms, ks, ns = zip(*rows, strict=True)
            yield common.batch(schema, ["g"] * len(rows), [chunk] * len(rows), own, ms, [None] * len(rows), [None] * len(rows), ks, ns)

        for b in batches:
            for text, i, k, t in zip(common.texts(b), *(b.column(c).to_pylist() for c in ("doc_id", "k", "t")), strict=True):
                words, trains = words_of(text), is_training(i)
                if trains:
                    tokens.append(hashed([words], hashes))
                    n_tokens += len(words)
                s = sequence(words)
                if not held or size + len(s) > CHUNK:
                    if held:
                        yield from distinct()
                        yield from documents()
                    held, size = [], 0
                    chunk += 1
                held.append((s, k, t, i is None, trains))
                size += len(s)
            if n_tokens > HELD:
                yield from flush()
                n_tokens = 0
        yield from distinct()
        yield from documents()
        yield from flush()

    keyed = common.doc_columns(docs).select(F.coalesce("doc_id", F.lit(LOWEST)).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "doc_id", "text")
    return common.map_batches(keyed, f, CHUNK_SCHEMA)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma of x >= 0.5, by Stirling's series after a shift to x >= 7."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(7):
        small = y < 7
        shift[small] += np.log(y[small])
        y[small] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any sequence with such counts."""
    a, b = n0.astype(float), n1.astype(float)
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - math.log(math.pi)


def weigh(own: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logs of own estimate and product of longer contexts: log of the weighted probability, and the trust in own."""
    d = np.clip(own - longer, -700, 700)
    return np.logaddexp(own, longer) - math.log(2), 1 / (1 + np.exp(-d))


def bit_nodes(keys: np.ndarray, n: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bit j of grams: the distinct nodes (context << 8 | place in the binary tree, 1 to 255) and their counts of bits 0 and 1."""
    nodes, of = np.unique(node_of(keys, j), return_inverse=True)
    one = bit_of(keys, j)
    weight = n.astype(float)
    return nodes, np.bincount(of[~one], weight[~one], len(nodes)), np.bincount(of[one], weight[one], len(nodes))


def node_of(keys: np.ndarray, j: int) -> np.ndarray:
    prefix = (np.uint64(1) << np.uint64(j)) | ((keys & np.uint64(255)) >> np.uint64(8 - j))
    return (keys & ~np.uint64(255)) | prefix


def bit_of(keys: np.ndarray, j: int) -> np.ndarray:
    return ((keys >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)


def shorter(nodes: np.ndarray, depth: int) -> np.ndarray:
    """The nodes with the context's farthest byte cut off, to depth bytes."""
    mask = np.uint64((1 << (8 * depth)) - 1)
    return (((nodes >> np.uint64(8)) & mask) << np.uint64(8)) | (nodes & np.uint64(255))


def levels(nodes: np.ndarray, n0: np.ndarray, n1: np.ndarray, deepest: int, least: int, longer: np.ndarray | None = None) -> dict[int, tuple]:
    """By depth, from deepest to least: nodes, counts, trust in own, log weighted probability, and each node's place in the depth above.

    longer: log products of contexts deeper than deepest; None if there are none.
    """
    out: dict[int, tuple] = {}
    for d in range(deepest, least - 1, -1):
        own = kt(n0, n1)
        weighted, trust = weigh(own, longer) if longer is not None else (own, np.ones(len(nodes)))
        if d == least:
            out[d] = (nodes, n0, n1, trust, weighted, None)
            break
        up, of = np.unique(shorter(nodes, d - 1), return_inverse=True)
        out[d] = (nodes, n0, n1, trust, weighted, of)
        add = lambda x: np.bincount(of, x, len(up))  # noqa: B023, E731
        nodes, n0, n1, longer = up, add(n0), add(n1), add(weighted)
    return out


class Top:
    """The nodes of less than near bytes, sorted: weighted estimates of bit 1 so far, their weights' sum (tiny, but not 0, where longer contexts are far better), and what is left."""

    def __init__(self, nodes: np.ndarray, n0: np.ndarray, n1: np.ndarray, longer: np.ndarray | None, near: int):
        self.depths: list[tuple[np.ndarray, ...]] = []
        self.near = near
        if not len(nodes):
            return
        found = levels(nodes.astype(np.uint64), n0, n1, near - 1, 0, longer)
        for d in range(near):
            at, a, b, trust, _, up = found[d]
            mix, used, left = (x[up] for x in self.depths[-1][1:]) if d else (0.0, 0.0, 1.0)
            self.depths.append((at, mix + left * trust * (b + 0.5) / (a + b + 1), used + left * trust, left * (1 - trust)))

    def state(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the deepest nodes, which must be there."""
        at, *values = self.depths[-1]
        i = np.searchsorted(at, nodes)
        return tuple(x[i] for x in values)

    def predict(self, nodes: np.ndarray) -> np.ndarray:
        """Of bit 1, at nodes of the deepest contexts here, by the longest that was seen."""
        out = np.full(len(nodes), 0.5)
        todo = np.arange(len(nodes))
        for d in range(len(self.depths) - 1, -1, -1):
            at, mix, used, _ = self.depths[d]
            x = shorter(nodes[todo], d)
            i = np.minimum(np.searchsorted(at, x), len(at) - 1)
            hit = at[i] == x
            out[todo[hit]] = mix[i[hit]] / used[i[hit]]
            todo = todo[~hit]
        return out


def predictions(keys: np.ndarray, n: np.ndarray, top: Top, depth: int, j: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By depth from near: all nodes of bit j of the grams, sorted, and their predictions of bit 1."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if not len(keys):
        return out
    found = levels(*bit_nodes(keys, n, j), depth, top.near)
    for d in range(top.near, depth + 1):
        nodes, n0, n1, trust, _, of = found[d]
        before, above, rest = top.state(shorter(nodes, d - 1)) if d == top.near else (mix[of], used[of], left[of])
        mix, used, left = before + rest * trust * (n1 + 0.5) / (n0 + n1 + 1), above + rest * trust, rest * (1 - trust)
        out[d] = (nodes, mix / used)
    return out


class Model:
    """What scoring needs: the shallow nodes and each bit's predictions, of which one is used at a time. Probabilities of a byte depend on its context alone and sum to one."""

    def __init__(self, top: Top, bits: Iterable[dict[int, tuple[np.ndarray, np.ndarray]]], depth: int):
        self.top, self.bits, self.depth = top, bits, depth

    def compute(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the byte given the context, for grams."""
        total = np.zeros(len(keys))
        for j, found in enumerate(self.bits):
            wanted = node_of(keys, j)
            p = np.empty(len(keys))
            todo = np.arange(len(keys))
            for d in range(self.depth, self.top.near - 1, -1):
                if d not in found:
                    continue
                nodes, ps = found[d]
                x = shorter(wanted[todo], d)
                at = np.minimum(np.searchsorted(nodes, x), len(nodes) - 1)
                hit = nodes[at] == x
                p[todo[hit]] = ps[at[hit]]
                todo = todo[~hit]
            p[todo] = self.top.predict(shorter(wanted[todo], self.top.near - 1))
            # a share of bits is never 0 or 1, but may be so close that a sum of doubles is
            total += np.log10(np.maximum(np.where(bit_of(keys, j), p, 1 - p), EPS))
        return total

    def logs(self, keys: np.ndarray) -> np.ndarray:
        distinct, of = np.unique(keys, return_inverse=True)
        return self.compute(distinct)[of]


class Lookup:
    """Values of a chunk's grams: a table of one entry a slot, and a search for those whose slot another holds."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(8, int(len(keys) * 4).bit_length()))
        slot = self.slots(self.keys)
        self.held = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.held[slot] = np.arange(len(slot), dtype=np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MULT) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.held[self.slots(keys)]
        miss = np.flatnonzero(self.keys[at] != keys)
        at[miss] = np.searchsorted(self.keys, keys[miss])
        return self.values[at]


def summed(batches: Iterable[pa.RecordBatch], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of rows of kind g that training texts have, and their counts; batches come one by one."""
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    size = 0
    for t in batches:
        for m, a, b in zip(*(t.column(c).to_pylist() for c in ("m", "a", "b")), strict=True):
            keys, n = np.cumsum(unplanes(a, m, np.uint64), dtype=np.uint64), unplanes(b, m, np.int64)
            held.append((keys[n > 0], n[n > 0]))
            size += m
            if size > HELD + 2 * len(held[0][0]):
                held, size = [added(held)], 0
    keys, n = added(held)
    return nearest_first(keys, depth), n


def in_order(keys: np.ndarray, n: np.ndarray, depth: int) -> tuple[bytes, bytes]:
    """Columns a and b of grams and counts."""
    keys = nearest_first(keys, depth)
    order = np.argsort(keys)
    return planes(np.diff(keys[order], prepend=np.uint64(0))), planes(n[order])


def merged(rows: DataFrame, depth: int) -> DataFrame:
    """bucket, m, a and b: the grams of all rows of a bucket added up. Rows of many chunks are added up by parts first."""
    schema = pa.schema([("bucket", pa.int32()), ("m", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = summed(batches, depth)
        yield common.batch(schema, [key[0].as_py()], [len(keys)], *([x] for x in in_order(keys, n, depth)))

    return rows.select("bucket", "part", "m", "a", "b").groupBy("bucket", "part").applyInArrow(add, "bucket int, m int, a binary, b binary")


def trees(grams_of: DataFrame, parts: int, depth: int) -> DataFrame:
    """bucket, m, a and b, the grams of training texts; and their sums at the nodes above: node, n0, n1, w (arrays)."""
    schema = pa.schema([("bucket", pa.int32()), ("m", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("node", pa.list_(pa.int32())), *((c, pa.list_(pa.float64())) for c in ("n0", "n1", "w"))])
    least = near(depth)

    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = summed(batches, depth)
        above: list[tuple] = [((),) * 4]
        for j in range(8) if len(keys) else ():
            nodes, n0, n1, _, weighted, _ = levels(*bit_nodes(keys, n, j), depth, least)[least]
            up, of = np.unique(shorter(nodes, least - 1), return_inverse=True)
            above.append((up.astype(np.int32), *(np.bincount(of, x, len(up)) for x in (n0, n1, weighted))))
        sums = [np.concatenate(c) for c in zip(*above, strict=True)]
        yield common.batch(schema, [key[0].as_py()], [len(keys)], *([x] for x in in_order(keys, n, depth)), [sums[0].astype(np.int32)], *([x] for x in sums[1:]))

    rows = grams_of.withColumn("part", F.pmod("chunk", F.lit(parts)))
    if parts > 1:
        rows = merged(rows, depth)
    return rows.select("bucket", "m", "a", "b").groupBy("bucket").applyInArrow(build, "bucket int, m int, a binary, b binary, node array<int>, n0 array<double>, n1 array<double>, w array<double>")


def top_of(built: DataFrame, depth: int) -> Top:
    each = built.select(F.inline(F.arrays_zip("node", "n0", "n1", "w")))
    found = each.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "w")]).orderBy("node").toArrow()
    return Top(*(found.column(c).to_numpy() for c in ("node", "n0", "n1", "w")), near(depth))


def build(counts: DataFrame, depth: int = DEPTH) -> tuple[Top, list[dict[int, tuple[np.ndarray, np.ndarray]]]]:
    """The whole model of count()'s rows on one machine, for tables that are small enough; score() never holds it."""
    if not 2 <= depth <= 6:
        raise ValueError("depth must be from 2 to 6")
    built = trees(counts.where("kind = 'g'"), 1, depth)
    top = top_of(built, depth)
    keys, n = summed(built.select("m", "a", "b").toArrow().to_batches(), depth)
    return top, [predictions(keys, n, top, depth, j) for j in range(8)]


def dealt(grams_of: DataFrame, built: DataFrame) -> DataFrame:
    """bucket and parts, the tasks that its chunks' grams go to. Each gets a copy of the tree, so a bucket has as many as its grams are TIMES its tree at most: the copies have no more grams than the chunks."""
    sizes = grams_of.groupBy("bucket").agg(F.count("*").alias("chunks"), F.sum("m").alias("grams")).join(built.select("bucket", F.col("m").alias("tree")), "bucket")
    by_size = F.ceil(F.col("grams") / (TIMES * F.greatest(F.col("tree"), F.lit(HELD))))
    return sizes.select("bucket", F.greatest(F.lit(1), F.least(F.ceil(F.col("chunks") / TOGETHER), by_size)).cast("int").alias("parts"))


def gram_logs(grams_of: DataFrame, built: DataFrame, top: Top, depth: int) -> DataFrame:
    """kind 'g', chunk, m, n, a and b: each chunk's grams of a bucket, and in b their log10 by the exact tree, single precision.

    A task reads a bucket's tree first and then the chunks' rows, some at a time.
    """
    schema = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("m", pa.int32()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
    shared = grams_of.sparkSession.sparkContext.broadcast(top)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        tree, at, held, size = none, None, [], 0

        def answer() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            every = [grams_in(a, m, depth) for _, m, a in held]
            keys, of = np.unique(np.concatenate(every), return_inverse=True)
            logs = Model(shared.value, (predictions(*tree, shared.value, depth, j) for j in range(8)), depth).compute(keys).astype(np.float32)[of]
            ends = np.cumsum([m for _, m, _ in held]).tolist()
            values = [logs[x:y].tobytes() for x, y in zip([0, *ends[:-1]], ends, strict=True)]
            yield common.batch(schema, ["g"] * len(held), *([r[c] for r in held] for c in (0, 1)), pa.nulls(len(held), pa.int64()), [a for _, _, a in held], values)

        for t in batches:
            for bucket, part, chunk, m, a, b in zip(*(t.column(c).to_pylist() for c in ("bucket", "part", "chunk", "m", "a", "b")), strict=True):
                if (bucket, part) != at:
                    yield from answer()
                    tree, at, held, size = none, (bucket, part), [], 0
                if chunk is None:
                    keys, n = np.cumsum(unplanes(a, m, np.uint64), dtype=np.uint64), unplanes(b, m, np.int64)
                    tree = (nearest_first(keys, depth), n)
                    continue
                held.append((chunk, m, a))
                size += m
                if size > max(HELD, 2 * len(tree[0])):
                    yield from answer()
                    held, size = [], 0
        yield from answer()

    none = F.lit(None)
    # a row a bucket, so MOST at most
    parts = F.broadcast(dealt(grams_of, built))
    own = built.join(parts, "bucket").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("parts") - 1).cast("long"))).alias("part"), none.cast("long").alias("chunk"), "m", "a", "b")
    rows = grams_of.join(parts, "bucket").select("bucket", F.pmod("chunk", F.col("parts")).alias("part"), "chunk", "m", "a", none.cast("binary").alias("b"))
    # null comes first: the tree before the chunks
    return own.union(rows).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "chunk").mapInArrow(f, "kind string, chunk long, m int, n long, a binary, b binary")


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every document."""
    if not 2 <= depth <= 6:
        raise ValueError("depth must be from 2 to 6")
    spark = docs.sparkSession
    counts = common.cut(count(docs, depth, buckets_for(docs)))
    of_tokens = common.cut(counts.where("kind = 't' and n > 0").groupBy(F.col("key").alias("h")).agg(F.sum("n").alias("c")))
    total, kinds = of_tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    spread = math.log10(total + 0.5 * (kinds + 1))
    heavy = of_tokens.where(F.col("c") > F.lit(total / HEAVY)).orderBy("h").toArrow()
    shared = spark.sparkContext.broadcast(tuple(heavy.column(c).to_numpy() for c in ("h", "c")))
    row_schema = pa.schema([("k", pa.int64()), ("t", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("size", pa.int64()), ("hs", pa.list_(pa.int64())), ("ns", pa.list_(pa.int32()))])

    def f(t: pa.Table) -> pa.Table:
        frequent, their = shared.value
        hashes = Hashes()
        held, parts = [], []
        for kind, m, n, a, b in zip(*(t.column(c).to_pylist() for c in ("kind", "m", "n", "a", "b")), strict=True):
            if kind == "g":
                held.append((grams_in(a, m, depth), np.frombuffer(b, np.float32)))
            else:
                parts.append((m, n, a, b))
        logs = Lookup(*(np.concatenate(x) for x in zip(*held, strict=True)))
        del held
        out = []
        for m, n, a, b in parts:
            text, keys = expand(a, m), np.frombuffer(expand(b, n * 32), np.int64).reshape(n, 4)
            ends = np.cumsum(keys[:, 3])
            sequences = [text[x:y] for x, y in zip((ends - keys[:, 3]).tolist(), ends.tolist(), strict=True)]
            words = [s.split() for s in sequences]
            n_tokens = np.fromiter(map(len, words), np.int64, n) + 1
            # each document's distinct tokens, in order, and how often it has them
            kinds, of = np.unique(hashed(words, hashes), return_inverse=True)
            pairs, times = np.unique(np.repeat(np.arange(n), n_tokens) * len(kinds) + of, return_counts=True)
            owner, of = np.divmod(pairs, len(kinds))
            at = np.minimum(np.searchsorted(frequent, kinds), max(0, len(frequent) - 1))
            seen = frequent[at] == kinds if len(frequent) else np.zeros(len(kinds), bool)
            log = np.log10(np.where(seen, their[at] if len(frequent) else 0, 0) + 0.5)
            here = seen[of]
            known = np.bincount(owner[here], times[here], n).astype(np.int64)
            base = np.bincount(owner[here], times[here] * log[of[here]], n)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[~here], minlength=n))]).astype(np.int32)
            lists = (pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (kinds[of[~here]], times[~here].astype(np.int32)))
            totals = np.zeros(n)
            for g, whose in grams(sequences, depth):
                totals += np.bincount(whose, logs(g), n)
            ids = pa.array(keys[:, 0], pa.int64(), mask=keys[:, 2].astype(bool))
            out.append(common.batch(row_schema, pa.array(keys[:, 0]), pa.array(keys[:, 1]), ids, n_tokens, known, base, totals, pa.array(keys[:, 3]), *lists))
        return pa.Table.from_batches(out, row_schema)

    texts = counts.where("kind = 'd'").select("kind", "chunk", "m", "n", "a", "b")
    grams_of = counts.where("kind = 'g'").select("bucket", "chunk", "m", "a", "b")
    parts = 1 + texts.agg(F.count_distinct("chunk")).first()[0] // TOGETHER
    built = common.cut(trees(grams_of, parts, depth))
    logs = gram_logs(grams_of, built, top_of(built, depth), depth)
    rows = common.cut(texts.unionByName(logs).groupBy("chunk").applyInArrow(f, "k long, t long, doc_id long, n_tokens long, known long, base double, score double, size long, hs array<long>, ns array<int>"))
    common.drop(counts)
    common.drop(built)
    # one row of those that are wholly equal stands for all
    light = rows.select("k", "t", F.explode(F.arrays_zip("hs", "ns")).alias("x")).select("k", "t", F.col("x.hs").alias("h"), F.col("x.ns").alias("n"))
    rest = light.join(of_tokens, "h", "left").groupBy("k", "t").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rest"))
    copies = rows.groupBy("k", "t").agg(F.count("*").alias("m"))
    added = copies.join(rest, ["k", "t"], "left").select("k", "t", (F.coalesce("more", F.lit(0)) / F.col("m")).cast("long").alias("more"), (F.coalesce("rest", F.lit(0.0)) / F.col("m")).alias("rest"))
    return rows.drop("hs", "ns").join(added, ["k", "t"]).select(
        "doc_id",
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.col("more")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rest") - F.col("n_tokens") * F.lit(spread)).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(math.log2(10)) / F.col("size")).alias("bits_per_byte"),
    )
