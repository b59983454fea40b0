"""SimHash near-dedup: exact Hamming joins through vantage-point trees, then components.

A fingerprint has 64 bits over three-word shingles (see ``fingerprints``).  Two
fingerprints within ``radius`` bits are within ``radius // 2`` in the upper or
the lower half, so each half, a metric of its own, has a vantage-point tree: an
inner node holds a vantage point and the median distance of a sample to it.  A
fingerprint's home is one leaf; as a query it also visits every leaf that the
triangle inequality doesn't rule out.  Each leaf is a shard.  In a shard all
homes are held against all visitors by their whole distance, large shards
through a further tree over all 64 bits.  A shard emits a spanning forest of
what it links, never its pairs; equal fingerprints are collapsed before.  The
forests join to components by alternating star steps, written to the shared
folder after each step.

Leaves grow with the number of fingerprints up to ``LEAVES``.  A leaf with more
than ``HOT`` homes, as when many fingerprints share a half, is split again by a
tree over all 64 bits of its own homes, while there are no more than ``LEAVES``
further leaves; beyond that leaves grow with the data, and a shard of many homes
is searched by a tree of its own.  Joins by fingerprint or by component
send keys of many rows to all tasks, so a large group of copies or a large
component fills none.

Null texts count as empty; texts without words have fingerprint zero, which
links like any other.  Rows with a null doc_id get the component of their
fingerprint, null if no doc_id is in it.  Repeated rows and ties share a
fingerprint and a component.  A very long text is hashed whole by one task, and
only its fingerprint goes on.  An empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RADIUS = 3
#: Fingerprints that a leaf of the shared trees should have.
LEAF = 1024
#: The trees have so many leaves at most, and are fitted on so many sampled fingerprints for each leaf, or on LEAST: 8 MB at most.
LEAVES, EACH, LEAST = 65_536, 16, 65_536
#: Homes of a leaf that is split again.
HOT = 65_536
#: Homes that a shard holds against all its visitors at once.
BRUTE = 1024
#: Fingerprints that a task sends through the trees at once.
ROUTED = 16_384

FINGERPRINT_SCHEMA = "doc_id long, fp long, t long"
#: One entry of the tables below: masks of the two halves.
HALVES = (np.uint64(0xFFFFFFFF00000000), np.uint64(0x00000000FFFFFFFF))
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes) -> int:
    """Signed 64 bits: bit i is set if more than half of the shingles' XXH64 (seed 42) have it."""
    words = text.translate(common.LOWER).split()
    if not words:
        return 0
    if len(words) <= 3:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-3].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, (ends[2:] - 1).tolist(), strict=True)]
    h = np.array(hashes, np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed) and t, a hash of the text, of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("t", pa.int64())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield common.batch(schema, b.column("doc_id"), [fingerprint(x) for x in common.texts(b)], b.column("t"))

    return common.map_batches(common.doc_columns(docs).withColumn("t", F.xxhash64("text")), f, FINGERPRINT_SCHEMA)


class Tree:
    """A vantage-point tree over x & mask; leaves are numbered from first."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, leaves: int, first: int):
        self.mask, self.nodes, self.first, self.leaves = mask, [], first, 0
        self._grow(sample & mask, leaves)

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        """Index of the new node: ("leaf", number), or (point, median, inner, outer)."""
        at = len(self.nodes)
        self.nodes.append(None)
        if leaves > 1 and len(x) > 1:
            # of a few candidates, the point from which the distances spread most
            tried = x[:: max(1, len(x) // 8)]
            d = np.bitwise_count(tried[:, None] ^ x[None, :])
            k = int(d.std(axis=1).argmax())
            middle = int(np.median(d[k]))
            inner = d[k] <= middle
            if not inner.all():
                self.nodes[at] = (tried[k], middle, self._grow(x[inner], leaves - leaves // 2), self._grow(x[~inner], leaves // 2))
                return at
        self.nodes[at] = ("leaf", self.first + self.leaves)
        self.leaves += 1
        return at

    def route(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index in x, leaf, whether it is home) for each leaf that each of x must visit."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo = [(0, np.arange(len(x)), np.ones(len(x), bool))]
        own = x & self.mask
        while todo:
            at, i, home = todo.pop()
            node = self.nodes[at]
            if node[0] == "leaf":
                found.append((i, np.full(len(i), node[1], np.int32), home))
                continue
            point, middle, inner, outer = node
            d = np.bitwise_count(own[i] ^ point).astype(np.int16)
            for child, visits, own_side in ((inner, d - radius <= middle, d <= middle), (outer, d + radius > middle, d > middle)):
                if visits.any():
                    todo.append((child, i[visits], home[visits] & own_side[visits]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def links(homes: np.ndarray, visitors: np.ndarray, radius: int, others: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """For each visitor with homes within radius: its index, and the indexes of those. others: leaves out visitors that meet none but themselves."""

    def brute(h: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        # a visitor may be a home in another part of the search
        own = np.isin(visitors[v], homes[h]) if others else np.zeros(len(v), bool)
        for a in range(0, len(v), 256):
            part = v[a : a + 256]
            near = np.bitwise_count(visitors[part][:, None] ^ homes[h][None, :]) <= radius
            for r in np.flatnonzero(near.sum(1) > own[a : a + 256]):
                yield int(part[r]), h[near[r]]

    def search(h: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if not len(h) or not len(v):
            return
        if len(h) > BRUTE:
            point = homes[h[0]]
            dh, dv = (np.bitwise_count(x ^ point).astype(np.int16) for x in (homes[h], visitors[v]))
            middle = int(np.median(dh))
            inner = dh <= middle
            if not inner.all():
                yield from search(h[inner], v[dv - radius <= middle])
                yield from search(h[~inner], v[dv + radius > middle])
                return
        yield from brute(h, v)

    return search(np.arange(len(homes)), np.arange(len(visitors)))


def forest(visitors: np.ndarray, at_home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(child, root) of a spanning forest over the links of visitors, which have no repeats, with those of them that are homes. Only what has links takes more than a few bytes."""
    place = np.flatnonzero(at_home)
    parent: dict[int, int] = {}

    def find(i: int) -> int:
        root = i
        while (up := parent.get(root, root)) != root:
            root = up
        while i != root:
            parent[i], i = root, parent.get(i, i)
        return root

    label = np.arange(len(visitors), dtype=np.int32)
    for v, near in links(visitors[place], visitors, radius, others=True):
        # label is a root of some time before: a few different ones stand for many neighbours
        for i in np.unique(label[place[near]]).tolist():
            a, b = find(v), find(i)
            if a != b:
                parent[max(a, b)] = min(a, b)
        label[place[near]] = label[v] = find(v)
    child = np.array(list(parent), np.int64)
    roots = np.array([find(i) for i in child.tolist()], np.int64)
    own = roots != child
    return visitors[child[own]], visitors[roots[own]]


def _highest(share: float) -> int:
    """The greatest hash of such a share of all."""
    return min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, share)))


def _sample(fps: DataFrame, share: float) -> DataFrame:
    """r and fp of about such a share of the rows: the lowest of a hash, so the same whatever the partitions are."""
    return fps.select("*", F.xxhash64("fp", F.lit(7)).alias("r")).where(F.col("r") <= _highest(share))


def _values(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def _trees(fps: DataFrame, n: int, leaf: int) -> list[Tree]:
    """A tree over each half of the bits."""
    wanted = max(1, min(LEAVES, n // leaf))
    size = max(LEAST, EACH * wanted)
    sample = _values(_sample(fps, 2 * size / max(n, 1)).orderBy("r", "fp").limit(size).select("fp").toArrow().column("fp")) if wanted > 1 else np.zeros(0, np.uint64)
    trees, first = [], 0
    for mask in HALVES:
        trees.append(Tree(sample, mask, wanted, first))
        first += trees[-1].leaves
    return trees


def _counted_homes(fps: DataFrame, trees: list[Tree]) -> DataFrame:
    """leaf and n: home leaves in both trees, counted by task."""
    schema = pa.schema([("leaf", pa.int32()), ("n", pa.int64())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(trees[-1].first + trees[-1].leaves, np.int64)
        for b in batches:
            x = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for t in trees if len(x) else ():
                counts += np.bincount(t.route(x, 0)[1], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield common.batch(schema, at.astype(np.int32), counts[at])

    return fps.mapInArrow(f, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n"))


def _sampled_homes(fps: DataFrame, trees: list[Tree], shares: dict[int, float]) -> DataFrame:
    """leaf and fp: of each leaf in shares about that share of its homes, the lowest of a hash."""
    schema = pa.schema([("leaf", pa.int32()), ("fp", pa.int64())])
    highest = np.full(trees[-1].first + trees[-1].leaves, -(2**63), np.int64)
    for leaf, share in shares.items():
        highest[leaf] = _highest(share)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, r = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), b.column("r").to_numpy(zero_copy_only=False)
            for t in trees if len(x) else ():
                i, leaf_of, _ = t.route(x, 0)
                own = r[i] <= highest[leaf_of]
                yield common.batch(schema, leaf_of[own], x[i[own]].view(np.int64))

    return _sample(fps, max(shares.values())).mapInArrow(f, "leaf int, fp long")


def _split(fps: DataFrame, trees: list[Tree], leaf: int) -> dict[int, Tree]:
    """For each leaf with more than HOT homes, a tree over all bits of those; at most LEAVES further leaves in all, so of more than half as many hot leaves the largest are split.

    What comes to the driver is two numbers for each leaf, and about 2 * EACH homes of each further leaf.
    """
    counted = _counted_homes(fps, trees).where(F.col("n") > HOT).orderBy(F.desc("n"), "leaf").limit(max(1, LEAVES // 2))
    hot = {r.leaf: r.n for r in counted.collect()}
    if not hot:
        return {}
    wanted = {k: max(2, min(n // leaf, LEAVES // len(hot))) for k, n in hot.items()}
    found = _sampled_homes(fps, trees, {k: 2 * EACH * wanted[k] / n for k, n in hot.items()}).orderBy("leaf", F.xxhash64("fp", F.lit(7))).toArrow()
    leaf_of, fp = found.column("leaf").to_numpy(), _values(found.column("fp"))
    out, first = {}, trees[-1].first + trees[-1].leaves
    for k in sorted(hot):
        a, z = np.searchsorted(leaf_of, (k, k + 1))
        out[k] = Tree(fp[a:z][: EACH * wanted[k]], ALL, wanted[k], first)
        first += out[k].leaves
    return out


def routes(x: np.ndarray, trees: list[Tree], split: dict[int, Tree], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(leaf, index in x, whether it is home) of all leaves that each of x visits. A leaf that is split is gone through once, whatever their number: its visitors stand together."""
    hot = np.zeros(trees[-1].first + trees[-1].leaves, bool)
    hot[list(split)] = True
    for t in trees:
        i, leaf_of, home = t.route(x, radius // 2)
        again = hot[leaf_of]
        yield leaf_of[~again], i[~again], home[~again]
        order = np.flatnonzero(again)[np.argsort(leaf_of[again], kind="stable")]
        ends = [*(np.flatnonzero(np.diff(leaf_of[order])) + 1).tolist(), len(order)]
        for a, z in zip([0, *ends[:-1]], ends, strict=True) if len(order) else ():
            at = order[a:z]
            j, part, own = split[int(leaf_of[at[0]])].route(x[i[at]], radius)
            yield part, i[at[j]], home[at[j]] & own


def hamming_links(fps: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """u, v: links that connect exactly what is connected by pairs within radius. fps: distinct values fp."""
    common.bounded_batches(fps.sparkSession)
    trees = _trees(fps, fps.count(), leaf)
    split = _split(fps, trees, leaf)
    routed_schema = pa.schema([("leaf", pa.int32()), ("fp", pa.int64()), ("home", pa.bool_())])
    link_schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def routed(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for leaf_of, at, home in routes(x, trees, split, radius):
            yield common.batch(routed_schema, leaf_of, x[at].view(np.int64), home)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(held[-1])
            if size >= ROUTED:
                yield from routed(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from routed(np.concatenate(held))

    def shard(t: pa.Table) -> pa.Table:
        x = t.column("fp").to_numpy().view(np.uint64)
        child, root = forest(x, t.column("home").to_numpy(zero_copy_only=False), radius)
        return pa.Table.from_arrays([pa.array(a.view(np.int64)) for a in (child, root)], schema=link_schema)

    return fps.mapInArrow(route, "leaf int, fp long, home boolean").groupBy("leaf").applyInArrow(shard, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for every node of edges u, v; alternating large and small stars."""
    e = common.cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
        # seen[0] links: no star has more, and stars of many go to all tasks
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        up = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = common.join_counted(up, low, ["u"], "n", "inner", seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = common.join_counted(large, low, ["u"], "n", "inner", seen[0]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, common.cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        common.drop(last)


def least_of_components(fps: DataFrame, radius: int, value: Column) -> DataFrame:
    """fp and n of every fingerprint: its rows; and least: the least value in all rows that its links reach, null if there is none."""
    # the least of each fingerprint collapses equal texts before anything is joined
    each = common.cut(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min(value).alias("least")))
    found = components(hamming_links(each.select("fp"), radius))
    of = found.select(F.col("node").alias("fp"), "root").union(found.select(F.col("root").alias("fp"), "root").distinct())
    named = common.cut(of.join(each, "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("all"), F.count("*").alias("m"))
    linked = common.join_counted(named, least, ["root"], "m").select("fp", "all")
    return each.join(linked, "fp", "left").select("fp", "n", F.coalesce("all", "least").alias("least"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach."""
    fps = common.cut(fingerprints(docs).drop("t"))
    least = common.cut(least_of_components(fps, radius, F.col("doc_id")))
    return common.join_counted(fps, least, ["fp"], "n").select("doc_id", "fp", F.col("least").alias("component_id"))


def one_row_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Of each component one row, all columns: the one of least doc_id, then of least hash of its text; rows without doc_id come last."""
    fps = common.cut(fingerprints(docs))
    no_id = F.col("doc_id").isNull()
    found = least_of_components(fps, radius, F.struct(no_id.alias("_n"), F.col("doc_id").alias("_k"), F.col("t").alias("_t")))
    # a doc_id may stand beside different texts: rows are told apart by both
    keep = found.select("least.*").distinct().withColumn("_k", F.coalesce("_k", F.lit(0)))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    key = (no_id.alias("_n"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_k"), F.xxhash64(F.col("text").cast("string")).alias("_t"))
    # of rows that agree in both, the one of least hash: each task passes one of them on
    rows = docs.groupBy(*key).agg(F.min_by(row, F.xxhash64(row)).alias("_row"))
    return rows.join(keep, ["_n", "_k", "_t"], "left_semi").select("_row.*")
