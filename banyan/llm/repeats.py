"""Suffix-array dedup: bytes covered by long strings that occur twice or more.

The method inserts one symbol of each document a round.  Whole documents would
need as many rounds as the longest one has bytes, each over all that went
before.  So three things differ from it, and none loses a repeated string:

1. Not documents but segments are inserted.  Each window of ``length`` bytes has
   one anchor, the leftmost 32-gram of least hash in it; equal windows have it
   at the same place.  The windows of one anchor form a segment, which is
   aligned at its anchor.  Only anchors whose hash occurs twice or more matter.
2. Wholly equal segments, such as those of exact copies, are collapsed by their
   bytes before anything is inserted; all their windows are repeated.
3. The transform itself isn't kept, only its newest column.  In a shard, the
   construction inserts one symbol of every segment a round, from the last
   column to the first.  It keeps the collection's order by suffix (a stable
   sort of the last order by anchor and symbol: the Burrows-Wheeler step) and
   the common prefixes of neighbours (one more than the least prefix between
   them before).  As equal windows start in the same column, older columns are
   final and needn't be looked up again.  The symbols come in sequence, column by
   column, from one external file.

A window is repeated if its common prefix with a neighbour reaches ``length``,
or if its segment occurs more than once.

A shard holds all segments of its anchors, ``SHARD_BYTES`` of them or one anchor's.
An anchor with more bytes than ``HOT_BYTES``, as a phrase that stands in very
many contexts has, is split: equal windows have the anchor at the same place, so
windows in whose first half it stands and those in whose second half it stands
are separate, and each half groups by the longer string around the anchor that
all its windows have.  This repeats until no group is too large; in the end the
string is the window.  Joins send what very many rows share to all tasks.

Null texts count as empty.  Texts under ``length`` bytes lose nothing.  Rows that
repeat a doc_id are documents of their own; so are wholly equal rows, which are
copies of each other.  Ties don't arise; an empty table gives no rows; further
columns are ignored by ``repeated_spans`` and kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 200
GRAM = 32
#: Bytes of distinct segments that a shard should have.
SHARD_BYTES = 1_000_000
#: Bytes of distinct segments of an anchor that is split, or one in so many of all bytes.
HOT_BYTES, HOT_SHARE = 2_000_000, 1 << 20
LOWEST = -(1 << 63)
#: Odd multipliers of the rolling hash: fixed, as equal texts must get equal anchors in all tasks.
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
BYTES = np.array([xxhash.xxh64_intdigest(bytes([i]), 1) for i in range(256)], np.uint64)


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of all 32-grams of the bytes x, by doubling."""
    h, n = BYTES[x], 1
    for m in MIX[:5]:
        h = h[:-n] * m + h[n:]
        n *= 2
    h ^= h >> np.uint64(29)
    h *= MIX[5]
    h ^= h >> np.uint64(32)
    return h


def anchors(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the bytes x: anchors' hashes, places, and first and last start of the windows that each has."""
    none = np.zeros(0, np.int64)
    if len(x) < length:
        return none, none, none, none
    h = gram_hashes(x)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, n = length - GRAM + 1, 1
    while 2 * n <= width:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    if n < width:
        low = np.minimum(low[: len(low) - (width - n)], low[width - n :])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    return h[place[first]].view(np.int64), place[first], first, last


def repeated_columns(groups: np.ndarray, offsets: np.ndarray, segments: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each segment, the runs (first, last) of its windows' starts that occur in another segment of its group.

    offsets: the anchor's place in each segment.
    """
    m = len(segments)
    sizes = np.fromiter(map(len, segments), np.int64, m)
    left, right = int(offsets.max()), int((sizes - offsets).max())
    columns = left + right
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    start, end = left - offsets, left - offsets + sizes  # in columns
    dense = np.unique(groups, return_inverse=True)[1].astype(np.int64)
    with tempfile.TemporaryFile() as spool:
        # blocks of segments are transposed, so that the file has them column by column within a block
        block = max(1, 4_000_000 // columns)
        for a in range(0, m, block):
            part = np.zeros((min(block, m - a), columns), np.uint8)
            for r in range(len(part)):
                part[r, start[a + r] : end[a + r]] = np.frombuffer(segments[a + r], np.uint8)
            spool.write(np.ascontiguousarray(part.T).tobytes())
        symbols = np.empty(m, np.uint8)
        order, prefix = np.zeros(0, np.int64), np.zeros(0, np.int16)
        ends, begins = np.argsort(end, kind="stable"), end
        sorted_ends = begins[ends]
        for c in range(columns - 1, -1, -1):
            for a in range(0, m, block):
                rows = min(block, m - a)
                spool.seek(a * columns + c * rows)
                symbols[a : a + rows] = np.frombuffer(spool.read(rows), np.uint8)
            # those whose last byte stands here come in before all others, with nothing in common; those that began go
            fresh = ends[np.searchsorted(sorted_ends, c + 1) : np.searchsorted(sorted_ends, c + 1, "right")]
            stay = start[order] <= c
            if not stay.all():
                # what goes leaves its neighbours the least prefix across it
                kept = np.flatnonzero(stay)
                if len(kept):
                    prefix = np.minimum.reduceat(prefix[: kept[-1] + 1], np.r_[0, kept[:-1] + 1])
                    order = order[kept]
                else:
                    order, prefix = order[:0], prefix[:0]
            order = np.concatenate([fresh, order])
            prefix = np.concatenate([np.zeros(len(fresh), np.int16), prefix])
            if not len(order):
                continue
            key = dense[order] * 256 + symbols[order]
            by = np.argsort(key, kind="stable")
            ordered = key[by]
            same = np.flatnonzero(ordered[1:] == ordered[:-1])
            new = np.zeros(len(order), np.int16)
            if len(same):
                pairs = np.empty(2 * len(same), np.int64)
                pairs[::2], pairs[1::2] = by[same] + 1, by[same + 1] + 1
                least = np.minimum.reduceat(np.append(prefix, np.int16(0)), pairs)[::2]
                new[same + 1] = np.minimum(least + 1, length)
            order, prefix = order[by], new
            # a window that starts in this column is repeated if a neighbour shares all of it
            full = prefix >= length
            hit = full | np.append(full[1:], False)
            for i in order[hit].tolist():
                at = c - int(start[i])
                runs = out[i]
                if runs and runs[-1][0] == at + 1:
                    runs[-1] = (at, runs[-1][1])
                else:
                    runs.append((at, at))
    return out


def _key() -> list[Column]:
    """Columns k and t that name a row: its doc_id (null: the lowest number) and a hash of its text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("k"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t")]


def _packed(docs: DataFrame) -> DataFrame:
    """k, t, doc_id and the text compressed, for shuffles."""
    schema = pa.schema([("k", pa.int64()), ("t", pa.int64()), ("doc_id", pa.int64()), ("z", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3).compress
        for b in batches:
            yield common.batch(schema, b.column("k"), b.column("t"), b.column("doc_id"), [z(x) for x in common.texts(b)])

    rows = docs.select(*_key(), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.map_batches(rows, pack, "k long, t long, doc_id long, z binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """k, t (see _key) and spans, an array of the (a, b) of bytes to remove, not merged; rows without any are left out."""
    if not GRAM <= length <= 30_000:
        raise ValueError("length must be from 32 to 30,000")
    keyed = docs.select(*_key(), F.col("text").cast("string").alias("text"))
    anchor_schema = pa.schema([("h", pa.int64()), ("k", pa.int64()), ("t", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = []
            for x in common.texts(b):
                # once, or twice if it occurs again: enough to tell what repeats, however often that is
                own, n = np.unique(anchors(np.frombuffer(x, np.uint8), length)[0], return_counts=True)
                each.append(np.repeat(own, np.minimum(n, 2)))
            n = [len(x) for x in each]
            yield common.batch(anchor_schema, np.concatenate(each) if each else [], np.repeat(b.column("k").to_numpy(), n), np.repeat(b.column("t").to_numpy(), n))

    found = common.cut(common.map_batches(keyed, find, "h long, k long, t long"))
    twice = common.cut(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    wanted = common.join_counted(found, twice, ["h"], "n", "inner", found.count()).groupBy("k", "t").agg(F.collect_set("h").alias("hs"))

    segment_schema = pa.schema([("h", pa.int64()), ("off", pa.int32()), ("seg", pa.binary()), ("s1", pa.int64()), ("s2", pa.int64()), ("k", pa.int64()), ("t", pa.int64()), ("at", pa.list_(pa.int32()))])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows: list[tuple] = []
            for k, t, z, hs in zip(*(b.column(c) for c in ("k", "t", "z", "hs")), strict=True):
                k, t, text = k.as_py(), t.as_py(), unpack(z.as_py())
                h, place, first, last = anchors(np.frombuffer(text, np.uint8), length)
                own_rows: dict[tuple[int, int], tuple] = {}
                for i in np.flatnonzero(np.isin(h, hs.values.to_numpy())).tolist():
                    seg = text[first[i] : last[i] + length]
                    own = int(h[i])
                    off = int(place[i] - first[i])
                    name = _name(seg, own, off)
                    # a segment that a text repeats is one row with all its places
                    if name in own_rows:
                        own_rows[name][-1].append(int(first[i]))
                    else:
                        own_rows[name] = (own, off, seg, *name, k, t, [int(first[i])])
                rows += own_rows.values()
                if len(rows) > 20_000:
                    yield common.batch(segment_schema, *zip(*rows, strict=True))
                    rows = []
            if rows:
                yield common.batch(segment_schema, *zip(*rows, strict=True))

    # wholly equal rows are documents of their own: each is joined by itself
    joined = _packed(docs).join(wanted, ["k", "t"])
    segments = common.cut(joined.select("k", "t", "z", "hs").mapInArrow(segment, "h long, off int, seg binary, s1 long, s2 long, k long, t long, at array<int>"))

    common.drop(found)
    common.drop(twice)

    # an anchor's bytes by the segments' names, so that segments needn't be dealt for it
    sizes = segments.select("h", "s1", "s2", F.octet_length("seg").alias("b")).distinct().groupBy("h").agg(F.sum("b").alias("b"))
    distinct = segments.groupBy("h", "off", "seg").agg(F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.sum(F.size("at")).alias("n"))
    distinct = distinct.select(F.col("h").alias("g"), F.lit(0).alias("lo"), F.lit(length - GRAM).alias("hi"), "off", "seg", "s1", "s2", "n")
    hits = _counted(_hits(distinct, sizes.select(F.col("h").alias("g"), "b"), length), segments)
    places = common.join_counted(segments.select("s1", "s2", "k", "t", "at"), hits, ["s1", "s2"], "m", "inner", segments.count())
    first_of_run = F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2))
    span = lambda p: F.transform(first_of_run, lambda i: F.struct((p + F.get("runs", i)).alias("a"), (p + F.get("runs", i + 1) + length).alias("b")))
    spans = places.select("k", "t", F.flatten(F.transform("at", span)).alias("s"))
    # wholly equal rows have equal spans: each task passes one of them on
    return spans.groupBy("k", "t").agg(F.flatten(F.collect_set("s")).alias("spans"))


def _name(seg: bytes, group: int, off: int) -> tuple[int, int]:
    """128 bits for a segment of a group, with its anchor at off."""
    d = xxhash.xxh3_128_digest(seg + group.to_bytes(8, "little", signed=True) + off.to_bytes(4, "little"))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _counted(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """hits, cut, with m, the number of rows of each name."""
    hits = common.cut(hits)
    n = rows.groupBy("s1", "s2").agg(F.count("*").alias("m"))
    return common.cut(hits.join(n, ["s1", "s2"]))


def _hits(pieces: DataFrame, sizes: DataFrame, length: int) -> DataFrame:
    """s1, s2 and runs of windows' starts (first, last, first, ...) for the pieces with repeated windows; a name may come twice.

    pieces: distinct segments (off, seg) of groups g, n of each, in whose windows
    the anchor stands lo to hi bytes from the start.  sizes: b, the bytes of each g.
    """
    sizes = common.cut(sizes)
    total = sizes.agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    # fewer than HOT_SHARE
    hot = sizes.where(F.col("b") > F.lit(max(HOT_BYTES, total // HOT_SHARE))).select("g")
    some = hot.count()
    cold = pieces.join(F.broadcast(hot), "g", "left_anti").union(pieces.where("lo = hi").join(F.broadcast(hot), "g", "left_semi").select(pieces.columns)) if some else pieces
    found = _sharded(cold, max(1, -(-total // SHARD_BYTES)), length)
    if not some:
        return found
    parts = common.cut(_halves(pieces.where("lo < hi").join(F.broadcast(hot), "g", "left_semi"), length))
    distinct = common.cut(parts.groupBy("g", "lo", "hi", "off", "seg").agg(F.first("c1").alias("s1"), F.first("c2").alias("s2"), F.sum("n").alias("n")).select(pieces.columns))
    below = _counted(_hits(distinct, distinct.groupBy("g").agg(F.sum(F.octet_length("seg")).alias("b")), length), parts.select(F.col("c1").alias("s1"), F.col("c2").alias("s2")))
    of = parts.select(F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("c1").alias("s1"), F.col("c2").alias("s2"), "shift")
    own = common.join_counted(of, below, ["s1", "s2"], "m", "inner")
    return found.union(own.select(F.col("p1").alias("s1"), F.col("p2").alias("s2"), F.transform("runs", lambda x: x + F.col("shift")).alias("runs")))


def _halves(pieces: DataFrame, length: int) -> DataFrame:
    """The two parts of each piece, named c1 and c2, that start shift bytes later: windows with the anchor in the first and in the second half of lo to hi."""
    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("shift", pa.int32()), ("g", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("off", pa.int32()), ("seg", pa.binary()), ("n", pa.int64())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s1, s2, lo, hi, off, seg, n in zip(*(b.column(c).to_pylist() for c in ("s1", "s2", "lo", "hi", "off", "seg", "n")), strict=True):
                middle, starts = (lo + hi) // 2, len(seg) - length
                for x, y in ((lo, middle), (middle + 1, hi)):
                    a, z = max(0, off - y), min(starts, off - x)
                    if a > z:
                        continue
                    # all windows with the anchor x to y bytes from their start have these bytes
                    group = xxhash.xxh64_intdigest(seg[off - x : off - y + length], x << 16 | y) - (1 << 63)
                    part = seg[a : z + length]
                    rows.append((s1, s2, *_name(part, group, off - a), a, group, x, y, off - a, part, n))
            if rows:
                yield common.batch(schema, *zip(*rows, strict=True))

    return common.map_batches(pieces, f, "s1 long, s2 long, c1 long, c2 long, shift int, g long, lo int, hi int, off int, seg binary, n long")


def _sharded(pieces: DataFrame, shards: int, length: int) -> DataFrame:
    """_hits of pieces none of whose groups is too large for a task."""
    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("runs", pa.list_(pa.int32()))])

    def shard(table: pa.Table) -> pa.Table:
        g, off = table.column("g").to_numpy(), table.column("off").to_numpy().astype(np.int64)
        segs, n = table.column("seg").to_pylist(), table.column("n").to_numpy()
        # an anchor with one segment has no other to be held against
        _, inverse, sizes = np.unique(g, return_inverse=True, return_counts=True)
        among = np.flatnonzero(sizes[inverse] > 1)
        runs: list[list[tuple[int, int]]] = [[] for _ in segs]
        if len(among):
            for i, r in zip(among.tolist(), repeated_columns(g[among], off[among], [segs[i] for i in among.tolist()], length), strict=True):
                runs[i] = r
        rows = []
        for s1, s2, seg, places, r in zip(table.column("s1").to_pylist(), table.column("s2").to_pylist(), segs, n.tolist(), runs, strict=True):
            r = [(0, len(seg) - length)] if places > 1 else r
            if r:
                rows.append((s1, s2, [y for x in r for y in x]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 3, schema, strict=True)], schema=schema)

    dealt = pieces.select("g", "off", "seg", "s1", "s2", "n", F.pmod(F.xxhash64("g"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").applyInArrow(shard, "s1 long, s2 long, runs array<int>")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _span_lists(column: pa.Array) -> list[list[tuple[int, int]]]:
    return [merged([(s["a"], s["b"]) for s in x or ()]) for x in column.to_pylist()]


def removal_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = []
            for z, runs in zip(b.column("z").to_pylist(), _span_lists(b.column("spans")), strict=True):
                text = unpack(z)
                kept, at = hashlib.sha256(), 0
                for a, e in runs:
                    kept.update(text[at:a])
                    at = e
                kept.update(text[at:])
                rows.append((len(text), sum(e - a for a, e in runs), len(runs), kept.hexdigest()))
            yield common.batch(schema, b.column("doc_id"), *(zip(*rows, strict=True) if rows else [[]] * 4))

    spans = repeated_spans(docs, length)
    joined = _packed(docs).join(spans, ["k", "t"], "left").select("doc_id", "z", "spans")
    return common.map_batches(joined, report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with all columns and without the repeated bytes in text; a character goes if all its bytes do."""

    @F.pandas_udf("string")
    def strip(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or s is None else without(x, merged([(int(p["a"]), int(p["b"])) for p in s])) for x, s in zip(text, spans, strict=True)], dtype=object)

    key = [f"_banyan_{c}" for c in ("k", "t", "spans")]
    spans = repeated_spans(docs, length).toDF(*key)
    k, t = _key()
    common.bounded_batches(docs.sparkSession)
    joined = docs.withColumns({key[0]: k, key[1]: t}).join(spans, key[:2], "left")
    return joined.select(*[strip(F.col("text").cast("string"), F.col(key[2])).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def without(text: str, runs: list[tuple[int, int]]) -> str:
    """text without the characters that lie wholly in runs of its UTF-8 bytes."""
    data = text.encode()
    whole = lambda i: i >= len(data) or data[i] & 0xC0 != 0x80
    out, at = [], 0
    for a, b in runs:
        while not whole(a):
            a += 1
        while not whole(b):
            b -= 1
        if b > a:
            out.append(data[at:a])
            at = b
    out.append(data[at:])
    return b"".join(out).decode()
