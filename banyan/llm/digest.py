"""Canonical exact digest: fingerprints that agree for texts that differ in form alone.

A text's canonical form is its NFKC form, case-folded, NFKC again, with white
space folded to single spaces.  Its fingerprint is the 128-bit XXH3 of that
form in hexadecimal.  Rows group by fingerprint, and inside equal buckets by the
forms' bytes.  Two texts are alike (1.0) if their fingerprints agree and the
bytes of their canonical forms do, else not (0.0).

Null texts count as empty and all empty or white texts are alike.  Rows that
repeat a doc_id are ordered by a hash of text; null doc_ids come before all
others.  A group's id is the smallest doc_id in it, null if there is none.  A
very long text is digested whole; a task holds it and the one before it.  An
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: First hexadecimal digits of fingerprints that tell which texts may have a repeated one: 16 ** DIGITS bits, 2 MB, go to all tasks.
DIGITS = 6
LOWEST = -(1 << 63)

PAIR_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, form string"
PAIR_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("form", pa.string())])


def canonical(text: str) -> str:
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split())


def fingerprint(form: str) -> str:
    """Of a canonical form."""
    return xxhash.xxh3_128_hexdigest(form.encode())


def likeness(a: tuple[str, str], b: tuple[str, str]) -> float:
    """a, b: canonical form and its fingerprint. The bytes are compared only where the fingerprints agree."""
    return float(a[1] == b[1] and a[0] == b[0])


def canonical_forms(docs: DataFrame, some: np.ndarray | None = None) -> DataFrame:
    """doc_id, fingerprint and canonical form. some: bits by the fingerprint's first digits; rows whose bit isn't set are left out."""
    shared = None if some is None else docs.sparkSession.sparkContext.broadcast(some)
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string()), ("canonical", pa.string())])

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                form = canonical(text or "")
                own = fingerprint(form)
                at = int(own[:DIGITS], 16)
                if shared is None or shared.value[at >> 3] >> (at & 7) & 1:
                    rows.append((doc_id, own, form))
            if rows:
                yield common.batch(schema, *zip(*rows, strict=True))

    return common.map_batches(common.doc_columns(docs), forms, "doc_id long, fingerprint string, canonical string")


def canonical_groups(docs: DataFrame, found: DataFrame) -> DataFrame:
    """found with group_id and group_size. found: rows of docs with doc_id, fingerprint and form, the SHA-256 of the canonical form.

    Only texts whose fingerprint may occur twice or more are compared: a bit
    for each start of a repeated fingerprint, a bounded number, goes to all
    tasks.  Each task collapses its equal forms by their bytes, and one row of
    each goes on, so the rows of a large group are never brought together.  The
    more fingerprints repeat, the more other texts are compared with them.
    """
    twice = found.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")
    at = twice.select(F.conv(F.substring("fingerprint", 1, DIGITS), 16, 10).cast("int").alias("at")).distinct().toArrow().column("at").to_numpy()
    some = np.zeros(16**DIGITS, bool)
    some[at] = True
    forms = canonical_forms(docs, np.packbits(some, bitorder="little"))
    groups = forms.groupBy("fingerprint", "canonical").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size"))
    groups = common.cut(groups.where("group_size > 1").select("fingerprint", F.sha2("canonical", 256).alias("form"), "group_id", "group_size"))
    out = common.join_counted(found, groups, ["fingerprint", "form"], "group_size")
    return out.withColumns({"group_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("group_id")), "group_size": F.coalesce("group_size", F.lit(1))})


def _row(doc_id: int | None, text: str, this: tuple[str, str], after: str, following: tuple[str, str]) -> tuple:
    """One result; this and following: canonical form and fingerprint of the text and the next one."""
    half = len(text) // 2
    changed = text[: len(text) - half] + after[:half]
    form = canonical(changed)
    edited = (form, fingerprint(form))
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), this[1], edited[1], likeness(this, edited), likeness(this, following), hashlib.sha256(this[0].encode()).hexdigest()


def _form(text: str) -> tuple[str, str]:
    form = canonical(text)
    return form, fingerprint(form)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each text against its edited text and the next document's, in the order of doc_id (after the last: the first).

    The edited text has the last half (rounded down) of the code points
    replaced by as many first ones of the next document.  Rows are dealt by
    ranges of doc_id, those of one doc_id by ranges of their texts' hashes and
    then of places in the input, so that no doc_id fills a task.  A task reads
    its rows in order and holds one text at a time; the first and the last one of
    each task, two texts, are matched in a second step.  Adds form, the SHA-256
    of the canonical form.
    """
    docs = common.doc_columns(docs)
    moved = pa.schema([("i", pa.int64()), ("t", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("z", pa.binary())])
    edge_schema = pa.schema([*PAIR_ARROW, ("part", pa.int32()), ("head", pa.bool_()), ("z", pa.binary())])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(1).compress
        for b in batches:
            yield common.batch(moved, b.column("i"), b.column("t"), b.column("place"), b.column("doc_id"), pa.array(map(pack, common.texts(b)), pa.binary()))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, part, last = zstandard.ZstdDecompressor().decompress, TaskContext.get().partitionId(), None
        none = (None,) * len(PAIR_ARROW)
        for b in batches:
            out: list[tuple] = []
            for doc_id, z in zip(b.column("doc_id").to_pylist(), b.column("z").to_pylist(), strict=True):
                text = unpack(z).decode()
                form = _form(text)
                if last is None:
                    out.append((*none, part, True, z))
                else:
                    out.append((*_row(*last[:3], text, form), None, None, None))
                last = (doc_id, text, form, z)
            if out:
                yield common.batch(edge_schema, *zip(*out, strict=True))
        if last is not None:
            yield common.batch(edge_schema, *([x] for x in (last[0], *none[1:], part, False, last[3])))

    def edge(t: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        rows = {h: (i, unpack(z).decode()) for i, h, z in zip(*(t.column(c).to_pylist() for c in ("doc_id", "head", "z")), strict=True)}
        (doc_id, text), (_, after) = rows[False], rows[True]
        out = _row(doc_id, text, _form(text), after, _form(after))
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(out, PAIR_ARROW, strict=True)], schema=PAIR_ARROW)

    keyed = docs.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), F.monotonically_increasing_id().alias("place"), "doc_id", "text")
    dealt = common.map_batches(keyed, squeeze, "i long, t long, place long, doc_id long, z binary").repartitionByRange("i", "t", "place").sortWithinPartitions("i", "t", "place")
    found = common.cut(dealt.select("doc_id", "z").mapInArrow(pairs, f"{PAIR_SCHEMA}, part int, head boolean, z binary"))
    # one number for each task that had rows
    parts = sorted(r.part for r in found.where("head").select("part").collect())
    whole = found.where("part IS NULL").select(*PAIR_ARROW.names)
    if not parts:
        return whole
    before = docs.sparkSession.createDataFrame(list(zip(parts, parts[-1:] + parts[:-1], strict=True)), "part int, before int")
    edges = found.where("part IS NOT NULL").join(F.broadcast(before), "part").select(F.when(F.col("head"), F.col("before")).otherwise(F.col("part")).alias("pair"), "doc_id", "head", "z")
    return whole.union(edges.groupBy("pair").applyInArrow(edge, PAIR_SCHEMA))


def digests(docs: DataFrame) -> DataFrame:
    """edited_pairs, and the group of every row by canonical form."""
    found = common.cut(edited_pairs(docs))
    return canonical_groups(docs, found).drop("form")
