"""Training batches from translation pairs: batched tokenising, batches of like lengths, padding and masks.

A tokenizer is a function from a list of texts to their ids, asked once for a
batch of rows.  Rows are dealt to shards of a global shuffle; within a shard, so
in one task, they are sorted by length and cut into batches, so what stands in a
batch is about equally long and little is padded; the batches of a shard come in
a shuffled order.  Everything but the tokenizer is column work.

Null texts count as empty; ids are cut at ``longest``; ties of length follow the
shuffle's place; a shard's last batch may have fewer rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..sources.storage import bounded_batches
from . import shards

Tokenizer = Callable[[list[str]], list[list[int]]]
#: Ids that byte-level translation models give to padding, the end, and before bytes; and what labels have where they are padded.
PAD, END, FIRST_BYTE, IGNORED = 0, 1, 3, -100
#: Texts that a tokenizer is asked for at once.
ASKED = 512


def byte_tokenizer(texts: list[str]) -> list[list[int]]:
    """UTF-8 bytes as ids after the special ones, and the end: needs no file."""
    return [[b + FIRST_BYTE for b in t.encode()] + [END] for t in texts]


def file_tokenizer(path: str) -> Tokenizer:
    """Of a tokenizers library's JSON file, read once a worker; special strings of a text are ordinary text."""
    from ..backends import loaded

    def read():
        from tokenizers import Tokenizer as Library

        found = Library.from_file(path)
        found.encode_special_tokens = True
        return found

    return lambda texts: [e.ids for e in loaded(("tokenizer", path), read).encode_batch(texts, add_special_tokens=False)]


def tagged(text: Column, source: str, target: str) -> Column:
    """A text after the codes of its language and of the one that it is to be translated to."""
    return F.concat_ws(" ", F.lit(source), F.lit(target), text)


def tokenised(df: DataFrame, columns: dict[str, str], tokenizer: Tokenizer = byte_tokenizer, longest: int = 256) -> DataFrame:
    """df with a column of ids for each text column: columns maps texts to the new names. The tokenizer is asked for ASKED texts at a time."""
    schema = StructType([*df.schema.fields, *(StructField(c, ArrayType(IntegerType())) for c in columns.values())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for c in columns:
                texts = [x or "" for x in b.column(c).to_pylist()]
                ids = [pa.array([i[:longest] for i in tokenizer(texts[a : a + ASKED])], pa.list_(pa.int32())) for a in range(0, len(texts), ASKED)]
                new.append(pa.concat_arrays(ids) if ids else pa.array([], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *columns.values()])

    bounded_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def bucketed(df: DataFrame, lengths: list[Column], size: int, seed: int = 42) -> DataFrame:
    """Rows with shard and place; adds batch (the batch's place in its shard's shuffled order) and row (in the batch), both from 0, by sorted lengths."""
    at = F.row_number().over(Window.partitionBy("shard").orderBy(*lengths, "place")) - 1
    cut = df.withColumn("_at", at).withColumns({"_batch": F.floor(F.col("_at") / size), "row": F.pmod("_at", F.lit(size))})
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col("shard").cast("string"), F.lit("|"), F.col("_batch").cast("string")))
    # equal digests are one batch's: a dense rank numbers batches
    order = F.dense_rank().over(Window.partitionBy("shard").orderBy(digest, "_batch")) - 1
    return cut.withColumn("batch", order.cast("long")).withColumn("row", F.col("row").cast("long")).drop("_at", "_batch")


def padded(ids: Column, to: Column, fill: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(fill), (to - F.size(ids)).cast("int")))


def with_padding(df: DataFrame, source: str = "input_ids", target: str = "labels") -> DataFrame:
    """Adds source_length and target_length, and source_pad and target_pad: what each row lacks to its batch's longest."""
    whole = Window.partitionBy("shard", "batch")
    sized = df.withColumns({"source_length": F.size(source).cast("long"), "target_length": F.size(target).cast("long")})
    return sized.withColumns({f"{k}_pad": F.max(f"{k}_length").over(whole) - F.col(f"{k}_length") for k in ("source", "target")})


def training_rows(pairs: DataFrame, id_col: str, direction: str, tokenizer: Tokenizer = byte_tokenizer, longest: int = 256, size: int = 32, rows: int = 4096, seed: int = 42, codes: tuple[str, str] | None = None, by_length: bool = True) -> DataFrame:
    """pairs (id, source, target) to rows with shard, batch, row, input_ids, labels, their lengths and their padding. codes: languages that are put before the source, or None. Without by_length rows are cut into batches as they come."""
    found = shards.placed(pairs.select(id_col, "source", "target"), id_col, seed, rows)
    if codes:
        found = found.withColumn("source", tagged(F.col("source"), *codes))
    ids = tokenised(found, {"source": "input_ids", "target": "labels"}, tokenizer, longest).drop("source", "target").withColumn("direction", F.lit(direction))
    return with_padding(bucketed(ids, [F.size("input_ids"), F.size("labels")] if by_length else [], size, seed))


def batches(rows: DataFrame, pad: int = PAD) -> DataFrame:
    """A row for each batch: shard, batch, and as matrices input_ids, attention_mask and labels (IGNORED where padded), with the ids of its rows. As many rows meet as a batch has."""
    longest = lambda k: F.col(f"{k}_length") + F.col(f"{k}_pad")
    one = F.struct(
        "row",
        padded(F.col("input_ids"), longest("source"), pad).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), F.col("source_pad").cast("int"))).alias("attention_mask"),
        padded(F.col("labels"), longest("target"), IGNORED).alias("labels"),
    )
    names = ("input_ids", "attention_mask", "labels")
    return rows.groupBy("shard", "batch").agg(F.array_sort(F.collect_list(one)).alias("x")).select("shard", "batch", *[F.col(f"x.{c}").alias(c) for c in names])


def padding_share(rows: DataFrame) -> DataFrame:
    """ids, cells and the share of cells that are padding, of all batches."""
    own, pad = (F.sum(F.col(f"source_{k}") + F.col(f"target_{k}")) for k in ("length", "pad"))
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("shard", "batch").alias("batches"), own.alias("ids"), (own + pad).alias("cells")).withColumn("share", F.round((F.col("cells") - F.col("ids")) / F.col("cells"), 6))
