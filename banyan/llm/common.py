"""What the operators of this subpackage share: tables, cuts of lineage, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the word separators of the operators' contracts.
SPACE = "\\x20\\x09-\\x0D"
#: Maps A-Z to a-z in UTF-8 bytes and leaves all else alone.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Rows and bytes of an Arrow batch at most, but for one row that has more.
BATCH_ROWS, BATCH_BYTES = 4096, 4_000_000
#: A key is heavy if it has more than one row in so many.
SHARE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where that is unset and one machine runs all (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="banyan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders that cut() wrote, in order.
_CUTS: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost executor costs no recomputation.

    What isn't dropped before goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/banyan/{uuid.uuid4().hex}"
    _CUTS.append(path)
    system, folder = _place(spark, path)
    system.deleteOnExit(folder)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._banyan_path = path
    return out


def _place(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop(df: DataFrame) -> None:
    """Removes what cut() wrote, once nothing reads it any more."""
    path = getattr(df, "_banyan_path", None)
    if path:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    system, folder = _place(spark, path)
    system.delete(folder, True)
    system.cancelDeleteOnExit(folder)
    if path in _CUTS:
        _CUTS.remove(path)


def cut_after(make: Callable[[], DataFrame]) -> DataFrame:
    """What make gives, cut; the tables that it cut on its way are dropped, as nothing reads them any more."""
    before = set(_CUTS)
    out = cut(make())
    for path in [x for x in _CUTS if x not in before and x != out._banyan_path]:
        _remove(out.sparkSession, path)
    return out


def join_counted(rows: DataFrame, values: DataFrame, keys: list[str], n: str, how: str = "left", total: int | None = None) -> DataFrame:
    """rows joined to values, which have one row of each key and in n the number of rows that it meets; how: left or inner.

    Keys of more than 1 / SHARE of these rows, so fewer than SHARE, go to all
    tasks, and their rows stay where they are; only the rest is dealt by key.  So
    a key that a third of all rows have fills no task.  rows are read twice: they
    should be a table.  total: the sum of n, or more, where that is known.
    """
    if total is None:
        total = values.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    is_heavy = F.col(n) > F.lit(total / SHARE)
    heavy = F.broadcast(values.where(is_heavy))
    rest = rows.join(heavy.select(*keys), keys, "left_anti").join(values.where(~is_heavy), keys, how)
    return rows.join(heavy, keys).unionByName(rest)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few bytes: texts can be very long, and a worker holds one batch at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a batch's texts; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def doc_columns(df: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns of any name never clash with an operator's."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
