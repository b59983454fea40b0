"""The folder that driver and executors share, and what is kept there."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and one machine runs all (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="banyan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def place(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as that takes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}/{uuid.uuid4().hex}"
    system, folder = place(spark, path)
    system.deleteOnExit(folder)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    system, p = place(spark, path)
    return system.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    system, p = place(spark, path)
    return system.exists(p) and system.getFileStatus(p).isDirectory()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder has, in order; none if there is no folder."""
    system, p = place(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(p)) if system.exists(p) else []


def folders(spark: SparkSession, path: str, before: str) -> list[int]:
    """The numbers after a name's beginning, in order."""
    return sorted(int(x[len(before) :]) for x in names(spark, path) if x.startswith(before) and x[len(before) :].isdigit())


def move(spark: SparkSession, a: str, b: str) -> None:
    system, p = place(spark, a)
    if not system.rename(p, place(spark, b)[1]):
        raise OSError(f"{a} could not be moved to {b}")


def remove(spark: SparkSession, path: str) -> None:
    system, p = place(spark, path)
    system.delete(p, True)


def put(spark: SparkSession, path: str) -> None:
    """An empty file."""
    system, p = place(spark, path)
    system.create(p, True).close()


#: Rows and bytes of an Arrow batch at most, but for one row that has more.
BATCH_ROWS, BATCH_BYTES = 2048, 4_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes from now on, as texts can be very long and a worker holds a batch at a time; smaller ones stay."""
    for k, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        k = f"spark.sql.execution.arrow.{k}"
        # not above 0: no limit
        if not 0 < _bytes_of(spark.conf.get(k)) <= most:
            spark.conf.set(k, str(most))


def _bytes_of(value: str) -> int:
    """A setting's number; what has a unit counts as beyond any limit."""
    return int(value) if value.lstrip("-").isdigit() else 1 << 62


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2048, size: int = 8_000_000) -> Iterator[None]:
    """Arrow batches of few rows and bytes while something runs, as texts may be very long; what was set before holds again afterwards."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what it took is not done anew for each use; it goes when the application ends."""
    path = fresh(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_table(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet table at path, made and written once where it isn't there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
