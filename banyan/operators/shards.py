"""A global shuffle into ordered shards of a fixed number of rows, with a manifest.

The order is that of md5 of seed and id, which every run repeats.  Rows get their
place in the whole order by ranges whose bounds Spark samples from the data
(``numbering.ranked``), so their shard and their place there.  A second shuffle
sends each shard to one task, small shards by runs of ``LEAST`` rows at most, so
no task ever holds more than a range, a run or a shard, whatever the ids are, and
there are as many tasks as the rows need, however small the shards are: each task
tells the driver something.

Null ids count as the empty text.  Rows of equal id follow a hash of all their
columns: a hot id is spread over ranges and shards like any other rows, and rows
that are equal in everything are interchangeable.  An empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbering import ranked

ROWS = 100_000
#: Rows of a range and of a task at least, if there are as many: smaller shards share them.
LEAST = 16_384


def order_of(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def placed(df: DataFrame, id_col: str, seed: int = 42, rows: int = ROWS) -> DataFrame:
    """df with shard and place, both from 0: where each row stands in the order, cut into shards of so many rows; columns of these names are replaced. df is read three times: it should be a table."""
    found = ranked(df.drop("shard", "place"), [order_of(id_col, seed), F.col(id_col)], max(1, -(-df.count() // max(rows, LEAST))))
    return found.select("row.*", F.floor(F.col("rank") / rows).alias("shard"), F.pmod("rank", F.lit(rows)).alias("place"))


def one_task_each(df: DataFrame, shards: int, per: int = 1) -> DataFrame:
    """Rows with shard and place, each shard, or each run of per shards, in a partition of its own and in order."""
    return df.repartitionById(max(1, -(-shards // per)), F.floor(F.col("shard") / per).cast("int")).sortWithinPartitions("shard", "place")


def checksum(df: DataFrame) -> DataFrame:
    """shard, rows and checksum: the sum over rows of 48 bits of md5 of the place and all columns; so of content and order, and added up by task."""
    fields = [c for c in df.columns if c not in ("shard", "place")]
    text = lambda c, kind: F.to_json(F.struct(f"`{c}`")) if kind.startswith(("array<", "map<", "struct<")) else F.col(f"`{c}`").cast("string")
    kinds = dict(df.dtypes)
    # a null differs from an empty text
    row = F.concat_ws("|", "place", *[F.coalesce(text(c, kinds[c]), F.lit("\\N")) for c in fields])
    bits = F.conv(F.substring(F.md5(row), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.groupBy("shard").agg(F.count("*").alias("rows"), F.sum(bits).cast("string").alias("checksum"))


def read_shards(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Rows of all shards, with shard and place; schema: of them, for shards of an empty table."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path).withColumn("shard", F.col("shard").cast("long"))


def write_shards(df: DataFrame, path: str, id_col: str, seed: int = 42, rows: int = ROWS) -> DataFrame:
    """A file for each shard in path/shard=k, rows in order, each with its place; beside it, in path_manifest, a row for each shard, which is returned.

    The same rows give the same files' contents again.
    """
    spark = df.sparkSession
    found = placed(df, id_col, seed, rows)
    shards = (found.agg(F.max("shard")).first()[0] or 0) + 1
    one_task_each(found, shards, max(1, LEAST // rows)).write.mode("overwrite").partitionBy("shard").parquet(path)
    # of what was written, not of what was to be
    checksum(read_shards(spark, path, found.schema)).write.mode("overwrite").parquet(f"{path}_manifest")
    return spark.read.parquet(f"{path}_manifest")


def damaged(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Shards whose rows or checksum aren't those of the manifest: shard, what it says, and what is there (null: the shard isn't)."""
    there = checksum(read_shards(spark, path, schema)).toDF("shard", "found_rows", "found_checksum")
    both = spark.read.parquet(f"{path}_manifest").join(there, "shard", "full")
    return both.where(~(F.col("rows").eqNullSafe(F.col("found_rows")) & F.col("checksum").eqNullSafe(F.col("found_checksum"))))
