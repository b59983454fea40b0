"""Row numbers within keys without bringing a key's rows together.

A window over a key puts all its rows in one task; a source may hold a third of
the table.  So rows are dealt to buckets that follow the order, the buckets'
counts (few rows) are summed up in order, and a window within (key, bucket)
numbers the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import fresh


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str = "rn", total: str | None = None) -> DataFrame:
    """Adds row numbers from 1 in the order, and the key's rows as total. bucket must not fall along the order."""
    parts = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*parts).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_rows").over(Window.partitionBy(*keys)))
    offsets = offsets.drop("_rows")
    # null keys and buckets must meet as well
    right = offsets.toDF(*[f"_r{i}" if i < len(parts) else c for i, c in enumerate(offsets.columns)])
    on = [F.col(p).eqNullSafe(F.col(f"_r{i}")) for i, p in enumerate(parts)]
    within = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
    return rows.withColumn("_within", within).join(right, on).withColumn(name, F.col("_before") + F.col("_within")).drop("_bucket", "_within", "_before", *[f"_r{i}" for i in range(len(parts))])


def by_digest(df: DataFrame, keys: list[str], seed: int, id_col: str, name: str = "rn", total: str | None = None) -> DataFrame:
    """Numbers in the order of md5 of seed and id: a shuffle that every run repeats. 4096 buckets by the digest's first digits."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    rows = df.withColumn("_digest", digest)
    out = numbered(rows, keys, F.substring("_digest", 1, 3), [F.col("_digest"), F.col(id_col)], name, total)
    return out.drop("_digest")


#: Bits below a partition's number in Spark's increasing ids.
WITHIN = 33


def hash_of(df: DataFrame) -> Column:
    """Of all columns; maps, which have no hash, as their entries."""
    return F.xxhash64(*[F.map_entries(f"`{c}`") if kind.startswith("map<") else F.col(f"`{c}`") for c, kind in df.dtypes])


def ranked(df: DataFrame, order: list[Column], ranges: int) -> DataFrame:
    """row (a struct of all columns) and rank, from 0, in the order, whatever its values are; rows that tie follow a hash of all columns.

    Rows are dealt to ranges whose bounds Spark samples from the data, sorted
    within each and stored; the ranges' counts, a number a range, tell where
    each starts.  No task has more than a range.
    """
    # the row in one column, so that its columns' names meet no other's
    keys = [f"k{i}" for i in range(len(order) + 1)]
    keyed = df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("row"), *[c.alias(k) for c, k in zip([*order, hash_of(df)], keys, strict=True)])
    path = fresh(df.sparkSession, "banyan-ranks")
    # the number of a row counts from its partition's start, and partitions follow the ranges
    keyed.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).select("row", F.monotonically_increasing_id().alias("at")).write.option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.parquet(path).withColumn("range", F.shiftright("at", WITHIN))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row a range
    starts = stored.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("before"))
    return stored.join(F.broadcast(starts), "range").select("row", (F.col("before") + F.col("at").bitwiseAND((1 << WITHIN) - 1)).alias("rank"))


def by_number(df: DataFrame, column: str, name: str = "line_no", ranges: int | None = None) -> DataFrame:
    """Numbers from 1 in the order of a column, however its values lie, for positional joins."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranked(df, [F.col(column)], ranges).select("row.*", (F.col("rank") + 1).alias(name))
