"""Sinks, and the rows that they write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as X
from .storage import exists, folders, move, names, put, remove


def json_lines(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    """One object a line, with explicit nulls."""
    w = df.write.mode(mode).option("ignoreNullFields", False)
    (w.partitionBy(*by) if by else w).json(path)


def splits(df: DataFrame, path: str) -> None:
    """A folder for each split; rows without is_synthetic get false."""
    out = df if "is_synthetic" in df.columns else df.withColumn("is_synthetic", F.lit(False))
    json_lines(out.withColumn("is_synthetic", F.coalesce("is_synthetic", F.lit(False))), path, by=["split"])


def decision_log(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of the gate's log: keys, hash of the content (or column image_hash), whether the language was accepted, and the gate's columns that are there."""
    more = [c for c in ("cleaned_text", "detected_language", "confidence", "fasttext_language", "bengali_unicode_ratio") if c in df.columns]
    own = F.col("image_hash") if "image_hash" in df.columns else X.image_hash(F.col("content"))
    return df.select(*keys, own.alias("image_hash"), *more, F.when(F.col("language").isin("bn", "en"), "accepted").otherwise("rejected").alias("routing_decision"))


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that add_files has added to path, in order."""
    return folders(spark, f"{path}/_log", "")


def add_files(df: DataFrame, path: str, batch: int, kind: str = "json", **options: object) -> bool:
    """Adds a batch's rows to the files in path, once: False if the batch is there.

    Files are written aside, then moved in under the batch's number, and last
    the batch is entered in path/_log.  A try that fails before that leaves no
    entry; the next one of the same number takes its files away first.
    """
    spark = df.sparkSession
    if exists(spark, f"{path}/_log/{batch}"):
        return False
    aside = f"{path}/_aside/{batch}"
    df.write.mode("overwrite").format(kind).options(**options).save(aside)
    for name in names(spark, path):
        if name.startswith(f"batch-{batch}-"):
            remove(spark, f"{path}/{name}")
    for k, name in enumerate(x for x in names(spark, aside) if x.startswith("part-")):
        move(spark, f"{aside}/{name}", f"{path}/batch-{batch}-{k:05d}{name[name.index('.') :]}")
    put(spark, f"{path}/_log/{batch}")
    remove(spark, aside)
    return True


def append_log(df: DataFrame, path: str, batch: int | None = None) -> None:
    """Rows with the time, after those that are there; a batch of one number is added once, however often it is tried. Without a number it gets the next one."""
    if batch is None:
        batch = max(committed(df.sparkSession, path), default=-1) + 1
    add_files(df.withColumn("timestamp", X.utc_now()), path, batch, ignoreNullFields=False)


def export_table(df: DataFrame, path: str) -> None:
    """Parquet with labels as JSON text, so that one schema holds for all sources."""
    out = df
    if "task_labels" in df.columns and dict(df.dtypes)["task_labels"] != "string":
        out = df.withColumn("task_labels", F.to_json("task_labels"))
    out.write.mode("overwrite").parquet(path)


CSV = {"header": True, "quoteAll": False, "escape": '"'}


def _marked(df: DataFrame) -> DataFrame:
    """With a byte order mark before the header."""
    return df.toDF("\ufeff" + df.columns[0], *df.columns[1:])


def snapshot(df: DataFrame, path: str) -> None:
    """The whole as CSV, with a byte order mark before the header, and as JSON lines."""
    _marked(df).write.mode("overwrite").options(**CSV).csv(f"{path}/csv")
    json_lines(df, f"{path}/json")


def add_snapshot(df: DataFrame, path: str, batch: int) -> None:
    """A batch's rows added once to the CSV and JSON lines of a snapshot."""
    add_files(_marked(df), f"{path}/csv", batch, "csv", **CSV)
    add_files(df, f"{path}/json", batch, ignoreNullFields=False)


def compact_snapshot(spark: SparkSession, path: str, schema: StructType, most: int) -> None:
    """Puts the files of a snapshot together where they are more than most: under the number of its last batch, then the old ones go."""
    old = [x for x in names(spark, f"{path}/json") if x.startswith("batch-")]
    if len(old) <= most:
        return
    rows = spark.read.schema(schema).json([f"{path}/json/{x}" for x in old])
    whole = f"{path}_whole"
    snapshot(rows.coalesce(max(1, most // 4)), whole)
    for kind in ("json", "csv"):
        last = committed(spark, f"{path}/{kind}")
        remove(spark, f"{path}/{kind}")
        move(spark, f"{whole}/{kind}", f"{path}/{kind}")
        for k in last:
            put(spark, f"{path}/{kind}/_log/{k}")
    remove(spark, whole)


def results_json(report: DataFrame, path: str) -> None:
    """mode, metric and value of an evaluation as one JSON line a mode; a metric with an error has that instead."""
    value = F.when(F.col("error").isNull(), F.to_json(F.struct("value"))).otherwise(F.to_json(F.struct("error"))) if "error" in report.columns else F.to_json(F.struct("value"))
    by_mode = report.groupBy("mode").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", value.alias("result"))))).alias("metrics"))
    json_lines(by_mode, path)
