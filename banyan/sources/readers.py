"""Sources with explicit schemas and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import corpus as C
from .storage import exists


def parquet_shards(spark: SparkSession, path: str, cap: int | None = None, id_col: str = "idx", seed: int = 42) -> DataFrame:
    """Rows with their shard's name; of a total cap, each shard gives at most its share, chosen by digest."""
    df = spark.read.parquet(path).withColumn("shard", F.regexp_extract(F.input_file_name(), r"([^/]+)\.parquet$", 1))
    if cap is None:
        return df
    shards = len(df.inputFiles())
    return C.cap_per_key(df, "shard", max(1, cap // max(1, shards)), id_col, seed)


def _file_rows(df: DataFrame, name: str) -> DataFrame:
    """Adds the row's number in its file, from 0, to a file scan.

    A task reads a block's rows in order, so places count up within a block by
    one; blocks are few, and their counts are summed up in order.
    """
    at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place"))
    blocks = at.groupBy("_file", "_block").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    return at.join(F.broadcast(blocks), ["_file", "_block"]).withColumn(name, F.col("_before") + F.col("_place") - F.col("_first")).drop("_file", "_block", "_place", "_first", "_before")


def numbered_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """line_no and text of one file's lines in file order."""
    return _file_rows(spark.read.text(path), "line_no").select("line_no", F.col("value").alias(name))


def parallel_lines(spark: SparkSession, bn: str, en: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """Lines of two files side by side, as far as both go; n sampled line numbers of the first if asked."""
    a, b = numbered_lines(spark, bn, "bn"), numbered_lines(spark, en, "en")
    if n is not None:
        a = a.join(C.sample_n(a.select("line_no"), n, "line_no", seed), "line_no", "left_semi")
    return a.join(b, "line_no").select("line_no", F.trim("bn").alias("bn"), F.trim("en").alias("en"))


def _raw_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", drop_malformed: bool = False) -> DataFrame:
    r = spark.read.options(header=True, multiLine=True, escape='"', sep=sep, encoding="UTF-8", mode="DROPMALFORMED" if drop_malformed else "PERMISSIVE")
    return (r.schema(schema) if schema else r).csv(path)


def _without_mark(df: DataFrame) -> DataFrame:
    """A byte order mark before the first name goes."""
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", drop_malformed: bool = False) -> DataFrame:
    """Quoted, multi-line CSV with a header."""
    return _without_mark(_raw_csv(spark, path, schema, sep, drop_malformed))


def optional_csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """No rows if the file isn't there."""
    return csv(spark, path, schema, **options) if exists(spark, path) else spark.createDataFrame([], schema)


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


#: Lines of a proxy test set.
PROXY = "text string, source_dataset string, domain string, language_hint string"
# Columns that may hold labels of translated comments.
LABELS = ("Label", "Political", "Religious", "Gender", "Personal Offense", "Abusive/Violence", "Origin", "Body Shaming", "Misc")


def proxy_rows(spark: SparkSession, path: str) -> DataFrame:
    """A proxy test set of JSON lines in the unified schema: new ids from positions, where a row came from moved to the labels; no rows without the file."""
    rows = _file_rows(spark.read.schema(PROXY).json(path), "position") if exists(spark, path) else spark.createDataFrame([], f"{PROXY}, position long")
    labels = F.to_json(F.struct("source_dataset", "domain"))
    return C.unify(rows, "collected_tweets_proxy", F.col("position"), "monolingual_social", F.col("text"), "bn_en_mixed", task_labels=labels, license="derived", is_proxy=True)


def labelled_comments(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Splits of (bangla, english, Text) with label columns as unified translation rows; labels that are there as JSON."""
    rows = splits_csv(spark, paths)
    return C.unify(rows, "banth", F.concat_ws("_", "split", "row_no"), C.TRANSLATION, F.col("bangla"), "bn", F.col("english"), "en", F.col("Text"), "informal_social_youtube", labels_json(rows, *LABELS), "mit")


def transliteration_pairs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Files of (text_bengali, text_transliterated), by name, as unified rows; rows without Bengali text, and files without that column, give none."""
    rows = splits_csv(spark, paths)
    if "text_bengali" not in rows.columns:
        rows = rows.withColumn("text_bengali", F.lit(None).cast("string"))
    return C.unify(rows, "banglatlit", F.concat_ws("_", "split", "row_no"), "bn_transliteration", F.col("text_bengali"), "bn", romanized_text=F.col("text_transliterated"), register="transliteration_data", license="mit", extract=False)


def code_mixed_posts(spark: SparkSession, name: str, path: str, text: str, label: str, license: str, sep: str = ",") -> DataFrame:
    """A CSV of posts, malformed rows left out, as unified rows; the label, if there, as JSON."""
    rows = _without_mark(_file_rows(_raw_csv(spark, path, sep=sep, drop_malformed=True), "row_no"))
    labels = F.to_json(F.struct(F.col(f"`{label}`").cast("string").alias("label"))) if label in rows.columns else None
    return C.unify(rows, name, F.col("row_no"), "monolingual_social", F.col(f"`{text}`"), "bn_en_mixed", task_labels=labels, license=license)


def hashtag_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Hashtags with their segmentation as unified rows; none without the file."""
    if not exists(spark, path):
        rows = spark.createDataFrame([], "`Hashtag` string, `Final Segmentation` string, row_no long")
    else:
        rows = _without_mark(_file_rows(_raw_csv(spark, path), "row_no"))
    return C.unify(rows, "hashset", F.col("row_no"), "hashtag_segmentation", F.col("Hashtag"), "en", F.col("Final Segmentation"), "en", register="hashtag_data", license="research-use", extract=False)


def labels_json(df: DataFrame, *columns: str):
    """Those of columns that are there as one JSON text."""
    present = [F.col(f"`{c}`").cast("string").alias(c) for c in columns if c in df.columns]
    return F.to_json(F.struct(*present)) if present else F.lit(None).cast("string")


def splits_csv(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """CSV files of several splits with their split's name and the row's number in its file, from 0."""
    return C.union_all(*[_without_mark(_file_rows(_raw_csv(spark, path), "row_no")).withColumn("split", F.lit(split)) for split, path in paths.items()])


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, content and length of files, for recognition backends."""
    return spark.read.format("binaryFile").load(path).select("path", "content", "length")
