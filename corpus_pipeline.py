"""A training-data pipeline: quality rules, near-dedup, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the one
before kept, and returns the columns of documents; the last returns the packed
pieces.  Null texts, empty tables, repeated rows and ties are as each operator
defines them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banyan.llm import common, packing, quality, repeats, secret_scan, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text has them now."""
    return df.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps. Rules read nothing but the row, so the row itself carries the verdict."""
    return documents(quality.keep(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints one document: the row of least doc_id, then of least hash of its text.

    Rows are chosen as rows, as a doc_id may stand beside several texts; a row
    without doc_id is chosen where no row of the component has one.
    """
    return documents(simhash.one_row_each(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long strings that occur twice or more."""
    return documents(repeats.remove_repeats(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced."""
    return documents(secret_scan.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.harmonic_pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("repeated_passages", repeated_passages), ("secrets", secrets), ("packing", pack)]

#: SQL can't say tokens, XXH64 or entropy windows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.cut_after(lambda: stage(spark, stored, sf_dir))  # noqa: B023
        common.drop(stored)
        stored = docs
    return STAGES[-1][1](spark, docs, sf_dir)
