"""The offline build: unified rows to splits with synthetic rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import shards


def build_splits(unified: DataFrame, seed: int = 42, fraction: float = 0.08) -> DataFrame:
    """Unified rows with split and is_synthetic: shares by source, proxy rows in test, synthetic rows of train rows in train."""
    base = C.stratified_split(unified, "source_dataset", "id", seed, F.col("is_proxy_test_set")).withColumn("is_synthetic", F.lit(False))
    new = C.augment(base.where("split = 'train'").drop("is_synthetic"), fraction, seed)
    return C.union_all(base, new)


def write_splits(splits: DataFrame, path: str, seed: int = 42, rows: int = shards.ROWS) -> DataFrame:
    """Each split shuffled as a whole into ordered shards of path/split; returns split, shard, rows and checksum of all."""
    parts = [shards.write_shards(splits.where(F.col("split") == name), f"{path}/{name}", "id", seed, rows).withColumn("split", F.lit(name)) for name in ("train", "val", "test")]
    return C.union_all(*parts)


def live_rows(df: DataFrame) -> DataFrame:
    """Rows of a live CSV in the unified schema with three more flags; counters stay text in the labels."""
    labels = F.to_json(F.struct("topic", "like_count", "retweet_count", "view_count"))
    out = C.unify(df, "live_tweets", F.col("id"), "monolingual_social", F.col("text"), F.col("lang"), task_labels=labels, license="local-eval-only")
    return out.withColumns({"is_synthetic": F.lit(False), "is_paid_source": F.lit(True), "is_local_eval_only": F.lit(True)})
