"""Candidates: dedupe, best of each source, quotas, deltas between modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .corpus import first_wins


def dedupe_candidates(df: DataFrame, keys: tuple[str, ...] = ("source_id", "engine"), text: str = "text", order: str = "cand_idx") -> DataFrame:
    """The first candidate of each text within an engine; empty texts go."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.where(F.col(text) != "").groupBy(*keys, text).agg(F.min_by(row, order).alias("_row")).select("_row.*")


def best(df: DataFrame, key: str = "source_id", score: str = "score", order: str = "cand_idx") -> DataFrame:
    """The row of highest score of each key; null scores come last, ties go to the earliest."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rank = F.struct(F.col(score).isNotNull(), F.col(score), -F.col(order))
    return df.groupBy(key).agg(F.max_by(row, rank).alias("_row")).select("_row.*")


def best_of_array(candidates: Column, score: str = "score") -> Column:
    """The same within an array column, in its order: no shuffle at all."""
    ranked = F.transform(candidates, lambda c, i: F.struct(c[score].isNotNull().alias("k"), c[score].alias("s"), (-i).alias("o"), c.alias("c")))
    return F.array_max(F.transform(ranked, lambda r: F.struct(r["k"], r["s"], r["o"])))["o"] * -1


def rerank_method(scored_by_model: bool, n_candidates: Column) -> Column:
    return F.when(n_candidates == 0, "none").otherwise("comet_qe" if scored_by_model else "logprob_fallback")


def quota(df: DataFrame, keys: list[str], n: int, order: list[Column]) -> DataFrame:
    """The first n rows of each key; Spark keeps n rows a key in each task before it shuffles."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def remaining(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Keys with what is left of their quota, most first."""
    return df.groupBy(*keys).agg(F.greatest(F.lit(0), F.lit(n) - F.count("*")).alias("remaining")).orderBy(F.desc("remaining"), *keys)


def unseen(df: DataFrame, history: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The first row of each key, by order, that history doesn't have."""
    return first_wins(df.join(history.select(key).distinct(), key, "left_anti"), F.col(key), F.col(order or key))


def fan_out(df: DataFrame, engines: list[str]) -> DataFrame:
    """Each row once an engine; the list is short and known."""
    return df.withColumn("engine", F.explode(F.array(*[F.lit(e) for e in engines])))


def mode_delta(df: DataFrame, full: str, single: str) -> DataFrame:
    """metric and full minus single, where both modes have it. df: mode, metric, value."""
    wide = df.groupBy("metric").pivot("mode", [full, single]).agg(F.first("value"))
    return wide.where(F.col(full).isNotNull() & F.col(single).isNotNull()).select("metric", (F.col(full) - F.col(single)).alias("delta"))


def latest_checkpoint(df: DataFrame, path: str = "path") -> DataFrame:
    """The path with the highest number at its end."""
    n = F.regexp_extract(path, r"checkpoint-(\d+)$", 1)
    return df.where(n != "").agg(F.max_by(path, n.cast("long")).alias("path"))
