"""Modes of translation side by side, word translation for hashtags, model registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..backends import Backend, run
from ..functions import text as X
from . import metrics as M
from .corpus import union_all

# Public models of each engine and direction, and the modules of their adapters.
MODELS = (
    ("indictrans2", "bn2en", "ai4bharat/indictrans2-indic-en-1B"), ("indictrans2", "en2bn", "ai4bharat/indictrans2-en-indic-1B"), ("nllb", "bn2en", "facebook/nllb-200-distilled-600M"),
    ("nllb", "en2bn", "facebook/nllb-200-distilled-600M"), ("banglat5", "bn2en", "csebuetnlp/banglat5"), ("banglat5", "en2bn", "csebuetnlp/banglat5"),
)
MODULES = {"banglat5": ("q", "k", "v", "o"), "others": ("q_proj", "k_proj", "v_proj", "out_proj", "fc1", "fc2")}


def registry(spark: SparkSession, prefix: str = "adapter") -> DataFrame:
    """A row for each engine and direction: base_model, adapter_id and target_modules; a small table to join by broadcast."""
    rows = spark.createDataFrame([(*m, list(MODULES.get(m[0], MODULES["others"]))) for m in MODELS], "engine string, direction string, base_model string, target_modules array<string>")
    return rows.withColumn("adapter_id", F.concat_ws("-", F.lit(prefix), "engine", "direction"))


def run_modes(pairs: DataFrame, modes: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """mode, source, reference and hypothesis. A mode takes pairs and adds hypothesis."""
    return union_all(*[f(pairs).withColumn("mode", F.lit(name)).select("mode", "source", "reference", "hypothesis") for name, f in modes.items()])


def mean_score(scored: DataFrame, score: str = "score", error: str = "error") -> DataFrame:
    """Mean score by mode, and an error where rows have one: then the mean is null."""
    failed = F.max(error)
    return scored.groupBy("mode").agg(F.when(failed.isNull(), F.avg(score)).alias("value"), failed.alias("error"))


METRICS = ("bleu", "chrf", "ter", "pfs")


def report(hypotheses: DataFrame, edits: bool = True) -> DataFrame:
    """mode, metric and value: bleu, chrf, ter (with edits) and mean fidelity (pfs), each from counts pooled over a mode, in one pass."""
    wide = M.report(hypotheses, "source", "hypothesis", "reference", "mode", edits=edits)
    return wide.select("mode", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in METRICS if edits or c != "ter"])))


def translate_words(df: DataFrame, words: Column, key: str, backend: Backend, romanised_first: bool = True) -> DataFrame:
    """key and the words in order, translated. Each distinct word is asked once, in lower case; one that fails stays as it is.

    backend adds translated to frames with asked.
    """
    each = df.select(key, F.posexplode(words).alias("i", "word"))
    low = F.lower("word")
    asked = F.when(X.is_romanised(low), X.latin_to_bn(low)).otherwise(low) if romanised_first else low
    distinct = each.select(low.alias("low"), asked.alias("asked")).distinct()
    answers = run(distinct, backend, "low string, asked string, translated string")
    joined = each.withColumn("low", low).join(answers, "low", "left")
    new = F.coalesce(F.when(F.col("translated") != "", F.col("translated")), F.col("word"))
    return joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", new.alias("w")))).alias("x")).select(key, F.transform("x", lambda s: s["w"]).alias("words"))
