"""Evaluation from a file of pairs to a JSON of results."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import backends as B
from ..operators import corpus as C
from ..operators import evaluation as E
from ..sources import sinks
from ..sources.storage import stored
from .translate import Options, translate

PAIRS = "source string, reference string"


def by_plan(direction: str, options: Options, fast_mode: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A mode: the translate plan's final texts, empty where there is none."""

    def mode(pairs: DataFrame) -> DataFrame:
        # the reference goes along as the row's id, so nothing is joined
        made = translate(pairs.select(F.struct("reference").alias("id"), F.col("source").alias("text")), direction, options, fast_mode)
        return made.select(F.col("text").alias("source"), F.col("id.reference").alias("reference"), F.coalesce("final", F.lit("")).alias("hypothesis"))

    return mode


def modes(direction: str, options: Options | None = None, baseline: Options | None = None) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """full: the whole plan; single: one engine's beam; baseline: the first beam of another model, such as one that wasn't fine-tuned, or the source as it is where there is none."""
    options = options or Options()
    return {
        "full": by_plan(direction, options),
        "single": by_plan(direction, options, fast_mode=True),
        "baseline": by_plan(direction, baseline, fast_mode=True) if baseline else lambda pairs: pairs.withColumn("hypothesis", F.col("source")),
    }


def scored(hypotheses: DataFrame, model: Callable[[list[tuple[str, str, str]]], list[float]] | None) -> DataFrame:
    """mode, metric, value and error of a learned metric over (source, hypothesis, reference); without a model the error says so."""

    def step(b: pd.DataFrame) -> pd.DataFrame:
        if model is None:
            return b.assign(score=0.0, error="no model")
        try:
            return b.assign(score=[float(x) for x in model(list(zip(b["source"], b["hypothesis"], b["reference"], strict=True)))], error=None)
        except Exception as e:  # noqa: BLE001
            return b.assign(score=0.0, error=f"{type(e).__name__}: {e}")

    keep = lambda b: step(b)[["mode", "score", "error"]]
    rows = hypotheses.select("mode", "source", "hypothesis", "reference").mapInPandas(B.batches(keep), "mode string, score double, error string")
    return E.mean_score(rows).withColumn("metric", F.lit("comet")).select("mode", "metric", "value", "error")


def evaluate(pairs: DataFrame, every: dict[str, Callable[[DataFrame], DataFrame]], model=None) -> DataFrame:
    """mode, metric, value and error: BLEU, chrF++, TER, fidelity and the learned metric of each mode. Each mode runs once; all metrics are of the same texts."""
    hypotheses = stored(E.run_modes(pairs, every), "banyan-hypotheses")
    return E.report(hypotheses).withColumn("error", F.lit(None).cast("string")).unionByName(scored(hypotheses, model))


def run(spark: SparkSession, path: str, direction: str, out: str, options: Options | None = None, max_rows: int | None = None, names: tuple[str, ...] = ("full", "single"), model=None, baseline: Options | None = None) -> DataFrame:
    """Unified rows of the JSON lines at path to results at out; returns what was written."""
    rows = spark.read.schema("id string, pair_type string, text string, parallel_text string, is_synthetic boolean").json(path)
    pairs = C.translation_pairs(rows, direction, max_rows, "id", "reference", exclude_synthetic=True).select("source", "reference")
    every = modes(direction, options, baseline)
    report = stored(evaluate(stored(pairs, "banyan-pairs"), {n: every[n] for n in names}, model), "banyan-report")
    sinks.results_json(report, out)
    return report
