"""Images to translations: recognition with fallback, cleaning, language gate, log, translation of what is supported."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import backends as B
from ..functions import scores as S
from ..functions import text as X
from ..operators import ocr as O
from ..sources import sinks
from ..sources.storage import stored
from .translate import Options, translate

LINE = "struct<text: string, confidence: double, bbox: array<double>>"


@dataclass(frozen=True)
class ImageOptions:
    """readers: by engine's name, content to lines (text, raw confidence, box); the next one reads what one fails at.

    language: text to a predicted language and its confidence. fixer: the text of an uncertain line to a better one, or None.
    """

    readers: dict[str, Callable[[bytes], list[tuple[str, object, list[float]]]]]
    language: Callable[[str], tuple[str | None, float]] = B.script_language
    fixer: Callable[[str], str | None] | None = None
    threshold: float = 0.6
    translation: Options = field(default_factory=Options)


def recognised(images: DataFrame, options: ImageOptions) -> DataFrame:
    """path, content, engine, lines and failure of images: the first engine that fails at none of its steps has read a row."""

    def read(content: bytes) -> tuple[str | None, list[dict], str | None]:
        why = None
        for name, reader in options.readers.items():
            try:
                return name, [{"text": t.strip(), "confidence": confidence(c), "bbox": [float(x) for x in box]} for t, c, box in reader(content) if t.strip()], None
            except Exception as e:  # noqa: BLE001
                why = f"{name}: {type(e).__name__}: {e}"
        return None, [], why

    def step(b: pd.DataFrame) -> pd.DataFrame:
        found = [read(bytes(x)) for x in b["content"]]
        return b.assign(engine=[x for x, *_ in found], lines=[x for _, x, _ in found], failure=[x for *_, x in found])

    return images.select("path", "content").mapInPandas(B.batches(step), f"path string, content binary, engine string, lines array<{LINE}>, failure string")


def confidence(raw: object) -> float:
    """A share as it is, a percentage as a share; 0.0 for what is negative or no number."""
    try:
        x = float(raw)
    except (TypeError, ValueError):
        return 0.0
    return 0.0 if not x >= 0 else x / 100 if x > 1 else x


def cleaned(rows: DataFrame, options: ImageOptions) -> DataFrame:
    """Adds ocr_text, ocr_confidence, fixed (uncertain lines that the fixer changed) and cleaned_text."""
    out = rows.withColumns({"ocr_text": O.joined_text(F.col("lines"), F.col("engine")), "ocr_confidence": O.mean_confidence(F.col("lines"))})
    fixed = None
    if options.fixer:
        ask = B.kept_once(options.fixer)

        @F.pandas_udf("array<string>")
        def fixes(lines: pd.Series) -> pd.Series:
            return lines.map(lambda texts: [None if t is None else ask(t) for t in texts])

        unsure = F.transform("lines", lambda x: F.when(x["confidence"] < options.threshold, x["text"]))
        out = out.withColumn("_fixes", fixes(unsure))
        fixed = F.col("_fixes")
    lines = O.clean_lines(F.col("lines"), fixed, options.threshold)
    out = out.withColumn("_clean", lines).drop("_fixes")
    text = O.clean_text(O.joined_text(F.col("_clean"), F.col("engine")))
    return out.withColumns({"fixed": O.fixed_count(F.col("_clean")), "cleaned_text": text}).drop("_clean")


def gated(rows: DataFrame, options: ImageOptions) -> DataFrame:
    """Adds the gate's columns; the model is asked on one line without outer white space."""
    ask = options.language

    def step(b: pd.DataFrame) -> pd.DataFrame:
        found = [ask(" ".join(t.split())) if t and t.strip() else (None, 0.0) for t in b["cleaned_text"]]
        return b.assign(_predicted=[x for x, _ in found], _confidence=[float(x) for _, x in found])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    asked = rows.mapInPandas(B.batches(step), f"{schema}, _predicted string, _confidence double")
    return asked.withColumns(S.gate(F.col("cleaned_text"), F.col("_predicted"), F.col("_confidence"))).drop("_predicted", "_confidence")


def translate_images(images: DataFrame, options: ImageOptions, log: str | None = None, fast_mode: bool = False, batch: int | None = None) -> DataFrame:
    """Rows path and content to the recognised and cleaned text, the language, and the translation of supported ones; unsupported ones are told before any engine is asked.

    Images are recognised once, as their gated rows are stored without the
    content.  batch: the number under which the log takes the rows, once.
    """
    read = cleaned(recognised(images, options), options).withColumn("image_hash", X.image_hash(F.col("content"))).drop("content")
    rows = stored(gated(read, options).withColumn("direction", S.direction_of(F.col("language"))), "banyan-images")
    if log:
        sinks.append_log(sinks.decision_log(rows.withColumn("detected_language", F.col("language")), "path"), log, batch)
    shown = ["path", "engine", "ocr_text", "ocr_confidence", "cleaned_text", F.col("language").alias("detected_language"), F.col("confidence").alias("language_confidence"), "direction", "failure"]
    rejected = rows.where(F.col("direction").isNull()).select(*shown, F.lit(False).alias("supported"), F.lit("language not supported: the text was not translated").alias("message"))
    parts = []
    for direction in ("bn2en", "en2bn"):
        # the row goes along as its id, so nothing is joined
        own = rows.where(F.col("direction") == direction).select(F.struct(*shown).alias("id"), F.col("cleaned_text").alias("text"))
        done = translate(own, direction, options.translation, fast_mode)
        result = F.struct(*[c for c in done.columns if c not in ("id", "text", "direction")]).alias("translation_result")
        parts.append(done.select("id.*", F.lit(True).alias("supported"), F.lit(None).cast("string").alias("message"), F.col("final").alias("translation"), result))
    return parts[0].unionByName(parts[1]).unionByName(rejected, allowMissingColumns=True)
