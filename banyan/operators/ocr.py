"""OCR results: cleaning of texts and of lines, with an optional fixer for uncertain ones."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as X
from ..sources.storage import bounded_batches


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition, which Spark has no function for."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def clean_text(text: Column) -> Column:
    bounded_batches(SparkSession.active())
    return X.ocr_rules(nfc(text))


def clean_lines(lines: Column, fixed: Column | None = None, threshold: float = 0.6) -> Column:
    """Lines of (text, confidence), texts already composed, with the rules applied; of uncertain ones that aren't empty, the fixed text by place, where there is one."""

    def one(line: Column, i: Column) -> Column:
        base = X.ocr_rules(line["text"])
        fix = F.lit(None).cast("string") if fixed is None else F.get(fixed, i)
        use = (line["confidence"] < threshold) & (base != "") & fix.isNotNull()
        return F.struct(F.when(use, fix).otherwise(base).alias("text"), line["confidence"].alias("confidence"), use.alias("fixed"))

    return F.transform(lines, one)


def fixed_count(cleaned: Column) -> Column:
    return F.size(F.filter(cleaned, lambda x: x["fixed"]))


def mean_confidence(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.aggregate(lines, F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size(lines)).otherwise(0.0)


def joined_text(lines: Column, engine: Column) -> Column:
    """One line a line, but for engines whose lines are words."""
    texts = F.transform(lines, lambda x: x["text"])
    return F.when(engine == "paddleocr", F.array_join(texts, "\n")).otherwise(F.array_join(texts, " "))
