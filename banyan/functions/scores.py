"""Row scores: platform fidelity, cosine, language gate, post-edit and quality decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X


def mean_of(*scores: Column) -> Column:
    """Mean of those that aren't null; null if all are."""
    known = F.filter(F.array(*scores), lambda x: x.isNotNull())
    return X.bind(known, lambda k: F.when(F.size(k) > 0, F.aggregate(k, F.lit(0.0), lambda a, x: a + x) / F.size(k)))


def fidelity(source: Column, output: Column) -> dict[str, Column]:
    """Of two arrays of protected tokens: emoji, verbatim (mentions and URLs), hashtag, and overall; null where the source has none."""

    def kept(*kinds: str) -> Column:
        want, got = (F.array_distinct(X.of_kind(t, *kinds)) for t in (source, output))
        return F.when(F.size(want) > 0, F.size(F.array_intersect(want, got)) / F.size(want))

    n_in, n_out = (F.size(X.of_kind(t, "hashtag")) for t in (source, output))
    tags = F.when(n_in > 0, F.least(F.lit(1.0), n_out / n_in))
    parts = {"emoji_preservation": kept("emoji"), "verbatim_preservation": kept("mention", "url"), "hashtag_count_preservation": tags}
    return parts | {"overall": mean_of(*parts.values())}


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def gate(text: Column, predicted: Column, confidence: Column, threshold: float = 0.5, accept_ratio: float = 0.5, ratio: Column | None = None) -> dict[str, Column]:
    """Language of a text from its script, else from a model's prediction: bn, en or unsupported, with the reason.

    ratio: a column that has the text's Bengali share already, so that it is computed once.
    """
    empty = ~text.rlike(r"(?U)\S")
    ratio = X.bengali_ratio(text) if ratio is None else ratio
    script = ratio >= accept_ratio
    model = predicted.isin("bn", "en") & (confidence >= threshold)
    own = F.when(predicted == "bn", confidence).otherwise(0.0)
    return {
        "language": F.when(empty, "unsupported").when(script, "bn").when(model, predicted).otherwise("unsupported"),
        "confidence": F.when(empty, 0.0).when(script, F.greatest(ratio, own)).otherwise(confidence),
        "fasttext_language": F.when(~empty, predicted),
        "fasttext_confidence": F.when(empty, 0.0).otherwise(confidence),
        "bengali_unicode_ratio": F.when(empty, 0.0).otherwise(ratio),
        "reason": F.when(empty, "empty input").when(script, "bengali_unicode_ratio").when(model, "fasttext").otherwise("unsupported_language_or_low_confidence"),
    }


def direction_of(language: Column) -> Column:
    """Null for what is not to be translated."""
    return F.when(language == "bn", "bn2en").when(language == "en", "en2bn")


def postedit(candidate: Column, edited: Column, protected: Column) -> dict[str, Column]:
    """edited: the model's text, null if there was no model. Lost tokens are told before an empty edit."""
    lost = X.missing_tokens(edited, protected)
    preserved = edited.isNull() | (F.size(lost) == 0)
    applied = edited.isNotNull() & preserved & (edited != "")
    return {
        "post_edit": F.when(applied, edited).otherwise(candidate),
        "edit_applied": applied,
        "protected_tokens_preserved": preserved,
        "fallback": F.when(edited.isNull(), "unavailable").when(~preserved, "tokens_lost").when(edited == "", "empty"),
        "missing": F.when(edited.isNotNull(), lost).otherwise(F.array().cast("array<string>")),
    }


def quality(n_candidates: Column, winner: Column, post: Column, pre: Column, applied: Column, post_ok: Column, pre_ok: Column) -> dict[str, Column]:
    """The fallback chain: the edit if it verifies, else the text before it if that does, else the edit with low confidence."""
    none = (n_candidates == 0) | winner.isNull()
    changed = applied & (post != pre)
    back = ~post_ok & changed & pre_ok
    return {
        "translation": F.when(none, F.lit(None).cast("string")).when(back, pre).otherwise(post),
        "low_confidence": none | (~post_ok & ~back),
        "note": F.when(none | post_ok, F.lit(None).cast("string")).when(back, "fell back to the text before the edit").when(changed, "neither text verified").otherwise("not verified"),
        "error": F.when(n_candidates == 0, "no candidates").when(winner.isNull(), "no winner"),
    }
