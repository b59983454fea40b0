"""One text to its translation as a plan of columns, with models as backends.

All stages of a row stay in its row: candidates are an array column, so nothing
is shuffled, and the text that is worked on is made once, as the engines' Python
stage stands between it and what reads it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import backends as B
from ..functions import scores as S
from ..functions import tables as T
from ..functions import text as X
from ..operators import ranking as R
from ..sources.storage import bounded_batches

CANDIDATE = "struct<text: string, engine: string, method: string, score: double>"


@dataclass(frozen=True)
class Options:
    """Models of the plan. Where one is None its stage is left out, and the result says so.

    engine: (text, engine) to candidates (text, method, score), best first; one that fails gives none.
    quality: (source, candidates' texts) to a score each; None: the engines' own scores.
    editor: (system prompt, prompt) to the edited text; None or an empty answer leaves the text as it is.
    back: (text, engine, direction) to the text translated back; similarity: of the source and that.
    word: (word, engine, direction) to a word of a hashtag; None: words stay.
    segment: Column function from a hashtag to its words.
    size: inputs of a batch. batched: engine, quality, editor, back and similarity take lists of what they take else and return lists:
    engine(texts, engine), quality([(source, candidate's text)]), editor([(system, prompt)]), back(texts, engine, direction), similarity([(source, text)]).
    """

    engines: tuple[str, ...] = ("indictrans2", "nllb", "banglat5")
    roundtrip_engine: str = "nllb"
    threshold: float = 0.85
    engine: Callable[..., list[tuple[str, str, float | None]]] = B.identity_engine
    quality: Callable[[str, list[str]], list[float]] | None = None
    editor: Callable[[str, str], str | None] | None = None
    back: Callable[[str, str, str], str] = B.same_text
    similarity: Callable[[str, str], float] = B.word_overlap
    word: Callable[[str, str, str], str] | None = None
    segment: Callable[[Column], Column] = lambda tag: X.camel_split(X.without_hash(tag))
    size: int = 8
    batched: bool = False

    def ask(self, hook: Callable | None, *more) -> Callable[[list], list] | None:
        """A hook as one of lists, with further arguments."""
        if hook is None:
            return None
        if self.batched:
            return lambda inputs: hook(inputs, *more)
        return lambda inputs: [hook(*(x if isinstance(x, tuple) else (x,)), *more) for x in inputs]


def prepared(df: DataFrame, direction: str) -> DataFrame:
    """Adds normalized (slang), transliterated, and work: towards English, Latin-script Bengali in Bengali letters."""
    out = df.withColumn("normalized", X.normalize_slang(F.col("text")))
    if direction != "bn2en":
        return out.withColumns({"transliterated": F.lit(False), "work": F.col("normalized")})
    bound = X.bind(F.col("normalized"), lambda t: F.struct(t.alias("n"), X.is_romanised(t).alias("r"), F.when(X.is_romanised(t), X.latin_to_bn(t)).otherwise(t).alias("w")))
    return out.withColumn("_p", bound).select(*df.columns, F.col("_p.n").alias("normalized"), F.col("_p.r").alias("transliterated"), F.col("_p.w").alias("work"))


def with_candidates(df: DataFrame, options: Options) -> DataFrame:
    """Adds candidates, in the engines' order, each text once an engine, empty ones left out; and failures, the engines that failed."""
    rows = df.withColumn("_clean", X.sanitize(F.col("work")))

    def frames(parts: B.Batches) -> B.Batches:
        engines = {e: B.Asked(options.ask(options.engine, e), options.size) for e in options.engines}
        for b in parts:
            source, clean = list(b["work"]), [x or None for x in b["_clean"]]
            found, failed = [[] for _ in clean], [[] for _ in clean]
            for engine, ask in engines.items():
                for own, bad, text, (answer, error) in zip(found, failed, clean, ask(clean), strict=True):
                    if error:
                        bad.append(f"{engine}: {error}")
                    elif text is not None:
                        seen = set()
                        for candidate, method, score in answer:
                            if candidate and candidate not in seen:
                                seen.add(candidate)
                                own.append((candidate, engine, method, score))
            if options.quality:
                found = scored(source, found)
            yield b.drop(columns="_clean").assign(candidates=[[dict(zip(("text", "engine", "method", "score"), c, strict=True)) for c in x] for x in found], failures=failed)

    def scored(source: list[str], found: list[list[tuple]]) -> list[list[tuple]]:
        if not options.batched:
            return [[(*c[:3], float(s)) for c, s in zip(x, options.quality(t, [c[0] for c in x]), strict=True)] if x else x for t, x in zip(source, found, strict=True)]
        pairs = [(t, c[0]) for t, x in zip(source, found, strict=True) for c in x]
        answers = iter(B.Asked(options.quality, options.size)(pairs))
        out = []
        for x in found:
            own = [next(answers) for _ in x]
            # a text that can't be scored is ranked last
            out.append([(*c[:3], None if error else float(s)) for c, (s, error) in zip(x, own, strict=True)])
        return out

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    bounded_batches(df.sparkSession)
    return rows.mapInPandas(frames, f"{schema}, candidates array<{CANDIDATE}>, failures array<string>")


def picked(df: DataFrame, options: Options) -> DataFrame:
    """Adds n and qe_method, and pre, winning_engine, winning_method and qe_score of the best candidate; drops the candidates."""
    best = X.bind(F.col("candidates"), lambda c: F.get(c, R.best_of_array(c)))
    method = R.rerank_method(options.quality is not None, F.size("candidates"))
    out = df.withColumns({"n": F.size("candidates"), "_won": best, "qe_method": method}).drop("candidates")
    return out.withColumns({"pre": F.col("_won.text"), "winning_engine": F.col("_won.engine"), "winning_method": F.col("_won.method"), "qe_score": F.col("_won.score")}).drop("_won")


def edited(df: DataFrame, direction: str, options: Options) -> DataFrame:
    """Adds pre, post, edit_applied and protected_spans."""
    rows = df.withColumn("protected_spans", X.protected_spans(F.col("work")))
    if not options.editor:
        return rows.withColumns({"post": F.col("pre"), "edit_applied": F.lit(False)})
    language = F.lit(T.LANGUAGE_NAMES[direction])
    asked = rows.withColumns({"_system": X.postedit_system(language), "_prompt": X.postedit_prompt(F.col("work"), F.col("pre"), F.col("protected_spans"), language)})

    def frames(parts: B.Batches) -> B.Batches:
        ask = B.Asked(options.ask(options.editor), options.size)
        for b in parts:
            asked = [None if prompt is None else (system, prompt) for system, prompt in zip(b["_system"], b["_prompt"], strict=True)]
            # an edit that fails leaves the text as it is
            answers = [None if error or x is None else x.strip() for x, error in ask(asked)]
            yield b.drop(columns=["_system", "_prompt"]).assign(_edited=answers)

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    bounded_batches(df.sparkSession)
    done = asked.mapInPandas(frames, f"{schema}, _edited string")
    q = S.postedit(F.col("pre"), F.col("_edited"), F.col("protected_spans"))
    return done.withColumns({"post": q["post_edit"], "edit_applied": q["edit_applied"]}).drop("_edited")


def verified(df: DataFrame, direction: str, options: Options) -> DataFrame:
    """Adds the round trip's text and similarity and whether it passed, of post, and of pre where post failed and differs from it."""
    back_direction = T.REVERSE[direction]

    def frames(parts: B.Batches) -> B.Batches:
        back, alike = B.Asked(options.ask(options.back, options.roundtrip_engine, back_direction), options.size), B.Asked(options.ask(options.similarity), options.size)

        def checked(sources: list[str], texts: list[str | None]) -> list[tuple[str | None, float | None, bool]]:
            """A text that can't be translated back or compared isn't verified."""
            backs = [x for x, _ in back(texts)]
            found = alike([None if x is None else (s, x) for s, x in zip(sources, backs, strict=True)])
            return [(x, None if y is None else float(y), y is not None and float(y) >= options.threshold) for x, (y, _) in zip(backs, found, strict=True)]

        for b in parts:
            source, pre, post = (list(b[c]) for c in ("work", "pre", "post"))
            after = checked(source, post)
            before = checked(source, [None if a[2] or x == y else x for a, x, y in zip(after, pre, post, strict=True)])
            both = [(*x, *y) for x, y in zip(after, before, strict=True)]
            yield b.assign(**dict(zip(NAMES, map(list, zip(*both, strict=True)) if both else [[]] * 6, strict=True)))

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    bounded_batches(df.sparkSession)
    return df.mapInPandas(frames, f"{schema}, " + ", ".join(f"{n} {t}" for n, t in zip(NAMES, ("string", "double", "boolean") * 2, strict=True)))


NAMES = ("post_back", "post_similarity", "post_ok", "pre_back", "pre_similarity", "pre_ok")


def reassembled(df: DataFrame, direction: str, options: Options) -> DataFrame:
    """Adds final: the original's protected tokens put back in translation, hashtags rebuilt from their words; null stays null."""
    target = T.TARGET[direction]
    rows = df.withColumn("_tokens", X.protected(F.col("text")))
    if options.word:
        own = X.bind(F.array_distinct(X.of_kind(F.col("_tokens"), "hashtag")), lambda tags: F.transform(tags, lambda t: F.struct(t.alias("tag"), options.segment(t).alias("words"))))
        romanised = lambda w: F.when(X.is_romanised(w), X.latin_to_bn(w)).otherwise(w) if direction == "bn2en" else w
        asked = rows.withColumn("_tags", own).withColumn("_asked", F.transform("_tags", lambda x: F.transform(x["words"], lambda w: romanised(F.lower(w)))))
        ask = options.word

        def frames(parts: B.Batches) -> B.Batches:
            one = B.kept_once(lambda w: ask(w, options.roundtrip_engine, direction))
            for b in parts:
                # a word that has no translation stays as it was written
                new = [[{"tag": t["tag"], "words": [x if (x := one(q)) != q else w for w, q in zip(t["words"], qs, strict=True)]} for t, qs in zip(tags, every, strict=True)] for tags, every in zip(b["_tags"], b["_asked"], strict=True)]
                yield b.drop(columns="_asked").assign(_tags=new)

        kinds = ", ".join(f"`{c}` {t}" for c, t in asked.drop("_asked").dtypes)
        bounded_batches(df.sparkSession)
        rows = asked.mapInPandas(frames, kinds)
        rebuilt = F.map_from_entries(F.transform("_tags", lambda x: F.struct(x["tag"], X.rebuild_hashtag(x["tag"], x["words"], F.lit(target)))))
    else:
        tags = F.array_distinct(X.of_kind(F.col("_tokens"), "hashtag"))
        rebuilt = F.map_from_entries(F.transform(tags, lambda t: F.struct(t, X.rebuild_hashtag(t, options.segment(t), F.lit(target)))))
    # a map that is named in a fold is made once
    final = X.bind(rebuilt, lambda m: X.reassemble(F.col("_tokens"), F.col("translation"), m))
    return rows.withColumn("final", F.when(F.col("translation").isNotNull(), final)).drop("_tokens", "_tags")


def translate(df: DataFrame, direction: str, options: Options | None = None, fast_mode: bool = False) -> DataFrame:
    """All that is known of the translation of rows id and text; null texts count as empty.

    The fast mode takes one candidate of the round trip's engine, and neither
    ranks, edits nor verifies it.
    """
    options = options or Options()
    if fast_mode:
        engine = options.engine
        first = (lambda texts, name: [x[:1] for x in engine(texts, name)]) if options.batched else (lambda text, name: engine(text, name)[:1])
        options = replace(options, engines=(options.roundtrip_engine,), engine=first, quality=None)
    rows = prepared(df.select("id", F.coalesce("text", F.lit("")).alias("text")), direction)
    rows = picked(with_candidates(rows, options), options)
    null = lambda kind: F.lit(None).cast(kind)
    if fast_mode:
        done = rows.withColumns({
            "post": F.col("pre"), "translation": F.col("pre"), "edit_applied": F.lit(False), "protected_spans": F.array().cast("array<string>"), "low_confidence": F.lit(False), "note": F.lit("fast mode: not ranked, edited or verified"),
            "error": null("string"), "qe_score": null("double"), "qe_method": F.lit("skipped_fast_mode"), "winning_engine": F.lit(options.roundtrip_engine), "winning_method": F.lit("beam_fast_mode"), "roundtrip_similarity": null("double"), "roundtrip_text": null("string"),
        })
    else:
        checked = verified(edited(rows, direction, options), direction, options)
        q = S.quality(F.col("n"), F.col("pre"), F.col("post"), F.col("pre"), F.col("edit_applied"), F.col("post_ok"), F.col("pre_ok"))
        back = ~F.col("post_ok") & F.col("edit_applied") & (F.col("post") != F.col("pre")) & F.col("pre_ok")
        done = checked.withColumns({
            **q,
            "roundtrip_similarity": F.when(back, F.col("pre_similarity")).otherwise(F.col("post_similarity")), "roundtrip_text": F.when(back, F.col("pre_back")).otherwise(F.col("post_back")),
        })
    return reassembled(done, direction, options).select(
        "id", "text", F.lit(direction).alias("direction"), "normalized", "transliterated", F.col("work").alias("processed"), "translation", "final", "winning_engine", "winning_method", "qe_score", "qe_method", "roundtrip_similarity", "roundtrip_text",
        "low_confidence", "note", F.col("pre").alias("pre_edit"), F.col("post").alias("post_edit"), "edit_applied", "protected_spans", "failures", "error",
    )


def panel(df: DataFrame, fast_mode: bool = False) -> DataFrame:
    """Adds panel: the result's lines as Markdown, each a label and a value; a line without a value is left out."""
    # The labels of the lines.
    direction = F.when(F.col("direction") == "bn2en", "Bengali → English").when(F.col("direction") == "en2bn", "English → Bengali").otherwise("—")
    number = lambda c, none: F.coalesce(F.format_number(c, 3), F.lit(none))
    skipped = F.lit("skipped (fast mode)")
    lines = [
        ("**Direction:** ", direction),
        ("**⚠️ Low confidence** — ", F.when(F.col("low_confidence"), "this translation failed one or more internal quality checks.")),
        ("**Engine used:** ", F.when(F.col("winning_engine").isNotNull(), F.concat("winning_engine", F.lit(" ("), F.coalesce("winning_method", F.lit("n/a")), F.lit(")")))),
        ("**QE score:** ", skipped if fast_mode else F.concat(number("qe_score", "n/a"), F.lit(" ("), F.col("qe_method"), F.lit(")"))),
        ("**Round-trip similarity:** ", skipped if fast_mode else number("roundtrip_similarity", "n/a")),
        ("**LLM post-edit:** ", F.when(F.col("edit_applied"), "applied")),
        ("**Note:** ", F.col("note")),
        ("**Error:** ", F.col("error")),
    ]
    return df.withColumn("panel", F.concat_ws("\n\n", *[F.concat(F.lit(label), value) for label, value in lines]))
