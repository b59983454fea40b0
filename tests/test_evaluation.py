import pytest
from pyspark.sql import functions as F

from banyan import backends
from banyan.operators import evaluation as E
from banyan.plans import translate as T


def test_modes_and_report(spark):
    pairs = spark.createDataFrame([("a b @x", "the cat sat on the mat"), ("c", "a dog ran far away")], "source string, reference string")
    both = E.run_modes(pairs, {"full": lambda d: d.withColumn("hypothesis", F.col("reference")), "single": lambda d: d.withColumn("hypothesis", F.concat("reference", F.lit(" @x")))})
    got = {(r["mode"], r.metric): r.value for r in E.report(both).collect()}
    assert got["full", "bleu"] == pytest.approx(100) and got["full", "ter"] == 0 and got["full", "pfs"] == 0.0
    assert got["single", "pfs"] == 1.0 and got["single", "bleu"] < 100


def test_mean_score_tells_errors(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 0.0, None), ("b", 1.0, "no model"), ("b", 1.0, None)], "mode string, score double, error string")
    assert {r["mode"]: (r.value, r.error) for r in E.mean_score(df).collect()} == {"a": (0.5, None), "b": (None, "no model")}


def test_words_are_asked_once(spark):
    def backend(batches):
        for b in batches:
            assert b.low.is_unique
            yield b.assign(translated=[x.upper() if x != "bad" else None for x in b.low])

    df = spark.createDataFrame([(1, ["Love", "bad"]), (2, ["love"])], "id long, w array<string>")
    got = {r.id: r.words for r in E.translate_words(df, F.col("w"), "id", backend, romanised_first=False).collect()}
    assert got == {1: ["LOVE", "bad"], 2: ["LOVE"]}


def test_registry(spark):
    got = {(r.engine, r.direction): r for r in E.registry(spark, "p").collect()}
    assert len(got) == 6 and got["nllb", "bn2en"].base_model == got["nllb", "en2bn"].base_model and got["indictrans2", "bn2en"].base_model != got["indictrans2", "en2bn"].base_model
    assert got["nllb", "bn2en"].adapter_id == "p-nllb-bn2en" and "q_proj" in got["nllb", "bn2en"].target_modules and "q" in got["banglat5", "en2bn"].target_modules


def test_guarded_backend_isolates_failures(spark):
    df = spark.createDataFrame([(1, "1"), (2, "x")], "id long, t string")
    out = backends.run(df, backends.guarded(lambda r: int(r["t"]), "n", -1), "id long, t string, n long, error string").collect()
    assert {r.id: (r.n, r.error is None) for r in out} == {1: (1, True), 2: (-1, False)}


def test_translate_plan(spark):
    df = spark.createDataFrame([(1, "u r gr8 #TopicTag @x 😍"), (2, " "), (3, None)], "id long, text string")
    got = {r.id: r for r in T.translate(df, "en2bn").collect()}
    for k in (2, 3):
        assert got[k].translation is None and got[k].low_confidence and got[k].final is None and got[k].qe_method == "none" and got[k].error == "no candidates"
    assert got[1].translation == "you are great #TopicTag @x 😍" and got[1].winning_engine == "nllb" and not got[1].low_confidence and got[1].final.endswith("#TopicTag")
    assert got[1].qe_method == "logprob_fallback" and got[1].protected_spans == ["#TopicTag", "@x", "😍"] and not got[1].edit_applied
    fast = {r.id: r for r in T.translate(df, "en2bn", fast_mode=True).collect()}
    assert fast[1].qe_method == "skipped_fast_mode" and fast[1].winning_engine == "nllb" and fast[1].roundtrip_similarity is None and fast[2].final is None
    panel = T.panel(T.translate(df, "en2bn", fast_mode=True), True).where("id = 1").first().panel
    assert "**QE score:** skipped" in panel and "**Round-trip similarity:** skipped" in panel and "**Note:**" in panel and "**Error:**" not in panel
    full = {r.id: r.panel for r in T.panel(T.translate(df, "en2bn")).collect()}
    assert "**Round-trip similarity:** 1.000" in full[1] and "**QE score:** -4.000 (logprob_fallback)" in full[1]
    assert "**Error:** no candidates" in full[2] and "Low confidence" in full[2] and "**QE score:** n/a (none)" in full[2]


def test_all_branches_of_the_fallback_chain(spark):
    def engines(text, engine):
        if engine == "nllb":
            raise RuntimeError("no memory")
        return [(f"{text} {engine}", "beam", -1.0), (text, "sample", None), ("", "beam", 0.0)]

    def quality(source, texts):
        return [1.0 if t == source else 0.5 for t in texts]

    def editor(system, prompt):
        """By the words of the source: keeps, improves, loses a token, says nothing, fails."""
        assert "Bengali" in system and "Original source text:" in prompt
        source = prompt.split("\n")[1]
        if "fail" in source:
            raise RuntimeError("down")
        return "" if "empty" in source else source.replace("@me", "me") if "lose" in source else f" {source} edited " if "edit" in source else source

    def similarity(source, back):
        """Low for what was edited, or for both."""
        return 0.1 if "both" in source or ("bad" in source and back.endswith("edited")) else 0.9

    texts = {1: "good", 2: "edit this", 3: "edit this bad", 4: "edit both", 5: "both", 6: " ", 7: "lose @me", 8: "empty", 9: "fail"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    o = T.Options(engine=engines, quality=quality, editor=editor, similarity=similarity)
    got = {r.id: r for r in T.translate(df, "en2bn", o).collect()}
    # the quality model's scores choose the sample that equals the source; the engine that fails is told, the others go on
    assert all(got[k].qe_method == "comet_qe" and got[k].qe_score == 1.0 and got[k].winning_method == "sample" and got[k].winning_engine == "indictrans2" for k in texts if k != 6)
    assert got[1].failures == ["nllb: RuntimeError: no memory"]
    chain = {k: (r.translation, r.low_confidence, r.note, r.edit_applied) for k, r in got.items()}
    assert chain[1] == ("good", False, None, True)
    assert chain[2] == ("edit this edited", False, None, True)
    assert chain[3] == ("edit this bad", False, "fell back to the text before the edit", True)
    assert chain[4] == ("edit both edited", True, "neither text verified", True)
    assert chain[5] == ("both", True, "not verified", True)
    assert chain[6][:3] == (None, True, None) and got[6].error == "no candidates" and got[6].qe_method == "none"
    assert chain[7] == ("lose @me", False, None, False) and chain[8] == ("empty", False, None, False) and chain[9] == ("fail", False, None, False)
    assert got[3].roundtrip_text == "edit this bad" and got[3].roundtrip_similarity == 0.9 and got[4].roundtrip_similarity == 0.1
    assert got[3].pre_edit == "edit this bad" and got[3].post_edit == "edit this bad edited"
    none = T.Options(engine=lambda text, engine: 1 / 0)
    assert {r.error for r in T.translate(df, "en2bn", none).collect()} == {"no candidates"}


def test_hashtag_words_are_translated(spark):
    asked = {"ভালোবাসা": "love", "good": "bhalo", "ভাল": "fine"}

    def word(w, engine, direction):
        assert engine == "nllb" and direction == "bn2en"
        return asked[w]

    df = spark.createDataFrame([(1, "eto shundor #ভালোবাসা dekhlam #GoodDay")], "id long, text string")
    r = T.translate(df, "bn2en", T.Options(word=word)).first()
    # towards English a Latin word is asked in Bengali letters; one without an answer stays as it was
    assert r.final.endswith("#Love #GoodDay") and r.final.count("#") == 2
