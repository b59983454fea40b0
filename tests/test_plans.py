"""Plans end to end over small inputs: images, evaluation, commands, sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from banyan import __main__ as commands
from banyan import backends as B
from banyan.functions import text as X
from banyan.operators import corpus as C
from banyan.operators import ranking as R
from banyan.operators import segmentation as G
from banyan.plans import corpus_build, evaluate, images, translate
from banyan.sources import readers, sinks, storage
from banyan.streaming import ingest


def lines(path):
    return [json.loads(x) for f in sorted(path.glob("*.json")) for x in f.read_text().splitlines()]


def test_images_to_translations(spark, tmp_path):
    pages = {"a": "আমি ভালো আছি | সে ভালো", "b": "good day @me", "c": "12345 !!!", "d": "broken"}
    for name, text in pages.items():
        (tmp_path / f"{name}.img").write_bytes(text.encode())

    def paddle(content):
        text = content.decode()
        if text.startswith(("good", "broken")):
            raise RuntimeError("no model")
        return [(text, 0.9, [0, 0, 1, 1]), (" ", 1.0, []), ("7", 0.3, [])] if "1" in text else [(text, 0.9, [0, 0, 1, 1])]

    def tesseract(content):
        if content == b"broken":
            raise OSError("no file")
        return [(w, c, [0, 0, 2, 2]) for w, c in zip(content.decode().split(), ("96", "-1", "n/a"), strict=False)]

    o = images.ImageOptions({"paddleocr": paddle, "tesseract": tesseract}, fixer=lambda t: t.replace("good", "Good") if "good" in t else None)
    found = images.translate_images(readers.images(spark, str(tmp_path)), o, f"{tmp_path}_log")
    got = {r.path.split("/")[-1][0]: r for r in found.collect()}
    assert got["a"].engine == "paddleocr" and got["a"].detected_language == "bn" and got["a"].direction == "bn2en" and got["a"].cleaned_text == "আমি ভালো আছি।সে ভালো" and got["a"].translation
    assert got["b"].engine == "tesseract" and got["b"].ocr_text == "good day @me" and got["b"].direction == "en2bn" and got["b"].ocr_confidence == pytest.approx(0.96 / 3)
    assert got["b"].translation.endswith("@me") and got["b"].translation_result.winning_engine == "nllb"
    assert not got["c"].supported and got["c"].message and got["c"].translation is None and got["c"].cleaned_text.startswith("12345")
    assert got["d"].failure == "tesseract: OSError: no file" and not got["d"].supported
    log = lines(tmp_path.parent / f"{tmp_path.name}_log")
    assert sorted(x["routing_decision"] for x in log) == ["accepted", "accepted", "rejected", "rejected"] and all(x["timestamp"].endswith("+00:00") and len(x["image_hash"]) == 16 for x in log)


def test_evaluation_file_to_json(spark, tmp_path):
    rows = [{"id": str(k), "pair_type": C.TRANSLATION, "text": f"আমি ভালো {k} @a", "parallel_text": f"i am well {k} @a", "is_synthetic": k == 3} for k in range(4)] + [{"id": "x", "pair_type": "other", "text": "a", "parallel_text": "b"}]
    (tmp_path / "pairs.json").write_text("\n".join(map(json.dumps, rows)))
    out = evaluate.run(spark, f"{tmp_path}/pairs.json", "en2bn", f"{tmp_path}/out", names=("full", "single", "baseline"), model=lambda x: [float("well" in s) for s, _, _ in x])
    got = {(r["mode"], r.metric): r.value for r in out.collect()}
    assert {m for m, _ in got} == {"full", "single", "baseline"} and {m for _, m in got} == {"bleu", "chrf", "ter", "pfs", "comet"}
    assert got["full", "comet"] == 1.0 and got["baseline", "pfs"] == 1.0
    written = {x["mode"]: x["metrics"] for x in lines(tmp_path / "out")}
    assert json.loads(written["full"]["bleu"])["value"] == pytest.approx(got["full", "bleu"])
    assert {r["mode"]: r.metric for r in R.mode_delta(out.select("mode", "metric", "value"), "full", "single").withColumn("mode", F.lit("d")).collect()}
    pairs = spark.createDataFrame([("a", "b")], evaluate.PAIRS)
    none = evaluate.evaluate(pairs, {"baseline": evaluate.modes("en2bn")["baseline"]}).where("metric = 'comet'").first()
    assert none.value is None and none.error == "no model"


def test_commands(spark, tmp_path, capsys):
    commands.main(["translate", "en2bn", "u r gr8 #ok", "--fast"], spark)
    out = capsys.readouterr().out
    assert "you are great" in out and "**Direction:** English → Bengali" in out
    (tmp_path / "rows.json").write_text('{"id": "1", "task_labels": {"a": 1}}\n')
    commands.main(["export", f"{tmp_path}/rows.json", f"{tmp_path}/table"], spark)
    assert spark.read.parquet(f"{tmp_path}/table").first().task_labels == '{"a":1}'


def test_corpus_sources(spark, tmp_path):
    (tmp_path / "train.csv").write_text('﻿Text,bangla,english,Label,Misc\n"a, ""b""\nc",ক,x,1,\nd,খ,nan,0,m\n')
    (tmp_path / "val.csv").write_text("Text,bangla,english,Label\ne, ,y,1\nf,ঘ,z,0\n")
    rows = {r.id: r for r in readers.labelled_comments(spark, {"train": f"{tmp_path}/train.csv", "val": f"{tmp_path}/val.csv"}).collect()}
    assert sorted(rows) == ["banth_train_0", "banth_train_1", "banth_val_1"]
    first = rows["banth_train_0"]
    assert first.romanized_text == 'a, "b"\nc' and first.parallel_text == "x" and json.loads(first.task_labels) == {"Label": "1"} and first.license == "mit"
    assert rows["banth_train_1"].parallel_text is None
    (tmp_path / "t.csv").write_text("text_bengali,text_transliterated\nক,ko\n,kho\n")
    assert [(r.id, r.romanized_text) for r in readers.transliteration_pairs(spark, {"t.csv": f"{tmp_path}/t.csv"}).collect()] == [("banglatlit_t.csv_0", "ko")]
    (tmp_path / "u.csv").write_text("text_transliterated\nko\n")
    assert readers.transliteration_pairs(spark, {"u": f"{tmp_path}/u.csv"}).count() == 0
    (tmp_path / "m.csv").write_text("Sentence,Label\na #x,1\nb,0\n")
    mixed = readers.code_mixed_posts(spark, "set", f"{tmp_path}/m.csv", "Sentence", "Label", "cc").collect()
    assert [(r.id, r.hashtags, r.task_labels) for r in mixed] == [("set_0", ["x"], '{"label":"1"}'), ("set_1", [], '{"label":"0"}')]
    (tmp_path / "h.csv").write_text("Hashtag,Final Segmentation\n#goodday,good day\n")
    assert [(r.text, r.parallel_text, r.hashtags) for r in readers.hashtag_pairs(spark, f"{tmp_path}/h.csv").collect()] == [("#goodday", "good day", [])]
    assert readers.hashtag_pairs(spark, f"{tmp_path}/none.csv").count() == 0
    (tmp_path / "p.json").write_text("\n".join(json.dumps({"text": t, "source_dataset": "s", "domain": "d"}) for t in ("a", " ", "c")))
    proxy = {r.id: r for r in readers.proxy_rows(spark, f"{tmp_path}/p.json").collect()}
    assert sorted(proxy) == ["collected_tweets_proxy_0", "collected_tweets_proxy_2"] and all(r.is_proxy_test_set for r in proxy.values())
    assert json.loads(proxy["collected_tweets_proxy_2"].task_labels) == {"source_dataset": "s", "domain": "d"}
    assert readers.proxy_rows(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "x.csv").write_text("a\n1\n")
    assert [r.a for r in readers.optional_csv(spark, f"{tmp_path}/x.csv", "a string").collect()] == ["1"]
    (tmp_path / "o.json").write_text('{"a": "1"}\n')
    assert [r.a for r in readers.optional_json(spark, f"{tmp_path}/o.json", "a string").collect()] == ["1"]


def test_line_numbers_over_blocks(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("".join(f"line {k}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = readers.numbered_lines(spark, f"{tmp_path}/lines.txt", "t")
        assert df.rdd.getNumPartitions() > 3
        assert all(r.t == f"line {r.line_no}" for r in df.collect()) and df.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_live_rows_and_leaks(spark):
    schema = "id long, lang string, topic string, text string, like_count string, retweet_count string, view_count string"
    df = spark.createDataFrame([(1, "bn", "t", "ক", "1", "2", "3"), (1, "en", "t", "b", "1", "2", "3"), (2, "en", "t", " ", "1", "2", "3")], schema)
    got = sorted((r.id, r.text_lang, r.text) for r in corpus_build.live_rows(df).collect())
    # an id that repeats is two rows, each with its own language
    assert got == [("live_tweets_1", "bn", "ক"), ("live_tweets_1", "en", "b")]
    assert all(r.is_paid_source and r.is_local_eval_only and json.loads(r.task_labels)["view_count"] == "3" for r in corpus_build.live_rows(df).collect())
    assert [r.text for r in C.without_leaks(df, spark.createDataFrame([("b",)], "text string")).where("text <> ' '").collect()] == ["ক"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"")], "n long, t string")
    sinks.snapshot(df, f"{tmp_path}/s")
    assert next((tmp_path / "s" / "csv").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfn,t\n")
    assert lines(tmp_path / "s" / "json") == [{"n": 1, "t": 'a,"b"'}]
    assert readers.csv(spark, f"{tmp_path}/s/csv").columns == ["n", "t"]
    for _ in range(2):
        sinks.append_log(df, f"{tmp_path}/log")
    assert len(lines(tmp_path / "log")) == 2
    made = []
    for _ in range(2):
        kept = storage.kept_table(spark, f"{tmp_path}/table", lambda: made.append(1) or df)
        assert kept.count() == 1
    assert made == [1]
    texts = spark.createDataFrame([("one one two",)], "text string")
    assert [tuple(r) for r in G.kept_dictionary(spark, f"{tmp_path}/d", lambda: texts).orderBy("word").collect()] == [("one", 2), ("two", 1)]
    assert G.kept_dictionary(spark, f"{tmp_path}/d", lambda: 1 / 0).count() == 2


def test_streams(spark, tmp_path):
    spark.range(70).selectExpr("id", "concat('t', id % 2) AS topic").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = ingest.file_stream(spark, f"{tmp_path}/in/", 1)
    ingest.snapshots(stream, f"{tmp_path}/out", f"{tmp_path}/cp", 40)
    assert spark.read.json(f"{tmp_path}/out/snapshot/json").count() == 70
    spark.range(5).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/one")
    part = next((tmp_path / "one").glob("*.parquet"))
    target = tmp_path / "w" / "x[1].parquet"
    target.parent.mkdir()
    target.write_bytes(part.read_bytes())
    (tmp_path / "w" / "x1.parquet").write_bytes(part.read_bytes())
    seen = []
    # a file whose name has pattern characters, beside one that the pattern would match
    ingest.drain(ingest.file_stream(spark, f"{tmp_path}/w/x[[]1].parquet".replace("[[]", "[")), lambda b, n: seen.append(b.count()), f"{tmp_path}/cp2")
    assert seen == [5]
    timed = spark.range(30).selectExpr("id % 10 AS id", "concat('t', id % 2) AS topic", "timestamp_seconds(id) AS at")
    timed.coalesce(1).write.parquet(f"{tmp_path}/timed")
    ingest.ingest(spark, f"{tmp_path}/timed", f"{tmp_path}/kept", f"{tmp_path}/cp4", "id", "topic", 3, "at", "1 hour")
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 6
    logged = ingest.file_stream(spark, f"{tmp_path}/in")
    ingest.log_stream(logged, f"{tmp_path}/log", f"{tmp_path}/cp3")
    assert spark.read.json(f"{tmp_path}/log").where("timestamp is not null").count() == 70


def test_small_pieces(spark):
    assert B.loaded(("k",), lambda: [1]) is B.loaded(("k",), lambda: [2])
    assert B.embedding_similarity("abc", "abc") == pytest.approx(1) and B.embedding_similarity("abc", "xyz") < 0.9 and B.embedding_similarity("", "") > 0
    assert B.script_language("আমি ok") == ("bn", 0.5) and B.script_language("123") == (None, 0.0)
    import pandas as pd

    frame = pd.DataFrame({"a": [1]})
    step = B.first_that_works({"bad": lambda b: 1 / 0, "good": lambda b: b.assign(x=2)})
    assert step(frame).to_dict("records") == [{"a": 1, "x": 2, "engine": "good"}]
    with pytest.raises(ZeroDivisionError):
        B.first_that_works({"bad": lambda b: 1 / 0})(frame)
    tagged = B.with_tags(lambda text, name: [(f"{text} <unk>  </s>", "beam", 0.0)], "bn2en")
    assert tagged("ক", "nllb") == [("ben_Beng eng_Latn ক", "beam", 0.0)] and tagged("ক", "banglat5")[0][0] == "bn en ক"
    df = spark.createDataFrame([("x", "ben_Beng", "eng_Latn")], "t string, a string, b string")
    assert df.select(X.tag_languages(F.col("t"), F.col("a"), F.col("b"))).first()[0] == "ben_Beng eng_Latn x"
    rows = spark.createDataFrame([(1, 5, "late"), (1, 2, "first"), (2, 1, "seen"), (3, 9, "new")], "k long, at long, v string")
    got = R.unseen(rows, spark.createDataFrame([(2,)], "k long"), "k", "at").collect()
    assert sorted((r.k, r.v) for r in got) == [(1, "first"), (3, "new")]
    mix = " ".join(["আমি"] * 3000)
    out = spark.createDataFrame([(mix,)], "t string").select(C.code_mix(F.col("t"), F.lit("1")).alias("m")).first().m
    assert sum(w == "ami" for w in out.split()) == 900
    assert translate.Options().engines[0] == "indictrans2"


def test_segmentation_against_all_splits():
    import itertools
    import math

    counts, total = {"my": 50, "day": 40, "out": 30, "a": 5, "dayo": 1, "ut": 2}, 128
    cost = lambda w: math.log(total / counts[w]) if w in counts else math.log(total) + 2 * len(w)
    for word in ("mydayout", "adayout", "zzday", "outoutmy", "m"):
        n = len(word)
        every = [[word[i:j] for i, j in itertools.pairwise([0, *cuts, n])] for k in range(n) for cuts in itertools.combinations(range(1, n), k)]
        assert sum(map(cost, G.viterbi(word, *G.costs_of(counts)))) == pytest.approx(min(sum(map(cost, x)) for x in every))
