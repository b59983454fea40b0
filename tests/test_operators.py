"""Operators over small tables: corpus, ranking, segmentation, metrics, sources, streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from banyan.operators import corpus as C
from banyan.operators import metrics as M
from banyan.operators import numbering as N
from banyan.operators import ranking as R
from banyan.operators import segmentation as G
from banyan.plans import corpus_build
from banyan.sources import readers, sinks
from banyan.streaming import ingest, paged


def test_unify_schema(spark):
    df = spark.createDataFrame([(1, "#a @b 😍 আমি x", "NaN"), (2, " ", "y"), (3, None, "y")], "i long, t string, p string")
    out = C.unify(df, "src", F.col("i"), C.TRANSLATION, F.col("t"), "bn", F.col("p"), "en")
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [(c.split()[0], c.split()[1].lower()) for c in C.UNIFIED.split(", ")]
    r = out.first()
    assert out.count() == 1 and r.id == "src_1" and r.parallel_text is None and r.hashtags == ["a"] and r.emojis == ["😍"] and r.is_code_mixed
    assert C.unify(df, "src", F.col("i"), "x", F.col("t"), "bn", extract=False).first().hashtags == []


def test_split_sizes_and_hot_key(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 900, "hot").when(F.col("id") < 990, "b").otherwise(None).alias("s"))
    n = {(r.s, r.split): r["count"] for r in C.stratified_split(df, "s", "id").groupBy("s", "split").count().collect()}
    for s, k in (("hot", 900), ("b", 90), (None, 10)):
        want = {"train": math.floor(k * 0.85), "val": math.floor(k * 0.075)}
        want["test"] = k - sum(want.values())
        assert {x: n.get((s, x), 0) for x in want} == want
    assert sorted(r.rn for r in N.by_number(df, "id", "rn", 4).collect()) == list(range(1, 1001))
    assert C.stratified_split(df.limit(0), "s", "id").count() == 0


def test_first_wins(spark):
    df = spark.createDataFrame([(3, "a "), (1, " a"), (2, "nan"), (4, "b")], "p long, t string")
    assert sorted(map(tuple, C.valid_first_wins(df, "t", "p").collect())) == [(1, " a"), (4, "b")]


def test_code_mix_and_augment(spark):
    rows = [(f"x_{i}", C.TRANSLATION, "bn", "আমি ভালো আছি আজ") for i in range(50)] + [("y", "other", "bn", "আমি ভালো আছি")]
    df = spark.createDataFrame(rows, "id string, pair_type string, text_lang string, text string").withColumns({"source_dataset": F.lit("s"), "is_code_mixed": F.lit(False)})
    out = C.augment(df, 0.1).collect()
    assert len(out) == 5 and all(x.is_synthetic and x.source_dataset == "s+synthetic_codemix" and "_synthcm_" in x.id and x.text != rows[0][3] for x in out)
    assert all(sum(w.isascii() for w in x.text.split()) == 1 for x in out)
    assert df.select(C.code_mix(F.lit("আমি ভালো"), F.lit("1"))).first()[0] is None


def test_build_splits(spark):
    rows = [(f"{i}", "s", C.TRANSLATION, "bn", "আমি ভালো আছি আজ", i % 10 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, source_dataset string, pair_type string, text_lang string, text string, is_proxy_test_set boolean").withColumn("is_code_mixed", F.lit(False))
    out = corpus_build.build_splits(df).cache()
    assert out.where("is_proxy_test_set and split <> 'test'").count() == 0
    assert out.where("is_synthetic and split <> 'train'").count() == 0 < out.where("is_synthetic").count()


def test_pairs(spark):
    df = spark.createDataFrame([(1, C.TRANSLATION, "ক", "a <unk>"), (2, C.TRANSLATION, "খ", " "), (3, "x", "গ", "b"), (4, C.TRANSLATION, "ঘ", "d")], "o long, pair_type string, text string, parallel_text string")
    assert [tuple(r) for r in C.translation_pairs(df, "en2bn", order="o").orderBy("o").collect()] == [(1, "a", "ক"), (4, "d", "ঘ")]
    assert C.translation_pairs(df, "bn2en", 1, "o", "reference").first().reference == "a"


def test_best_and_dedupe(spark):
    schema = "source_id long, engine string, text string, cand_idx long, score double"
    df = spark.createDataFrame([(1, "e", "u", 0, None), (1, "e", "s", 1, -5.0), (2, "e", "a", 0, None), (2, "f", "a", 1, None), (3, "e", "x", 0, 1.0), (3, "e", "x", 1, 1.0), (3, "e", "", 2, 9.0)], schema)
    assert {r.source_id: r.cand_idx for r in R.best(df.where("text <> ''")).collect()} == {1: 1, 2: 0, 3: 0}
    assert sorted((r.source_id, r.engine, r.cand_idx) for r in R.dedupe_candidates(df).collect()) == [(1, "e", 0), (1, "e", 1), (2, "e", 0), (2, "f", 1), (3, "e", 0)]
    arr = df.where("source_id = 1").groupBy().agg(F.array_sort(F.collect_list(F.struct("cand_idx", "score"))).alias("c"))
    assert arr.select(R.best_of_array(F.col("c"))).first()[0] == 1


def test_checkpoint_and_delta(spark):
    assert R.latest_checkpoint(spark.createDataFrame([("o/checkpoint-9",), ("o/checkpoint-10",), ("x",)], "path string")).first()[0] == "o/checkpoint-10"
    df = spark.createDataFrame([("full", "b", 3.0), ("single", "b", 1.0), ("full", "c", None), ("single", "c", 1.0)], "mode string, metric string, value double")
    assert [tuple(r) for r in R.mode_delta(df, "full", "single").collect()] == [("b", 2.0)]


def test_segmentation(spark):
    words = spark.createDataFrame([("my", 50), ("day", 40), ("out", 30), ("love", 9)], "word string, cnt long")
    segment = G.segmenter(words)
    tags = ["#IWasHappyBefore", "#", "#mydayout", "loveday", None, "#zz"]
    got = {r.t: r.w for r in spark.createDataFrame([(t,) for t in tags], "t string").select("t", segment(F.col("t")).alias("w")).collect()}
    assert got["#IWasHappyBefore"] == ["I", "Was", "Happy", "Before"] and got["#"] == [] and got["#mydayout"] == ["my", "day", "out"] and got["loveday"] == ["love", "day"]
    assert G.viterbi("ab", *G.costs_of({})) == ["ab"] and "".join(G.viterbi("q" * 45, *G.costs_of({}))) == "q" * 45 and G.viterbi("İab", *G.costs_of({"ab": 1})) == ["İ", "ab"]


def test_fidelity(spark):
    df = spark.createDataFrame([("great news 😍🔥", "darun khobor 😍"), ("hello there", "x"), ("check #deal", "dekho #deal #extra"), ("@a hi", "hi")], "source_text string, translated_text string")
    rows = M.fidelity_rows(df)
    got = {r.source_text: (r.emoji_preservation, r.hashtag_count_preservation, r.overall) for r in rows.collect()}
    assert got["great news 😍🔥"] == (0.5, None, 0.5) and got["hello there"] == (None, None, None) and got["check #deal"][1] == 1.0
    s = {r.dimension: (r.mean, r.n_applicable, r.n_total) for r in M.fidelity_summary(rows).collect()}
    assert s["overall"] == (0.5, 3, 4) and s["verbatim_preservation"] == (0.0, 1, 4)


def corpus_scores(spark, pairs):
    df = spark.createDataFrame(pairs, "h string, r string")
    return M.bleu(M.bleu_counts(df, "h", "r")).first().bleu, M.chrf(M.chrf_counts(df, "h", "r")).first().chrf, M.ter(df, "h", "r").first().ter


def test_metrics(spark):
    ref = "The quick brown fox jumps over the lazy dog, twice."
    same = corpus_scores(spark, [(ref, ref)])
    part = corpus_scores(spark, [("The quick fox jumps over a lazy dog.", ref)])
    wrong = corpus_scores(spark, [("nothing here agrees", ref)])
    assert same[0] == pytest.approx(100) and same[1] == pytest.approx(100) and same[2] == 0
    assert same[0] > part[0] > wrong[0] == 0 and same[1] > part[1] > wrong[1] and same[2] < part[2] < wrong[2]
    # by hand: unigrams 2 of 3, bigrams 1 of 2, trigrams 0 of 1 counts as half of one; no 4-gram
    b = spark.createDataFrame([("a b c d", "a b x d")], "h string, r string")
    assert M.bleu(M.bleu_counts(b, "h", "r")).first().bleu == pytest.approx(100 * (3 / 4 * 1 / 3 * 1 / (2 * 2) * 1 / (4 * 1)) ** 0.25)
    assert M.ter_edits("b c a".split(), "a b c".split()) == 1
    assert [r.t for r in spark.createDataFrame([("It's 3.5, \"ok\" (a-b) 1,000 5-x!",)], "x string").select(F.explode(M.tokens_13a(F.col("x"))).alias("t")).collect()] == ["It's", "3.5", ",", '"', "ok", '"', "(", "a-b", ")", "1,000", "5", "-", "x", "!"]


def brute_bleu_and_chrf(pairs, tokens, words):
    """Both scores by counting lists, straight from their definitions."""
    import re
    from collections import Counter

    grams = lambda x, n: Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))

    def pooled(split, orders):
        for n in range(1, orders + 1):
            each = [(grams(split(h), n), grams(split(r), n)) for h, r in pairs]
            yield sum(sum((h & r).values()) for h, r in each), sum(sum(h.values()) for h, _ in each), sum(sum(r.values()) for _, r in each)

    lengths = [sum(len(tokens(x[k])) for x in pairs) for k in (0, 1)]
    logs, halves = 0.0, 1
    for m, h, _ in pooled(tokens, 4):
        if not m:
            halves *= 2
        logs += math.log(m / h if m else 1 / (halves * h)) / 4
    bleu = 100 * math.exp(logs) * (math.exp(1 - lengths[1] / lengths[0]) if lengths[0] < lengths[1] else 1)
    shares = [(m / h, m / r) for m, h, r in [*pooled(lambda t: re.sub(r"\s+", "", t), 6), *pooled(words, 2)] if h and r]
    p, r = (sum(x[k] for x in shares) / len(shares) for k in (0, 1))
    return bleu, 100 * 5 * p * r / (4 * p + r)


def test_metrics_against_brute_force(spark):
    import random

    r = random.Random(12)
    some = ["the", "cat", "sat", "on", "a", "mat", "আমি", "é😍", "dog", "x", "run"]
    text = lambda: " ".join(r.choice(some) for _ in range(r.randint(0, 14)))
    pairs = [(text(), text()) for _ in range(60)] + [("", "the cat"), ("the cat", ""), ("a a a a", "a a")]
    want = brute_bleu_and_chrf(pairs, str.split, str.split)
    df = spark.createDataFrame(pairs, "h string, r string").repartition(3)
    got = corpus_scores(spark, pairs)
    assert got[0] == pytest.approx(want[0]) and got[1] == pytest.approx(want[1])
    # many different items: n-grams are numbered anew to fit
    ids = np.array([r.randrange(2**20) for _ in range(50)] * 4, np.int64)
    owner, is_ref = np.tile(np.repeat([0, 1], 50), 2), np.repeat([False, True], 100)
    assert [x.tolist() for x in M.clipped(ids, owner, is_ref, 2, 6)] == [[51 - n] * 2 for n in range(1, 7)]
    assert df.count() == len(pairs)


def test_translation_edit_rate():
    """The example of the metric's paper: one move, two changes, one word put in. Others by hand."""
    ref = "SAUDI ARABIA denied THIS WEEK information published in the AMERICAN new york times".split()
    hyp = "THIS WEEK THE SAUDIS denied information published in the new york times".split()
    assert M.ter_edits(hyp, ref) == 4
    for h, r, n in (("b c a", "a b c", 1), ("c d a b", "a b c d", 1), ("", "a b", 2), ("a b", "", 2), ("", "", 0), ("a x c", "a b c", 1), ("a b c d e f", "d e f a b c", 1), ("x a b y c d", "c d x a b y", 1), ("a b", "b a", 1)):
        assert M.ter_edits(h.split(), r.split()) == n, (h, r)


def searched(hyp, ref):
    """Edits by whole tables and every move within reach: the definition, without bands, bounds or blocks."""

    def table(h):
        d = [list(range(len(ref) + 1))]
        for i, x in enumerate(h, 1):
            d.append([i])
            for j, y in enumerate(ref, 1):
                d[i].append(min(d[i - 1][j - 1] + (x != y), d[i - 1][j] + 1, d[i][j - 1] + 1))
        return d

    h, moves = list(hyp), 0
    while True:
        d = table(h)
        i, j, wrong_h, wrong_r, until = len(h), len(ref), [False] * len(h), [False] * len(ref), [0] * len(ref)
        while i or j:
            if i and j and d[i][j] == d[i - 1][j - 1] + (h[i - 1] != ref[j - 1]):
                i, j = i - 1, j - 1
                wrong_h[i] = wrong_r[j] = h[i] != ref[j]
                until[j] = i
            elif i and d[i][j] == d[i - 1][j] + 1:
                i -= 1
                wrong_h[i] = True
            else:
                j -= 1
                wrong_r[j], until[j] = True, i - 1
        best, found = d[-1][-1] if h else len(ref), []
        for start in range(len(h)):
            for at in range(max(0, start - 50), min(len(ref), start + 51)):
                for n in range(1, 11):
                    run = h[start : start + n]
                    if len(run) < n or run != ref[at : at + n]:
                        break
                    if any(wrong_h[start : start + n]) and any(wrong_r[at : at + n]) and not start <= until[at] < start + n:
                        rest = h[:start] + h[start + n :]
                        for k in range(at - 1, at + n):
                            behind = until[k] + 1 if k >= 0 else 0
                            to = behind if behind <= start + n else behind - n
                            new = rest[:to] + run + rest[to:]
                            found.append((table(new)[-1][-1], -n, start, to, new))
        if not found or min(found)[0] >= best:
            return moves + best
        moves, h = moves + 1, min(found)[4]


def shaken(r, n, values, times):
    """Words, and the same with some gone, put in, or moved as a run."""
    a = [str(r.randrange(values)) for _ in range(n)]
    b = list(a)
    for _ in range(times):
        kind, i, size = r.random(), r.randrange(len(b) + 1), r.randint(1, 8)
        if kind < 0.25:
            del b[i : i + 1]
        elif kind < 0.5:
            b.insert(i, str(r.randrange(values)))
        else:
            run = b[i : i + size]
            del b[i : i + size]
            j = min(len(b), max(0, i + r.randint(-40, 40)))
            b[j:j] = run
    return a, b


@pytest.mark.parametrize("cells", [200, 4_000_000])
def test_translation_edit_rate_against_the_whole_search(monkeypatch, cells):
    import random

    monkeypatch.setattr(M, "CELLS", cells)
    r = random.Random(cells)
    for _ in range(120):
        a, b = shaken(r, r.randint(1, 14), r.choice([2, 4, 30]), r.randint(0, 4))
        assert M.ter_edits(a, b) == searched(a, b), (a, b)


def test_translation_edit_rate_of_twenty_thousand_words():
    import random

    r = random.Random(9)
    a, b = shaken(r, 20_000, 3000, 0)
    for k in range(5):
        i = 3000 * (k + 1)
        run = b[i : i + 7]
        del b[i : i + 7]
        b[i + 20 : i + 20] = run
    b[100] = b[19_000] = "new"
    # each move is one edit; without moves they would be fourteen each
    assert M.ter_edits(a, b) == 7
    assert M.ter_edits(["x"] * 20_000, ["y"] * 19_990) == 20_000


def test_translation_edit_rate_bounds():
    import random
    import time

    r = random.Random(3)

    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(last + (x != y), d[j] + 1, d[j - 1] + 1)
        return d[-1]

    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randint(1, 12))] for _ in range(2))
        n = M.ter_edits([str(x) for x in a], [str(x) for x in b])
        assert abs(len(a) - len(b)) <= n <= plain(a, b)
        assert M.distance(np.array(a), np.array(b)) == plain(a, b)
    began = time.time()
    words = [str(r.randrange(60)) for _ in range(160)]
    assert M.ter_edits(words[80:] + words[:80], words) > 0
    M.ter_edits([str(r.randrange(9)) for _ in range(200)], [str(r.randrange(9)) for _ in range(200)])
    M.ter_edits(["a"] * 6000, ["a", "b"] * 3000)
    assert time.time() - began < 60


def test_sources(spark, tmp_path):
    (tmp_path / "bn").write_text("ক\nখ \nগ\n"), (tmp_path / "en").write_text("a\n b\n")
    assert sorted(map(tuple, readers.parallel_lines(spark, f"{tmp_path}/bn", f"{tmp_path}/en").collect())) == [(0, "ক", "a"), (1, "খ", "b")]
    (tmp_path / "c.csv").write_text('﻿id,text\n1,"a, ""b""\nc"\n')
    assert [tuple(r) for r in readers.csv(spark, f"{tmp_path}/c.csv").collect()] == [("1", 'a, "b"\nc')]
    assert readers.optional_csv(spark, f"{tmp_path}/none.csv", "a string").count() == 0
    spark.range(100).repartition(4).write.parquet(f"{tmp_path}/p")
    assert max(r["count"] for r in readers.parquet_shards(spark, f"{tmp_path}/p", 40, "id").groupBy("shard").count().collect()) <= 10
    assert C.infer_column(["id", "Tweet_Text"], "text", "sentence") == "Tweet_Text" and C.infer_column(["a", "b"], "text") == "a"
    df = spark.createDataFrame([(1, None)], "a long, b string").withColumn("split", F.lit("train"))
    sinks.splits(df, f"{tmp_path}/s")
    assert '"b":null' in next((tmp_path / "s" / "split=train").glob("*.json")).read_text()


def test_tweets(spark):
    schema = "id long, lang string, createdAt string, text string, entities struct<hashtags:array<struct<text:string>>>, author struct<userName:string,name:string>, likeCount long, retweetCount long, replyCount long, viewCount long, url string"
    r = C.flatten_tweets(spark.createDataFrame([(1, "bn", "d", " a\nb ", ([("x",), ("y",)],), ("u", "n"), 1, 2, 3, 4, "w")], schema), F.lit("t")).first()
    assert len(r) == 13 and r.text == "a b" and r.hashtags == "x;y" and r.username == "u"


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    rows = spark.range(60).selectExpr("id % 40 AS id", "concat('t', id % 2) AS topic")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    run = lambda: ingest.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", "id", "topic", 15)
    run()
    spark.range(100, 140).selectExpr("id", "concat('t', id % 3) AS topic").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert {r.topic: r["count"] for r in out.groupBy("topic").count().collect()} == {"t0": 15, "t1": 15, "t2": 13}
    assert out.count() == out.select("id").distinct().count()


def test_paged_source(spark):
    pages = {"": ("ok", [("1",), ("2",)], "c1"), "c1": ("ok", [("3",)], "c2"), "c2": ("exhausted", [], "")}
    reader = paged.PagedReader(lambda q, c: pages[c], "q", 2)
    rows, at = reader.read(reader.initialOffset())
    assert [*rows] == [("1",), ("2",), ("3",)] and at == {"cursor": "c2", "done": False, "empty": 0}
    assert [*reader.readBetweenOffsets(reader.initialOffset(), at)] == [("1",), ("2",), ("3",)]
    rows, at = reader.read(at)
    assert [*rows] == [] and at["done"]
    silent = paged.PagedReader(lambda q, c: ("ok", [], c + "x"), "q", 1, 2)
    at = silent.initialOffset()
    for done in (False, True):
        _, at = silent.read(at)
        assert at["done"] is done
    calls = []
    status, *_ = paged.patient(lambda q, c: calls.append(1) or ("rate_limited", [], c), 2, 0)("q", "")
    assert status == "rate_limited" and len(calls) == 3
