"""Shards of a global shuffle, training batches, the language identifier and the embedder, against plain Python."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from banyan import backends
from banyan.functions import scores as S
from banyan.operators import batches as B
from banyan.operators import embedding as E
from banyan.operators import language as L
from banyan.operators import segmentation as G
from banyan.operators import shards as H
from banyan.plans import corpus_build, images, translate


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def some_rows(n=230):
    """A third of the rows has one id; there are null ids, equal rows, and columns named like the operator's own."""
    rows = [(str(k), f"text {k}", [k, None], k) for k in range(n)]
    return rows + [("hot", f"hot {k % 40}", [1], 0) for k in range(n // 2)] + [(None, None, None, None), (None, "x", [], 1)]


SCHEMA = "id string, text string, tags array<long>, _at long"


def test_shards_are_the_whole_order_cut(spark):
    rows = some_rows()
    got = H.placed(spark.createDataFrame(rows, SCHEMA).repartition(5), "id", rows=40).collect()
    at = sorted(got, key=lambda r: (r.shard, r.place))
    assert [(r.shard, r.place) for r in at] == [(k // 40, k % 40) for k in range(len(rows))]
    digests = [md5(f"42|{r.id or ''}") for r in at]
    assert digests == sorted(digests)
    assert Counter((r.id, r.text, r["_at"]) for r in at) == Counter((r[0], r[1], r[3]) for r in rows)
    assert H.placed(spark.createDataFrame([], SCHEMA), "id").collect() == []


def contents(path):
    return {f.parent.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in sorted(path.glob("shard=*/*.parquet"))}


def test_reruns_write_the_same_bytes_and_a_shard_a_file(spark, tmp_path):
    df = spark.createDataFrame(some_rows(), SCHEMA)
    first = H.write_shards(df.repartition(3), f"{tmp_path}/a", "id", rows=50).collect()
    second = H.write_shards(df.repartition(7, "text"), f"{tmp_path}/b", "id", rows=50).collect()
    assert sorted(first) == sorted(second) and sum(r.rows for r in first) == df.count()
    a, b = contents(tmp_path / "a"), contents(tmp_path / "b")
    assert a == b and len(a) == len(list((tmp_path / "a").glob("shard=*/*.parquet"))) == len(first) == -(-df.count() // 50)
    other = H.write_shards(df, f"{tmp_path}/c", "id", seed=7, rows=50).collect()
    assert sorted(other) != sorted(first)


def test_no_task_holds_more_than_a_shard(spark):
    df = spark.createDataFrame(some_rows(), SCHEMA)
    tasks = H.one_task_each(H.placed(df, "id", rows=30), 12).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n"), F.count_distinct("shard").alias("k")).collect()
    assert len(tasks) == -(-df.count() // 30) and all(t.n <= 30 and t.k == 1 for t in tasks)


def test_damage_is_told(spark, tmp_path):
    df = spark.createDataFrame(some_rows(), SCHEMA)
    path = f"{tmp_path}/s"
    H.write_shards(df, path, "id", rows=50)
    assert H.damaged(spark, path).count() == 0
    swapped = H.read_shards(spark, path).withColumn("place", F.when(F.col("shard") == 2, 49 - F.col("place")).otherwise(F.col("place"))).where("shard <> 3").collect()
    schema = H.read_shards(spark, path).schema
    spark.createDataFrame(swapped, schema).write.mode("overwrite").partitionBy("shard").parquet(path)
    assert sorted(r.shard for r in H.damaged(spark, path).collect()) == [2, 3]
    empty = spark.createDataFrame([], SCHEMA)
    assert H.write_shards(empty, f"{tmp_path}/none", "id").count() == 0


def test_splits_are_shuffled_as_a_whole(spark, tmp_path):
    rows = spark.createDataFrame([(str(k), ("train", "val", "test")[k % 3], f"t{k}") for k in range(90)], "id string, split string, text string")
    manifest = corpus_build.write_splits(rows, str(tmp_path), rows=20).collect()
    assert Counter(r.split for r in manifest) == {"train": 2, "val": 2, "test": 2}
    train = [r.id for r in H.read_shards(spark, f"{tmp_path}/train").orderBy("shard", "place").collect()]
    assert train == sorted((str(k) for k in range(0, 90, 3)), key=lambda i: md5(f"42|{i}")) != sorted(train, key=int)


def test_batches_against_a_plain_collator(spark):
    r = random.Random(4)
    pairs = [(str(k), "é" * r.randint(0, 30) + "a", None if k == 5 else "b" * r.randint(0, 200)) for k in range(100)]
    rows = B.training_rows(spark.createDataFrame(pairs, "id string, source string, target string").repartition(3), "id", "bn2en", longest=64, size=8, rows=30, codes=("ben_Beng", "eng_Latn")).cache()
    ids = {i: ([b + 3 for b in f"ben_Beng eng_Latn {s}".encode()] + [1], [b + 3 for b in (t or "").encode()] + [1]) for i, s, t in pairs}
    ids = {i: (a[:64], b[:64]) for i, (a, b) in ids.items()}
    order = sorted(ids, key=lambda i: md5(f"42|{i}"))
    want = {}
    for shard in range(4):
        own = order[30 * shard : 30 * shard + 30]
        own = sorted(own, key=lambda i: (len(ids[i][0]), len(ids[i][1]), own.index(i)))
        cuts = [own[a : a + 8] for a in range(0, len(own), 8)]
        for batch, (_, cut) in enumerate(sorted((md5(f"42|{shard}|{k}"), cut) for k, cut in enumerate(cuts))):
            s, t = (max(len(ids[i][k]) for i in cut) for k in (0, 1))
            pad = lambda x, n, by: x + [by] * (n - len(x))
            want[shard, batch] = ([pad(ids[i][0], s, 0) for i in cut], [pad([1] * len(ids[i][0]), s, 0) for i in cut], [pad(ids[i][1], t, -100) for i in cut])
    got = {(b.shard, b.batch): (b.input_ids, b.attention_mask, b.labels) for b in B.batches(rows).collect()}
    assert got == want
    share = B.padding_share(rows).first()
    assert share.cells == sum(len(m[0]) * len(m) for b in want.values() for m in (b[0], b[2])) and share.batches == len(want)
    assert {x.direction for x in rows.collect()} == {"bn2en"}


def test_a_tokenizer_is_asked_for_many_texts_at_once(spark, tmp_path):
    def counted(texts):
        (tmp_path / str(hash(tuple(texts)))).write_text(str(len(texts)))
        return [[len(t)] for t in texts]

    df = spark.createDataFrame([(k, f"x{k}") for k in range(1200)], "id long, t string").coalesce(1)
    got = B.tokenised(df, {"t": "ids"}, counted).collect()
    assert all(r.ids == [len(r.t)] for r in got)
    asked = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert sum(asked) == 1200 and max(asked) == B.ASKED and len(asked) == 3


def test_a_tokenizer_file(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.json")
    got = B.tokenised(spark.createDataFrame([("hello world <|endoftext|>",), (None,)], "t string"), {"t": "ids"}, B.file_tokenizer(path), longest=3).collect()
    assert [len(r.ids) for r in got] == [3, 0]


@pytest.fixture(scope="module")
def model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fold = F.substring(F.md5(F.concat(F.lit("42|"), F.col("doc_id").cast("string"))), 1, 1)
    return L.fit(docs.where(fold < "c"), "text", "lang"), docs, docs.where(fold >= "c")


def test_language_of_held_out_documents(spark, model):
    fitted, _, rest = model
    found = L.identified(rest, fitted, "text").collect()
    assert len(found) > 30 and np.mean([r.predicted == r.lang for r in found]) >= 0.95
    # and of short texts
    short = L.identified(rest.withColumn("text", F.expr("substring(text, 1, 60)")).where("length(text) = 60"), fitted, "text").collect()
    assert np.mean([r.predicted == r.lang for r in short]) >= 0.95


def test_language_against_brute_force(spark, model):
    fitted, docs, _ = model
    texts = [r[0] for r in docs.select(L.letters(F.col("text"))).limit(25).collect()] + [" é ", " aß ", "  ", " x y "]
    for text, (label, sure) in zip(texts, fitted.predict(texts), strict=True):
        if not text.strip():
            assert (label, sure) == (None, 0.0)
            continue
        scores = L.brute_force(fitted, text)
        top = max(scores.values())
        assert label == min(x for x, s in scores.items() if s > top - 1e-9)
        n = sum(len(text) - k + 1 for k in (1, 2, 3)) - text.count(" ")
        assert sure == pytest.approx(1 / sum(np.exp(min(n, L.SHARP) * (s - top)) for s in scores.values()))


def test_language_hooks_scripts_and_tables(spark, model, tmp_path):
    fitted, docs, _ = model
    texts = {"আমি ভালো আছি এবং আজকে": "bn", "मैं ठीक हूं और आज मौसम": "hi", "நான் நலமாக இருக்கிறேன்": "ta", "أنا بخير والجو جميل": "ar", "": None, "😀😀": None, "123 45": None}
    hook = L.predictor(fitted)
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for r in L.identified(rows, fitted, "t").collect():
        assert r.predicted == texts.get(r.t) and (r.predicted is None) == (r.confidence == 0.0)
    for t, lang in texts.items():
        assert hook(t)[0] == lang
    some = docs.limit(30).select("text").collect()
    got = {r.text: (r.predicted, r.confidence) for r in L.identified(docs.limit(30), fitted, "text").collect()}
    for r in some:
        label, sure = hook(r.text)
        assert label == got[r.text][0] and sure == pytest.approx(got[r.text][1])
    L.save(fitted, spark, f"{tmp_path}/m")
    again = L.load(spark, f"{tmp_path}/m")
    assert again.labels == fitted.labels and (again.weights == fitted.weights).all()
    empty = L.fit(docs.limit(0), "text", "lang")
    assert empty.labels == () and empty.predict([" a "]) == [(None, 0.0)]
    with pytest.raises(ValueError):
        L.fit(spark.range(300).select(F.lit("a").alias("t"), F.col("id").alias("l")), "t", "l")


def test_the_gate_reads_the_model(spark, model):
    """Other languages in Latin letters are rejected, which a share of scripts can't tell."""
    fitted, docs, rest = model
    hook = L.predictor(fitted)
    rows = rest.groupBy("lang").agg(F.first("text").alias("text")).collect()
    reader = {"mock": lambda content: [(content.decode(), 0.9, [0, 0, 1, 1])]}
    frame = spark.createDataFrame([(r.lang, bytearray(" ".join(r.text.split()[:40]).encode())) for r in rows], "path string, content binary")
    done = images.translate_images(frame, images.ImageOptions(reader, language=hook)).collect()
    assert {r.path: r.supported for r in done} == {r.lang: r.lang == "en" for r in rows}
    gate = L.identified(rest, fitted, "text").select("lang", S.gate(F.col("text"), F.col("predicted"), F.col("confidence"))["language"].alias("g"))
    assert {r.lang for r in gate.where("g = 'en'").collect()} == {"en"}


TEXTS = [(1, "the cat sat on the mat"), (2, "the cat sat on the mat"), (3, "a dog ran"), (4, ""), (5, None), (6, "😀 !"), (7, "Straße ভালো 12 a_b"), (8, "the the the"), (3, "another text of id 3")]


def test_vectors_against_single_texts(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    known = E.frequencies(df, "text", 9)
    n = len(TEXTS)
    weights = {r.word: np.log((n + 1) / (r.df + 1)) + 1 for r in known.collect()}
    assert len(weights) == 9
    own = E.Embedder(weights, np.log(n + 1) + 1)
    got = E.vectors(df, "id", "text", known).collect()
    want = Counter((i, tuple(np.round(own(t or ""), 9))) for i, t in TEXTS)
    assert Counter((r.id, tuple(np.round(r.vector, 9))) for r in got) == want
    by = {r.id: r.vector for r in got if r.id != 3}
    pairs = [(1, 2), (1, 8), (4, 5), (1, 4), (6, 4), (7, 1)]
    cos = spark.createDataFrame([(a, b, by[a], by[b]) for a, b in pairs], "a long, b long, x array<double>, y array<double>").select("a", "b", E.similarity(F.col("x"), F.col("y")).alias("s")).collect()
    text = dict(TEXTS)
    hook = E.embedder(known)
    for r in cos:
        assert r.s == pytest.approx(hook(text[r.a] or "", text[r.b] or ""), abs=1e-12)
    assert {(r.a, r.b): round(r.s, 9) for r in cos}[1, 2] == 1.0
    assert E.vectors(df.limit(0), "id", "text", known).count() == 0


def test_similarity_tells_alike_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hook = E.embedder(E.frequencies(docs, "text"))
    texts = [r.text for r in docs.where("n_chars > 600 and lang = 'en'").limit(20).collect()]
    for a, b in zip(texts, texts[1:], strict=False):
        words = a.split()
        assert hook(a, " ".join(words[:-3])) > 0.9 > hook(a, b)
    assert backends.embedding_similarity("a b", "a b") == 1.0


def test_the_round_trip_uses_the_embedder(spark):
    df = spark.createDataFrame([(1, "good day to you all my dear friends"), (2, "we sing together every single evening")], "id long, text string")
    hook = E.embedder(E.frequencies(df, "text"))
    options = translate.Options(similarity=hook, back=lambda text, engine, direction: text if "good" in text else "nothing of that sort was ever said")
    got = {r.id: r for r in translate.translate(df, "en2bn", options).collect()}
    assert got[1].roundtrip_similarity == 1.0 and not got[1].low_confidence
    assert got[2].roundtrip_similarity < 0.5 and got[2].low_confidence
    assert json.dumps(got[1].roundtrip_text)


def test_words_are_split_without_python_as_with_it(spark, sf):
    """All pairs of words of some texts, and odd tags, against the function that workers run; each different tag is split once."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(12).select("text")
    dictionary = G.top_words(G.word_counts(docs, "text"), 400).cache()
    words = [w for r in docs.collect() for w in r.text.split()][:300]
    tags = ["#" + a + b for a, b in zip(words, words[1:], strict=False)] + ["#GoodDay", "#good", "#", "", None, "#İstanbul", "#ভালোবাসা", "#" + "q" * 45, "#a1b2", "#ab", "#ab"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(tags)], "w long, tag string").repartition(3)
    segment = G.segmenter(dictionary)
    want = {r.w: r.words for r in rows.select("w", segment(F.col("tag")).alias("words")).collect()}
    got = G.segmented(rows, "tag", dictionary).collect()
    assert len(got) == len(tags) and {r.w: r.words for r in got} == want
    # pieces that are known and unknown, longer than the longest, and of which there are none
    costs, unseen = G.costed(dictionary)
    split = {r.t: r.parts for r in G.split_words(spark.createDataFrame([("",), ("theof" * 9,), ("İab",), (None,)], "t string"), "t", costs, unseen).collect()}
    own = G.costs_of({r.word: r.cnt for r in dictionary.collect()})
    assert split == {t: G.viterbi(t, *own) for t in ("", "theof" * 9, "İab")}
