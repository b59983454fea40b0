"""A worker's memory is bounded by a slice or a batch, not by the rows that a batch has."""

import contextlib
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from banyan import backends as B
from banyan.operators import language as L
from banyan.operators import metrics as M
from banyan.plans import translate as T
from banyan.sources import storage


def peak(spark, monkeypatch, make, which=0) -> int:
    """MB that a step of make takes at most over one batch of all its rows."""
    steps = []
    kind = type(spark.range(0))
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(kind, name, lambda self, f, schema, *a, own=getattr(kind, name), arrow=name == "mapInArrow", **b: steps.append((self, f, arrow)) or own(self, f, schema, *a, **b))
    with contextlib.suppress(StopIteration):
        make()
    rows, f, arrow = steps[which]
    whole = rows.drop("_script").toArrow().combine_chunks()
    batch = whole.to_batches()[0] if arrow else whole.to_pandas()
    tracemalloc.start()
    for _ in f(iter([batch])):
        pass
    try:
        return tracemalloc.get_traced_memory()[1] >> 20
    finally:
        tracemalloc.stop()


@pytest.fixture(scope="module")
def texts(spark):
    # 3 MB of text on each side, in one batch
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(299)), lambda k: F.concat(F.substring(F.md5(F.concat("id", k)), 1, 9))), " ")
    return spark.range(0, 1000, 1, 1).select("id", words.alias("h")).select("id", "h", F.concat("h", F.lit(" end")).alias("r"), F.lit("en").alias("lang"))


def test_grams_are_counted_by_slices(spark, monkeypatch, texts):
    assert peak(spark, monkeypatch, lambda: M.chrf_counts(texts, "h", "r")) < 100


def test_grams_of_characters_are_numbered_by_slices(spark, monkeypatch, texts):
    model = L.fit(texts.limit(20), "h", "lang")
    assert peak(spark, monkeypatch, lambda: L.identified(texts, model, "h")) < 100
    monkeypatch.undo()
    assert peak(spark, monkeypatch, lambda: L.counts(texts, "h", "lang")) < 100


def test_answers_are_kept_up_to_a_number_of_characters():
    asked = []
    one = B.Asked(lambda xs: asked.extend(xs) or [x.upper() for x in xs], 8, room=1000)
    for _ in range(2):
        assert one(["a" * 400, "b" * 400]) == [("A" * 400, None), ("B" * 400, None)]
    # the first answer is kept, the second has no room
    assert asked == ["a" * 400, "b" * 400, "b" * 400]


@pytest.mark.parametrize("make", [
    lambda d: M.chrf_counts(d, "h", "r"),
    lambda d: M.bleu_counts(d, "h", "r"),
    lambda d: L.counts(d, "h", "lang"),
    lambda d: T.translate(d.select("id", F.col("h").alias("text")), "en2bn"),
    lambda d: __import__("banyan.operators.ocr").operators.ocr.clean_text(F.col("h")),
    lambda d: __import__("banyan.operators.batches").operators.batches.tokenised(d, {"h": "ids"}),
])
def test_batches_have_few_bytes(spark, texts, make):
    names = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k in names:
            spark.conf.unset(k)
        make(texts)
        assert [int(spark.conf.get(k)) for k in names] == [storage.BATCH_ROWS, storage.BATCH_BYTES]
        spark.conf.set(names[0], "7")
        make(texts)
        assert spark.conf.get(names[0]) == "7"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_words_of_slices_are_those_of_columns(spark):
    rng = random.Random(3)
    parts = [*"ab1.,-& '\"\n\t/;!éক😀　  ", "&amp;", "&lt;", "<skipped>", "..", ",,", "1.", "5-"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(15))) for _ in range(400)]
    lists = [r.t for r in spark.createDataFrame([(t,) for t in texts], "x string").select(M.tokens_13a(F.col("x")).alias("t")).collect()]
    ids, owner = M.items_13a(texts)
    assert owner.tolist() == [k for k, x in enumerate(lists) for _ in x]
    pairs = set(zip(ids.tolist(), [w for x in lists for w in x], strict=True))
    assert len(pairs) == len({i for i, _ in pairs}) == len({w for _, w in pairs})
    assert sum(b.num_rows for b in M._slices(pa.record_batch({"h": pa.array(["x" * M.SLICE, None, "y"] * 3)}), ["h"])) == 9


def test_small_shards_share_tasks(spark, tmp_path, monkeypatch):
    from banyan.operators import shards as H

    parts = []
    kind = type(spark.range(0))
    for name in ("repartitionById", "repartitionByRange"):
        monkeypatch.setattr(kind, name, lambda self, n, *a, own=getattr(kind, name): parts.append(n) or own(self, n, *a))
    made = H.write_shards(spark.range(3000).withColumn("text", F.md5(F.col("id").cast("string"))), f"{tmp_path}/a", "id", rows=10)
    assert made.count() == 300 == len(list((tmp_path / "a").glob("shard=*/*.parquet"))) and parts == [1, 1]
    assert H.damaged(spark, f"{tmp_path}/a").count() == 0
    monkeypatch.setattr(H, "LEAST", 500)
    assert H.write_shards(spark.range(3000), f"{tmp_path}/b", "id", rows=10).count() == 300 and parts[2:] == [6, 6]


def test_vectors_explode_no_words(spark, texts):
    from banyan.operators import embedding as E

    docs = texts.limit(50).select("id", "h")
    found = E.vectors(docs, "id", "h", E.frequencies(docs, "h"))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    one = E.Embedder({r.word: r.w for r in E.frequencies(docs, "h").select("word", E.weight(F.col("n"), F.col("df")).alias("w")).collect()})
    text = {r.id: r.h for r in docs.collect()}
    assert all(r.vector == pytest.approx(one(text[r.id]).tolist()) for r in found.collect()) and found.count() == 50


def test_splits_in_order_share_heads():
    import math

    from banyan.operators import segmentation as G

    def plain(word, costs, unseen):
        """Every split of every head."""
        low, best, cuts = word.lower(), [0.0], [0]
        for end in range(1, len(word) + 1):
            least, cut = math.inf, 0
            for start in range(max(0, end - G.LONGEST), end):
                part = low[start:end] if len(low) == len(word) else word[start:end].lower()
                cost = best[start] + (unseen + 2 * (end - start) if costs.get(part) is None else costs[part])
                if cost < least:
                    least, cut = cost, start
            best.append(least)
            cuts.append(cut)
        parts, end = [], len(word)
        while end:
            parts.append(word[cuts[end] : end])
            end = cuts[end]
        return parts[::-1]

    class Counted(dict):
        asked = 0

        def get(self, key):
            self.asked += 1
            return super().get(key)

    rng = random.Random(5)
    costs, unseen = G.costs_of({"".join(rng.choices("abİ", k=rng.randrange(1, 5))): rng.randrange(1, 9) for _ in range(40)})
    words = ["".join(rng.choices("abABİ", weights=[5, 5, 1, 1, 0.2], k=rng.randrange(30))) for _ in range(500)]
    split = G.Splitter(costs, unseen)
    assert all(split(w) == plain(w, costs, unseen) == G.viterbi(w, costs, unseen) for w in [*words, *sorted(words)])
    counted = Counted(costs)
    split = G.Splitter(counted, unseen)
    split("ab" * 10)
    before = counted.asked
    split("ab" * 10 + "a")
    assert counted.asked - before <= G.LONGEST
