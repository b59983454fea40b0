"""Tables in the shared folder, joins that know their counts, Arrow batches."""

import os
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from banyan.llm import common
from banyan.sources import storage


def test_join_counted_is_a_join(spark, monkeypatch):
    rows = spark.createDataFrame([(0, i) for i in range(70)] + [(1, i) for i in range(20)] + [(k, k) for k in range(2, 40)] + [(None, 5)], "k long, v long")
    values = rows.where("k % 2 = 0 or k = 1").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    for how in ("left", "inner"):
        want = Counter(map(tuple, rows.join(values, "k", how).select("k", "v", "n", "top").collect()))
        for share in (1, 6, 4096):
            monkeypatch.setattr(common, "SHARE", share)
            for total in (None, rows.count()):
                got = common.join_counted(rows, values, ["k"], "n", how, total)
                assert Counter(map(tuple, got.select("k", "v", "n", "top").collect())) == want
    assert common.join_counted(rows.limit(0), values.limit(0), ["k"], "n").count() == 0


def test_cuts_are_dropped(spark):
    def make():
        first = common.cut(spark.range(5))
        return first.join(common.cut(spark.range(3)), "id")

    before = list(common._CUTS)
    out = common.cut_after(make)
    (path,) = [x for x in common._CUTS if x not in before]
    assert out.count() == 3 and os.path.isdir(path) and path == out._banyan_path
    common.drop(out)
    assert not os.path.isdir(path) and common._CUTS == before


@pytest.mark.parametrize("shared", [common.shared_dir, storage.shared_dir])
def test_a_cluster_must_name_a_shared_folder(shared):
    def session(master, folder=None):
        context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: folder))
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d, set=lambda k, v: None))

    assert shared(session("spark://host:7077", "hdfs:/x")) == "hdfs:/x"
    assert os.path.isdir(shared(session("local[4]")))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared(session(master))


def test_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    texts = spark.range(40).repartition(1).select(F.repeat(F.lit("x"), 1_000_000).alias("t"))
    found = [r.n for r in common.map_batches(texts, sizes, "n long").collect()]
    assert sum(found) == 40 and max(found) <= common.BATCH_BYTES // 1_000_000 + 1
