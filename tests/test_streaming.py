"""Keyed state, logs that are added once, growing snapshots, and paged sources read by executors."""

import json
import sys
from collections import Counter

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from banyan.sources import sinks
from banyan.streaming import ingest, paged

# workers can't import this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write(spark, rows, path):
    rows = [(i, topic, t.to_pydatetime()) for i, topic, t in rows]
    spark.createDataFrame(rows, "id long, topic string, at timestamp").coalesce(1).write.mode("append").parquet(str(path))


def test_stream_equals_batch_over_restarts_and_late_rows(spark, tmp_path):
    at = lambda day, k: pd.Timestamp(2024, 1, 1) + pd.Timedelta(days=day, minutes=k)
    first = [(k % 30, "hot" if k % 3 else "rare", at(0, k)) for k in range(90)]
    run = lambda: ingest.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", "id", "topic", 25, "at", "2 days", files=1)
    write(spark, first, tmp_path / "in")
    run()
    # rows that repeat, one that is late but within the horizon, and new ones
    second = [(5, "hot", at(0, 95)), (100, "hot", at(-1, 0)), *((200 + k, "rare", at(1, k)) for k in range(40))]
    write(spark, second, tmp_path / "in")
    run()
    run()
    got = [(r.id, r.topic) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    want, seen, used = [], set(), Counter()
    for batch in (first, second):
        new = {}
        for i, topic, _ in batch:
            if i not in seen:
                new.setdefault(i, topic)
        seen |= new.keys()
        for i, topic in sorted(new.items()):
            if used[topic] < 25:
                used[topic] += 1
                want.append((i, topic))
    assert len(got) == len(want) and Counter(t for _, t in got) == Counter(t for _, t in want)
    assert {i for i, _ in got} == {i for i, _ in want}


def test_state_is_bounded(spark, tmp_path):
    """Ids are forgotten after the horizon, and a topic's state is one number."""
    day = lambda d, k: pd.Timestamp(2024, 1, 1) + pd.Timedelta(days=d, seconds=k)
    sizes = []
    for d in range(0, 60, 10):
        write(spark, [(1000 * d + k, f"t{k % 3}", day(d, k)) for k in range(50)], tmp_path / "in")
        sizes.append(ingest.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", "id", "topic", 1000, "at", "1 day"))
    ids = [s["dedupeWithinWatermark"] for s in sizes]
    assert max(ids) <= 100 and {s[k] for s in sizes for k in s if k != "dedupeWithinWatermark"} == {3}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 300


def test_a_hot_topic_brings_few_rows_to_its_task(spark, tmp_path):
    write(spark, [(k, "hot", pd.Timestamp(2024, 1, 1)) for k in range(4000)], tmp_path / "in")
    seen = tmp_path / "seen"
    seen.mkdir()
    own = ingest.Quota.handleInputRows

    class Counted(ingest.Quota):
        def handleInputRows(self, key, rows, timerValues):
            frames = list(rows)
            (seen / f"{key[0]}").write_text(str(sum(map(len, frames))))
            return own(self, key, iter(frames), timerValues)

    plain, ingest.Quota = ingest.Quota, Counted
    try:
        ingest.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", "id", "topic", 7)
    finally:
        ingest.Quota = plain
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.count("*"), F.max("id")).first() == (7, 6)
    assert int((seen / "hot").read_text()) <= 7 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def lines(path):
    return [json.loads(x) for f in sorted(path.glob("*.json")) for x in f.read_text().splitlines()]


def test_a_batch_that_dies_before_its_commit_is_added_once(spark, tmp_path, monkeypatch):
    df = spark.range(20).repartition(3)
    log = f"{tmp_path}/log"
    sinks.append_log(df, log, 0)
    for broken in ("put", "move"):
        real, calls = getattr(sinks, broken), []

        def dies(*a, real=real, calls=calls):
            calls.append(a)
            if len(calls) == (2 if broken == "move" else 1):
                raise OSError("the driver is gone")
            return real(*a)

        monkeypatch.setattr(sinks, broken, dies)
        with pytest.raises(OSError):
            sinks.append_log(df, log, 1 if broken == "put" else 2)
        monkeypatch.setattr(sinks, broken, real)
    for batch in (0, 1, 2, 1, 0):
        sinks.append_log(df, log, batch)
    assert Counter(r["id"] for r in lines(tmp_path / "log")) == {k: 3 for k in range(20)}
    assert sinks.committed(spark, log) == [0, 1, 2] and spark.read.json(log).count() == 60
    sinks.append_log(df, log)
    assert sinks.committed(spark, log) == [0, 1, 2, 3]


def test_snapshots_grow_by_what_is_new(spark, tmp_path):
    spark.range(100).selectExpr("id", "concat('a,\"', id) AS t").repartition(5).write.parquet(f"{tmp_path}/in")
    stream = lambda: ingest.file_stream(spark, f"{tmp_path}/in", 1)
    written = []
    add = ingest.add_snapshot
    ingest.add_snapshot = lambda df, path, batch: written.append(df.count()) or add(df, path, batch)
    try:
        ingest.snapshots(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", 30)
        assert sum(written) == 100 and len(written) >= 3
        spark.range(100, 110).selectExpr("id", "'b' AS t").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.snapshots(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", 30)
        assert sum(written) == 110
        for most in (64, 2):
            ingest.snapshots(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", 30, most)
            rows = spark.read.schema("id long, t string").json(f"{tmp_path}/out/snapshot/json")
            assert sorted(r.id for r in rows.collect()) == list(range(110))
            table = spark.read.options(header=True, escape='"', inferSchema=True).csv(f"{tmp_path}/out/snapshot/csv")
            assert table.columns == ["id", "t"] and table.count() == 110
        # after files were put together new ones are still added, and old batches aren't again
        spark.range(110, 112).selectExpr("id", "'c' AS t").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.snapshots(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", 30)
        assert spark.read.json(f"{tmp_path}/out/snapshot/json").count() == 112 and sum(written) == 112
    finally:
        ingest.add_snapshot = add


def pages_of(query, cursor):
    """Query a has 7 pages, b 3 and then fails, c is limited once at its second page, d is empty."""
    k = int(cursor or 0)
    if query == "d":
        return "exhausted", [], ""
    if query == "b" and k == 3:
        return "error", [], cursor
    last = {"a": 7, "b": 9, "c": 4}[query]
    return "ok", [(f"{query}{k}-{i}",) for i in range(3)], str(k + 1) if k + 1 < last else ""


def run(spark, tmp_path, name, fetch, **options):
    spark.dataSource.register(paged.pages_source(name, "row string", fetch))
    reader = spark.readStream.format(name).options(queries=json.dumps(["a", "b", "c", "d"]), notes=f"{tmp_path}/notes", **options)
    q = reader.load().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        for _ in range(30):
            q.processAllAvailable()
            states = [paged.Notes(f"{tmp_path}/notes").read(x, "state") for x in "abcd"]
            if all(s and s["done"] for s in states):
                break
    finally:
        q.stop()
    return sorted(r.row for r in spark.read.parquet(f"{tmp_path}/out").collect())


WANT = sorted(f"{q}{k}-{i}" for q, n in (("a", 7), ("b", 3), ("c", 4)) for k in range(n) for i in range(3))


def test_queries_are_read_by_executors_and_end_by_themselves(spark, tmp_path):
    flag = tmp_path / "limited"

    def fetch(query, cursor):
        if query == "c" and cursor == "1" and not flag.exists():
            flag.write_text("x")
            return "rate_limited", [], cursor
        return pages_of(query, cursor)

    assert run(spark, tmp_path, "pages_a", fetch, pages=2, pause=0) == WANT


def test_pages_after_a_failure_are_the_same(tmp_path):
    reader = paged.PagesReader(pages_of, ["a", "b", "c", "d"], f"{tmp_path}/n", pages=2, total=6)
    start = reader.initialOffset()
    end = reader.latestOffset()
    assert end == {"a": 1, "b": 1, "c": 1, "d": 1}
    parts = reader.partitions(start, end)
    once = [[*reader.read(p)] for p in parts]
    again = [[*reader.read(p)] for p in parts]
    assert once == again and [len(x) for x in once] == [3, 3, 3, 0]
    # d has ended; the others go on, within the limit of all
    after = reader.latestOffset()
    assert after == {"a": 3, "b": 3, "c": 3, "d": 1}
    later = reader.partitions(end, after)
    assert [p.query for p in later] == ["a", "b", "c"] and [*reader.read(later[0])] == [(f"a{k}-{i}",) for k in (1, 2) for i in range(3)]
    # an executor is lost after it read a page but not to its end
    lost = reader.read(later[1])
    next(lost)
    lost.close()
    assert [*reader.read(later[1])] == [(f"b{k}-{i}",) for k in (1, 2) for i in range(3)]


def test_a_limited_query_rests(tmp_path):
    reader = paged.PagesReader(lambda q, c: ("rate_limited", [], c) if q == "x" else ("ok", [(q,)], "1"), ["x", "y"], f"{tmp_path}/n", pages=1, pause=60)
    end = reader.latestOffset()
    for p in reader.partitions(reader.initialOffset(), end):
        [*reader.read(p)]
    assert [p.query for p in reader.partitions(end, reader.latestOffset())] == ["y"]
