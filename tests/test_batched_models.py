"""How often models are asked: batches, retries by halves, each text once, each mode and image once."""

import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from banyan import __main__ as commands
from banyan import backends as B
from banyan.operators import evaluation as E
from banyan.operators import metrics as M
from banyan.plans import evaluate, images
from banyan.plans import translate as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Calls:
    """Counts calls over workers: a file each."""

    def __init__(self, folder):
        self.folder = str(folder)

    def note(self, x):
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(x)

    def read(self):
        import pathlib

        return sorted(f.read_text() for f in pathlib.Path(self.folder).iterdir())


@pytest.fixture
def calls(tmp_path):
    (tmp_path / "calls").mkdir()
    return Calls(tmp_path / "calls")


def test_batches_are_sorted_and_halved():
    seen = []

    def ask(texts):
        seen.append(list(texts))
        if any("bad" in t for t in texts):
            raise RuntimeError("no memory")
        return [t.upper() for t in texts]

    asked = B.Asked(ask, 4)
    got = asked(["aaa", None, "b", "bad", "aaa", "cccc", "dd", "eeeee"])
    assert got == [("AAA", None), (None, None), ("B", None), (None, "RuntimeError: no memory"), ("AAA", None), ("CCCC", None), ("DD", None), ("EEEEE", None)]
    # shortest first; the batch with the bad one by halves
    assert seen == [["b", "dd", "aaa", "bad"], ["b", "dd"], ["aaa", "bad"], ["aaa"], ["bad"], ["cccc", "eeeee"]]
    seen.clear()
    assert asked(["b", "x", "bad"])[0] == ("B", None) and seen == [["x", "bad"], ["x"], ["bad"]]
    assert B.Asked(lambda x: [1], 4)(["a", "b"]) == [(1, None), (1, None)] and B.Asked(lambda x: [], 4)(["a"])[0][1].startswith("ValueError")
    few = B.Asked(lambda x: x, 4, most=1)
    assert [x for x, _ in few(["a", "b", "c"])] == ["a", "b", "c"] and len(few.kept) == 1


def texts_of(n):
    return [(k, f"text {'x' * (k % 13)} {k % 20} #Tag{k % 3} @me") for k in range(n)] + [(1000, ""), (1001, None), (1002, "fails always")]


def engine(text, name):
    if "fails" in text and name == "nllb":
        raise RuntimeError("down")
    return [(f"{text} {name}", "beam", -1.0), (text, "sample", None)]


def quality(source, texts):
    return [float(len(source) - len(t)) for t in texts]


def editor(system, prompt):
    return prompt.split("\n")[1] + " !" if "7" in prompt else None


SHOWN = ("id", "translation", "final", "winning_engine", "qe_score", "qe_method", "roundtrip_similarity", "low_confidence", "note", "edit_applied", "failures", "error")


def test_batched_hooks_give_what_single_ones_do(spark, calls):
    df = spark.createDataFrame(texts_of(60), "id long, text string").coalesce(1)
    single = T.Options(engine=engine, quality=quality, editor=editor)

    def many(kind, f):
        def ask(inputs, *more):
            calls.note(f"{kind} {len(inputs)} {len(set(inputs))}")
            return [f(*(x if isinstance(x, tuple) else (x,)), *more) for x in inputs]

        return ask

    batched = T.Options(
        engine=many("engine", engine), quality=many("quality", lambda s, t: quality(s, [t])[0]), editor=many("editor", editor), back=many("back", B.same_text), similarity=many("similarity", B.word_overlap), batched=True, size=8,
    )
    want = {r.id: r for r in T.translate(df, "en2bn", single).select(*SHOWN).collect()}
    got = {r.id: r for r in T.translate(df, "en2bn", batched).select(*SHOWN).collect()}
    assert got == want
    assert got[1002].failures == ["nllb: RuntimeError: down"] and got[1000].error == "no candidates"
    asked = [x.split() for x in calls.read()]
    distinct = len({t for _, t in texts_of(60) if t})
    # eight at a time at most, each text once; the failing batch once more by halves
    assert all(int(n) <= 8 and n == d for _, n, d in asked)
    engines = sum(k == "engine" for k, *_ in asked)
    assert engines <= 3 * -(-distinct // 8) + 6
    fast = {r.id: r for r in T.translate(df, "en2bn", batched, fast_mode=True).select(*SHOWN).collect()}
    assert fast == {r.id: r for r in T.translate(df, "en2bn", single, fast_mode=True).select(*SHOWN).collect()}


def test_a_round_trip_that_fails_is_not_verified(spark):
    def back(text, engine, direction):
        if "two" in text:
            raise RuntimeError("down")
        return text

    df = spark.createDataFrame([(1, "one"), (2, "two")], "id long, text string")
    got = {r.id: r for r in T.translate(df, "en2bn", T.Options(back=back)).collect()}
    assert not got[1].low_confidence and got[2].low_confidence and got[2].roundtrip_similarity is None and got[2].translation == "two"


def test_each_mode_runs_once(spark, calls):
    pairs = spark.createDataFrame([(f"source {k} @a", f"the reference {k} @a") for k in range(30)], evaluate.PAIRS).repartition(3)

    def mode(d):
        def frames(parts):
            for b in parts:
                for s in b["source"]:
                    calls.note(s)
                yield b.assign(hypothesis=[f"{s} {uuid.uuid4().hex}" for s in b["source"]])

        return d.mapInPandas(frames, "source string, reference string, hypothesis string")

    report = evaluate.evaluate(pairs, {"sampling": mode}, model=lambda rows: [float(len(h)) for _, h, _ in rows])
    got = {r.metric: r.value for r in report.collect()}
    assert set(got) == {"bleu", "chrf", "ter", "pfs", "comet"} and calls.read() == sorted(f"source {k} @a" for k in range(30))
    assert got["pfs"] == 1.0


def test_pairs_keep_their_references(spark, tmp_path):
    """After a limit and an ordering, in every mode."""
    rows = spark.range(400).selectExpr("concat('text ', id) AS source", "concat('reference ', id) AS reference").repartition(7).orderBy(F.rand(3)).limit(150)
    for name, mode in evaluate.modes("en2bn", T.Options(engine=lambda t, e: [(t, "beam", 0.0)]), T.Options(engine=lambda t, e: [(f"{t} {e}", "beam", 0.0)], roundtrip_engine="banglat5")).items():
        got = E.run_modes(rows, {name: mode}).collect()
        assert len(got) == 150 and all(r.source.split()[1] == r.reference.split()[1] == r.hypothesis.split()[1] for r in got)
        assert all(r.hypothesis.endswith("banglat5") == (name == "baseline") for r in got)


def test_one_pass_gives_what_four_do(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").limit(40).select(F.substring("text", 1, 300).alias("reference"))
    h = d.selectExpr("concat(reference, ' @x') AS source", "regexp_replace(reference, '^[^ ]+ ', '') AS hypothesis", "reference", "if(length(reference) % 2 = 0, 'a', 'b') AS mode")
    got = {(r["mode"], r.metric): r.value for r in E.report(h).collect()}
    for name, each in (("bleu", M.bleu(M.bleu_counts(h, "hypothesis", "reference", "mode"))), ("chrf", M.chrf(M.chrf_counts(h, "hypothesis", "reference", "mode"))), ("ter", M.ter(h, "hypothesis", "reference", "mode"))):
        for r in each.collect():
            assert got[r["mode"], name] == pytest.approx(r[name])
    assert got["a", "pfs"] == 0.0


def test_images_are_read_once(spark, calls, tmp_path):
    def reader(content):
        calls.note(content.decode())
        return [(content.decode(), 0.9, [0, 0, 1, 1])]

    pages = [("p%d" % k, bytearray(f"{'good day' if k % 3 else 'আমি ভালো' if k % 2 else '12345'} {k}".encode())) for k in range(12)]
    df = spark.createDataFrame(pages, "path string, content binary").repartition(3)
    for _ in range(2):
        found = images.translate_images(df, images.ImageOptions({"mock": reader}), f"{tmp_path}/log", batch=4).collect()
    assert len(found) == 12 and len({r.path for r in found}) == 12
    assert all((r.translation is not None) == r.supported for r in found)
    assert len(calls.read()) == 24
    assert spark.read.json(f"{tmp_path}/log").count() == 12


def test_command_options(spark, tmp_path, capsys):
    commands.main(["translate", "en2bn", "u r gr8", "--roundtrip_engine", "banglat5", "--fast"], spark)
    assert "banglat5" in capsys.readouterr().out
    (tmp_path / "p.json").write_text('{"id": "1", "pair_type": "bn_en_translation", "text": "আমি", "parallel_text": "i am", "is_synthetic": false}\n')
    commands.main(["evaluate", "en2bn", f"{tmp_path}/p.json", f"{tmp_path}/out", "--baseline_engine", "indictrans2"], spark)
    assert "baseline" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        commands.parser().parse_args(["translate", "en2bn", "x", "--roundtrip_engine", "other"])


def test_the_editor_is_told_all_rules(spark):
    from banyan.functions import text as X

    said = spark.range(1).select(X.postedit_system(F.lit("Bengali"))).first()[0]
    assert "Bengali" in said and all(x in said for x in ("fluency", "meaning stays", "no information is added", "none is left out", "protected token", "nothing else"))


def test_batches_are_small_while_rows_are_stored(spark, tmp_path):
    from banyan.sources import storage

    sizes = tmp_path / "sizes"
    sizes.mkdir()

    def frames(parts):
        for b in parts:
            (sizes / uuid.uuid4().hex).write_text(str(len(b)))
            yield b

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    texts = spark.range(60).repartition(1).select(F.repeat(F.lit("x"), 1_000_000).alias("t"))
    assert storage.stored(texts.mapInPandas(frames, "t string"), "banyan-test").count() == 60
    found = [int(f.read_text()) for f in sizes.iterdir()]
    assert sum(found) == 60 and max(found) <= 9 and spark.conf.get(name) == before
    with pytest.raises(Exception):
        storage.stored(texts.select(F.raise_error(F.lit("no"))), "banyan-test")
    assert spark.conf.get(name) == before
