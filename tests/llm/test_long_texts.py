"""Operators over texts far longer than others, which have no such case in their own tests, and stages over clashing columns."""

from collections import Counter

import pytest
from cases import frame, rows

import corpus_pipeline
from banyan.llm import context_tree, digest, quality, repeats, simhash, toxicity

LONG = " ".join(f"w{(k * 7919) % 5003}" for k in range(60_000))


def data():
    return [(1, LONG, "en", "s", 1), (2, LONG, "en", "s", 1), (3, LONG + " more", "en", "s", 1), (4, "x" * 400_000, "en", "s", 1), (5, "short", "en", "s", 1), (6, None, "en", "s", 1)]


def test_quality(spark):
    got = {r.doc_id: r for r in quality.apply_policy(quality.ledger(frame(spark, data()))).collect()}
    assert got[1].n_words == 60_000 and got[1].word_chars == len(LONG.replace(" ", "")) and got[4].n_words == 1 and got[4].base_failed
    # every window of eight words is there again 5003 words later
    assert got[1].n_repeat_words == 60_000 and got[1].base_failed and got[6].n_words == 0


def test_digests(spark):
    got = {r.doc_id: r for r in digest.digests(frame(spark, data())).collect()}
    assert got[1].fingerprint == got[2].fingerprint != got[3].fingerprint and got[1].n_chars == len(LONG) and got[4].n_chars == 400_000


def test_near_duplicates(spark):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, data())).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[4] == 4


def test_repeats(spark):
    some = [(1, LONG[:3000] + "z" * 150_000, "en", "s", 1), (2, "y" + LONG[:3000], "en", "s", 1), (3, LONG[5000:6000], "en", "s", 1)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.removal_report(frame(spark, some)).collect()}
    assert got[1] == (153_000, 153_000, 1) and got[2][1] == 3000 and got[3] == (1000, 0, 0)


def test_context_tree(spark):
    got = {r.doc_id: r for r in context_tree.score(frame(spark, data()), 3).collect()}
    assert got[1].n_tokens == 60_001 and got[1].score == got[2].score and got[6].n_tokens == 1
    # what training has seen many times costs little
    assert 0 < got[4].bits_per_byte < 0.01


def test_toxicity(spark):
    docs = data() + [(10 + k, f"{'vile' if k % 2 else 'kind'} words {k}", "en", "s", 1) for k in range(60)]
    labels = spark.createDataFrame([(10 + k, 1, k % 2) for k in range(60)] + [(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(frame(spark, docs), labels).collect()}
    assert len(got) == len(docs) and all(0 <= x <= 1 for x in got.values()) and got[1] == got[2]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_over_clashing_columns(spark, stage):
    """Further columns of the operators' own names change nothing."""
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = rows()
    plain, clash = (run(spark, frame(spark, docs, c).coalesce(1), "") for c in (False, True))
    shown = [c for c in plain.columns if c not in ("sequence_id",)]
    assert plain.columns == clash.columns
    assert Counter(map(str, plain.select(*shown).collect())) == Counter(map(str, clash.select(*shown).collect()))
