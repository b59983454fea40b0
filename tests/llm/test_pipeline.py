"""Every stage of the pipeline against brute force, each on what the one before kept."""

import random
from collections import Counter

import pytest
from cases import frame, rows
from test_packing import held
from test_quality import brute as quality
from test_repeats import brute as repeated
from test_simhash import brute_components, brute_fingerprint

import corpus_pipeline as p
from banyan.llm import common, repeats, secret_scan

STAGES = dict(p.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    data = rows() + [(300 + i, f"password = hunter{i}xyz and some more words so that the text is long enough to stay where it is in the table after the rules of it {i}", "en", "s", 1) for i in range(3)]
    data += [(None, data[-1][1].replace("password", "other"), "en", "s", 1)] * 2
    return frame(spark, data, clash=False)


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_each_stage(spark, docs):
    kept = STAGES["quality_rules"](spark, docs, "")
    assert kept.columns == list(p.COLUMNS)
    want = Counter({k: n for k, n in pairs(docs).items() if not quality(k[1])[-1] & 15})
    assert pairs(kept) == want

    single = STAGES["near_dedup"](spark, kept, "").cache()
    assert single.columns == list(p.COLUMNS)
    data = list(want.elements())
    roots = brute_components([brute_fingerprint(t) for _, t in data])
    groups = {}
    for row, r in zip(data, roots, strict=True):
        groups.setdefault(r, []).append(row)
    got = single.collect()
    # one row of each component: of least doc_id where there is one
    root_of = {row: r for row, r in zip(data, roots, strict=True)}
    assert sorted(root_of[x.doc_id, x.text] for x in got) == sorted(groups)
    for x in got:
        named = [i for i, _ in groups[root_of[x.doc_id, x.text]] if i is not None]
        assert x.doc_id == min(named, default=None)
    assert any(x.doc_id is None for x in got) and sum(i is None for i, _ in data) > sum(x.doc_id is None for x in got)

    data = [(x.doc_id, x.text) for x in got]
    cut = STAGES["repeated_passages"](spark, single, "").cache()
    assert cut.columns == list(p.COLUMNS)
    want = Counter((i, repeats.without(t, runs)) for (i, t), runs in zip(data, repeated([t.encode() for _, t in data], 200), strict=True))
    assert pairs(cut) == want and sum(len(t) for _, t in want.elements()) < sum(len(t) for _, t in data)

    clean = STAGES["secrets"](spark, cut, "").cache()
    scan = secret_scan.Scanner()
    want = Counter((i, secret_scan.mask(t, scan(t))) for i, t in want.elements())
    assert pairs(clean) == want and any("[SECRET]" in t for _, t in want)
    assert all(r.n_chars == len(r.text) for r in clean.collect())

    held(STAGES["packing"](spark, clean, "").collect(), list(want.elements()), 1024)


def test_near_dedup_keeps_a_row_of_each_component(spark):
    r = random.Random(1)
    long = [" ".join(f"w{r.randint(0, 10**6)}" for _ in range(400)) for _ in range(5)]
    a, b, c, d, e = long
    near = next(x for k in range(400) if (x := f"{' '.join(e.split()[:k])} changed {' '.join(e.split()[k + 1:])}") and 0 < (brute_fingerprint(x) ^ brute_fingerprint(e)).bit_count() <= 3)
    data = [(5, a), (5, b), (13, c), (15, c), (15, d), (None, e), (None, near), (None, e), (None, c), (7, "Some other words: " + c)]
    got = pairs(STAGES["near_dedup"](spark, frame(spark, [(i, t, "en", "s", len(t)) for i, t in data], clash=False), ""))
    unnamed = [(i, t) for i, t in got.elements() if i is None]
    # the row without doc_id that is a copy of document 13 goes; the two others, near copies, leave one
    assert len(unnamed) == 1 and unnamed[0][1] in (e, near)
    linked = (brute_fingerprint(data[-1][1]) ^ brute_fingerprint(c)).bit_count() <= 3
    assert got - Counter(unnamed) == Counter([(5, a), (5, b), (15, d), data[-1]] + [(13, c)] * (not linked))


def test_empty(spark):
    df = frame(spark, [], clash=False)
    for _, stage in p.STAGES:
        assert stage(spark, df, "").count() == 0


def test_run(spark, sf):
    out = p.run(spark, sf)
    assert out.count() > 0 and "sequence_id" in out.columns
    # of all tables that the stages wrote, the last stage's input is left
    before = set(common._CUTS)
    p.run(spark, sf)
    assert len(set(common._CUTS) - before) == 1
