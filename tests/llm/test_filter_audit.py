"""The audit against a walk over every document and order."""

import re
from collections import Counter
from itertools import permutations

import cases
import pytest

from banyan.llm import filter_audit

SHOWN = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(docs):
    """doc_id, part and the letters that each document fails."""
    before = lambda a, b: a is not None and (b is None or a < b)
    for doc_id, text, lang, *_ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": any(before(o[0], doc_id) and (o[1] or "") == t for o in docs),
        }
        yield doc_id, lang or "", {k for k, v in own.items() if v}


def walked(docs, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    rows, out, shares = list(fails(docs)), [], Counter()
    for part in {p for _, p, _ in rows}:
        for order in permutations("ABCDE"):
            left = [(i, f) for i, p, f in rows if p == part]
            every = left
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                failing = sum(letter in f for _, f in every)
                out.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(f == {letter} for _, f in every), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
                shares[part, letter] += len(gone)
    return sorted((*r, shares[r[0], r[1][r[2] - 1]]) for r in out)


def audited(spark, docs, labels, clash=True):
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in filter_audit.audit(cases.frame(spark, docs, clash), known).select(*SHOWN).collect())


LABELS = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (6, None, 1), (999, 1, 1)]


def test_against_a_walk(spark):
    docs = cases.rows()
    docs += [(200 + k, docs[7][1], ("en", "de", None, "")[k % 4], "s", 1) for k in range(9)] + [(5, docs[5][1], "en", "s", 1), (5, docs[5][1], "fr", "s", 1), (None, docs[9][1], "de", "s", 1), (None, None, None, None, None)]
    docs += [(300, "Ab $ " * 250, "en", "s", 1), (301, "a b c " * 100, "en", "s", 1), (302, " ".join(f"w{i}" for i in range(300)), "es", "s", 1)]
    assert audited(spark, docs, LABELS) == walked(docs, LABELS)


@pytest.mark.parametrize("held", [1, 2000])
def test_chains_that_are_passed_on_early(spark, monkeypatch, held):
    monkeypatch.setattr(filter_audit, "HELD", held)
    monkeypatch.setattr(filter_audit, "ROUTED", 3000)
    docs = [(k, f"text {k % 7}", "en", "s", 1) for k in range(60)] + [(k, "one text of a third", "de", "s", 1) for k in range(100, 160)]
    assert audited(spark, docs, LABELS) == walked(docs, LABELS)


def test_equal_hashes_are_told_apart(spark):
    chains = filter_audit.Chains()
    out = []
    for doc_id, text in ((5, b"a"), (3, b"b"), (4, b"a"), (4, b"a"), (None, b"b"), (9, b"a"), (2, b"b")):
        out += chains.add(1, text, 0, doc_id, Counter({"en": 1}))
    assert sorted(out, key=str) == sorted([(5, "en", 16, 1), (None, "en", 16, 1), (9, "en", 16, 1), (3, "en", 16, 1)], key=str)
    assert sorted((c[1], c[3], c[4]["en"]) for c in chains) == [(b"a", 4, 2), (b"b", 2, 1)]


def test_repeats_and_empty_tables(spark):
    docs = [(3, "x", "en", "s", 1), (1, "x", "en", "s", 1), (2, None, "en", "s", 1), (4, "", "de", "s", 1), (4, "", "de", "s", 1), (5, "y" * 2_000_000, "en", "s", 1), (6, "y" * 2_000_000, "en", "s", 1)]
    got = {(r.doc_id, r.n) for r in filter_audit.exact_repeats(cases.frame(spark, docs)).collect()}
    assert got == {(3, 1), (4, 2), (6, 1)}
    assert audited(spark, [], LABELS, clash=False) == []
    assert audited(spark, docs, []) == walked(docs, [])


def test_a_task_passes_on_one_row_of_a_text(spark):
    """Of a text with many copies the reading side sends one that may be the first; the others go without their text."""
    rows = list(filter_audit._read((k, "en", b"copy " * 300) for k in range(500)))
    whole = [r for _, r in rows if isinstance(r[0], bytes)]
    assert len(whole) == 1 and whole[0][2] == 0 and len(rows) == 500
    assert len({k for k, _ in rows}) == 500
