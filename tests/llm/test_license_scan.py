import random
import re
import time
from collections import Counter

from cases import frame, rows

from banyan.llm import license_scan as s

TEXTS = ["Released under the MIT License. GNU General-Public license! CC BY", "cc by by cc by", "Licenced undr the Apach License version 2.0 x", "permision is hereby granted free of charge to any persn obtaining a copie", "mit licensed", "zzmit license", "gnu generall public licence"]


def base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for phrase, label in s.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_base_columns(spark):
    data = rows() + [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)]
    got = s.find_licenses(frame(spark, data)).collect()
    assert Counter(tuple(x)[:6] for x in got) == Counter((i, *base(t or "")) for i, t, *_ in data)
    by = {x.doc_id: x for x in got}
    assert all(set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1 for x in got)
    assert by[102].base_labels == "" and by[102].labels == "apache" and 0.9 < by[102].score < 1
    assert by[103].labels == "mit" and by[106].labels == "gpl"
    assert by[5].labels == "" and by[5].score == 0.0
    assert s.find_licenses(frame(spark, [])).collect() == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_seeds_lose_no_match():
    r, search = random.Random(7), s.Searcher()
    for n in s.NOTICES:
        for _ in range(20):
            t = list(n.text)
            for _ in range(r.randint(0, n.errors)):
                i = r.randrange(len(t))
                t[i] = r.choice(["", "q", t[i] + "q"])
            near = "".join(t)
            if distance(near, n.text) <= n.errors and near == " ".join(near.split()):
                found = search(f"word {near} word".encode())
                assert any(x[3] is n for x in found), (n, near)


def spans_of(line, n):
    """All (start, end, edits) of word-bounded parts of line within n's errors, by whole edit distances."""
    starts = [0] + [i + 1 for i, c in enumerate(line) if c == " "]
    ends = [i for i, c in enumerate(line) if c == " "] + [len(line)]
    for a in starts:
        for b in ends:
            if abs(b - a - len(n.text)) <= n.errors and (d := distance(line[a:b], n.text)) <= n.errors:
                yield a, b, d


def test_spans_edits_and_score_against_brute_force(spark):
    r, lines = random.Random(21), []
    letters = "abcdefghilmnoprstu"
    for _ in range(150):
        parts = []
        for _ in range(r.randint(1, 5)):
            t = list(r.choice(s.NOTICES).text)
            for _ in range(r.randint(0, 5)):
                i = r.randrange(len(t))
                t[i] = r.choice(["", r.choice(letters), t[i] + r.choice(letters), t[i] + " ", " "])
            parts.append("".join(t))
            parts += ["".join(r.choice(letters) for _ in range(r.randint(1, 5))) for _ in range(r.choice([0, 0, 1, 3]))]
        lines.append(" ".join(" ".join(parts).split()))
    search, n_found = s.Searcher(), 0
    best = {}
    for k, line in enumerate(lines):
        found = search(line.encode())
        near = []
        for n in s.NOTICES:
            got = sorted((a, b, e) for a, b, e, m in found if m is n)
            every = set(spans_of(line, n))
            # each is a span with its true distance, none overlap, and whatever is left out overlaps one that is as good
            assert set(got) <= every, (line, n)
            assert all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))
            for a, b, e in every:
                assert any(x < b and a < y and d <= e for x, y, d in got), (line, n, (a, b, e), got)
            near += [1 - e / len(n.text) for *_, e in got]
            n_found += len(got)
        best[k] = 1.0 if base(line)[1] else max(near, default=0.0)
    assert n_found > 200
    got = s.find_licenses(frame(spark, [(k, line, "en", "s", 1) for k, line in enumerate(lines)])).collect()
    assert {x.doc_id: x.score for x in got} == best


def test_dense_and_unbroken_texts_take_linear_time():
    search = s.Searcher()
    began = time.time()
    dense = " ".join(n.text for n in s.NOTICES)
    assert len(search(" ".join([dense] * 200).encode())) >= 200 * len(s.NOTICES)
    search(("gnugeneralpubliclicense" * 20_000).encode())
    search(("mit " * 100_000).encode())
    search("permission is hereby granted frea of chargx ".encode() * 2000)
    assert time.time() - began < 60
