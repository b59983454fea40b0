import hashlib
import random
from collections import Counter

import numpy as np
from cases import frame, rows

from banyan.llm import common, repeats


def brute(texts, length):
    """Sorted runs to remove of each."""
    seen = Counter(x[i : i + length] for x in texts for i in range(len(x) - length + 1))
    out = []
    for x in texts:
        runs = []
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], i + length)
                else:
                    runs.append((i, i + length))
        out.append(runs)
    return out


def report_rows(data, length):
    texts = [(t or "").encode() for _, t, *_ in data]
    for (i, *_), x, runs in zip(data, texts, brute(texts, length), strict=True):
        kept = x
        for a, b in reversed(runs):
            kept = kept[:a] + kept[b:]
        yield i, len(x), len(x) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()


def test_anchors_agree_for_equal_windows():
    r = random.Random(3)
    x = bytes(r.choice(b"ab ") for _ in range(3000)) + b"a" * 400
    h, place, first, last = repeats.anchors(np.frombuffer(x, np.uint8), 200)
    assert first[0] == 0 and last[-1] == len(x) - 200 and (first[1:] == last[:-1] + 1).all()
    of = {}
    for i in range(len(h)):
        for s in range(first[i], last[i] + 1):
            assert of.setdefault(x[s : s + 200], (h[i], place[i] - s)) == (h[i], place[i] - s)


def test_columns_against_brute_force():
    r = random.Random(4)
    for _ in range(60):
        length, groups, offsets, segs = 6, [], [], []
        for g in range(r.randint(1, 4)):
            core = bytes(r.choice(b"abc") for _ in range(12))
            for _ in range(r.randint(1, 9)):
                a, b = r.randint(0, 5), r.randint(7, 12)
                s = bytearray(core[a:b])
                for _ in range(r.randint(0, 2)):
                    s[r.randrange(len(s))] = r.choice(b"abc")
                if len(s) >= length:
                    groups.append(g), offsets.append(6 - a), segs.append(bytes(s))
        if not segs:
            continue
        seen = Counter((g, i - o, s[i : i + length]) for g, o, s in zip(groups, offsets, segs, strict=True) for i in range(len(s) - length + 1))
        want = [{i for i in range(len(s) - length + 1) if seen[g, i - o, s[i : i + length]] > 1} for g, o, s in zip(groups, offsets, segs, strict=True)]
        got = repeats.repeated_columns(np.array(groups), np.array(offsets), segs, length)
        assert [{i for a, b in runs for i in range(a, b + 1)} for runs in got] == want


def test_report(spark):
    data = rows()
    for length in (200, 64):
        got = repeats.removal_report(frame(spark), length).collect()
        assert Counter(map(tuple, got)) == Counter(report_rows(data, length))
    assert repeats.removal_report(frame(spark, [])).collect() == []


def test_report_on_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = Counter(report_rows([(x.doc_id, x.text) for x in docs.collect()], 200))
    assert Counter(map(tuple, repeats.removal_report(docs).collect())) == want


def test_hot_anchors_split(spark, monkeypatch):
    """One phrase stands in hundreds of different contexts, some of which repeat in part: its group is split down to single windows."""
    monkeypatch.setattr(repeats, "HOT_BYTES", 600)
    monkeypatch.setattr(common, "SHARE", 16)
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    phrase, before, after = word(40), word(150), word(150)
    data = []
    for k in range(150):
        left = before[-r.randint(0, 150) :] if k % 3 == 0 else ""
        right = after[: r.randint(0, 150)] if k % 4 == 0 else ""
        data.append((k, word(r.randint(0, 200)) + left + phrase + right + word(r.randint(0, 200)), "en", "s", 1))
    data += [(900 + k, data[3 * k][1], "en", "s", 1) for k in range(5)] + [(None, data[9][1], "en", "s", 1)] * 30
    levels = []
    halves = repeats._halves
    monkeypatch.setattr(repeats, "_halves", lambda pieces, length: levels.append(1) or halves(pieces, length))
    for length in (100, 64):
        got = repeats.removal_report(frame(spark, data), length).collect()
        assert Counter(map(tuple, got)) == Counter(report_rows(data, length))
    assert len(levels) > 4


def test_remove_keeps_columns_and_characters(spark):
    df = frame(spark)
    out = repeats.remove_repeats(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert out.where("text is null").count() == 1
    assert repeats.without("aéb", [(1, 2)]) == "aéb" and repeats.without("aéb", [(1, 3)]) == "ab" and repeats.without("aéb", [(2, 4)]) == "aé"
