import hashlib
from collections import Counter

import xxhash
from cases import frame, rows
from pyspark.sql import functions as F

from banyan.llm import digest


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute(data):
    """Rows in the order of doc_id, then of the text's hash; and groups by the canonical form itself."""
    order = sorted(((-(2**63) if i is None else i, signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), t or "", i) for i, t, *_ in data), key=lambda x: x[:2])
    size, least = Counter(), {}
    for _, _, t, i in order:
        f = digest.canonical(t)
        size[f] += 1
        if i is not None:
            least[f] = min(least.get(f, i), i)
    for k, (_, _, text, i) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        f = [digest.canonical(x) for x in (text, changed, after)]
        yield i, len(text), hashlib.sha256(changed.encode()).hexdigest(), digest.fingerprint(f[0]), digest.fingerprint(f[1]), float(f[0] == f[1]), float(f[0] == f[2]), least.get(f[0]), size[f[0]]


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id", "group_size")


def result(df):
    return Counter(map(tuple, df.select(*COLUMNS).collect()))


def test_digests(spark, monkeypatch):
    # one doc_id, and one text, of a third of all rows
    hot = rows() + [(None, rows()[7][1], "en", "s", 1)] * 12 + [(4, f"text {k % 9}", "en", "s", 1) for k in range(20)]
    want = Counter(brute(hot))
    assert result(digest.digests(frame(spark, hot))) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "90")
    try:
        df = digest.edited_pairs(frame(spark, hot))
        assert result(digest.digests(frame(spark, hot))) == want
        # nearly every text may have a repeated fingerprint
        monkeypatch.setattr(digest, "DIGITS", 1)
        assert result(digest.digests(frame(spark, hot))) == want
        assert df.count() == len(hot)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert digest.digests(frame(spark, [])).collect() == []
    one = [(5, "Abcd", "en", "s", 4)]
    assert result(digest.digests(frame(spark, one))) == Counter(brute(one))


def test_canonical():
    for a, b in [("Straße", "STRASSE"), ("ﬁne  \n x", " Fine X "), ("é", "É"), ("Å", "Å")]:
        assert digest.canonical(a) == digest.canonical(b)
    assert digest.canonical("ab c") != digest.canonical("abc")


def test_groups_compare_bytes(spark, monkeypatch):
    """Where fingerprints agree by accident, the forms' bytes keep texts apart."""
    monkeypatch.setattr(digest, "fingerprint", lambda form: "same")
    data = [(1, "a"), (2, "A "), (3, "b"), (4, "c"), (5, "B"), (None, "b")]
    df = frame(spark, [(i, t, "en", "s", 1) for i, t in data])
    forms = {i: digest.canonical(t) for i, t in data}
    found = spark.createDataFrame([(i, "same", hashlib.sha256(f.encode()).hexdigest()) for i, f in forms.items()], "doc_id long, fingerprint string, form string")
    same = df.select("doc_id", F.lit("same").alias("fingerprint"), F.lower(F.trim("text")).alias("canonical"))
    monkeypatch.setattr(digest, "canonical_forms", lambda docs, some: same)
    got = {x.doc_id: (x.group_id, x.group_size) for x in digest.canonical_groups(df, found).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 3), 4: (4, 1), 5: (3, 3), None: (3, 3)}
    assert digest.likeness(("a", "x"), ("b", "x")) == 0.0


def test_only_texts_that_may_repeat_are_compared(spark):
    data = [(k, f"text {k}", "en", "s", 1) for k in range(300)] + [(1000, "TEXT  7", "en", "s", 1)]
    found = digest.edited_pairs(frame(spark, data)).select("doc_id", "fingerprint", "form")
    seen = []
    own = digest.canonical_forms
    digest.canonical_forms = lambda docs, some: seen.append(own(docs, some)) or seen[-1]
    try:
        got = {r.doc_id: r.group_size for r in digest.canonical_groups(frame(spark, data), found).collect()}
    finally:
        digest.canonical_forms = own
    assert {k for k, n in got.items() if n > 1} == {7, 1000} and len(got) == 301
    # two, and by chance one whose fingerprint starts alike
    assert seen[0].count() <= 4
