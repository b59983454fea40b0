import re
from collections import Counter

from cases import frame, rows
from pyspark.sql import functions as F

from banyan.llm import quality
from banyan.llm.queries import QUERIES, op2_quality_ledger


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 8)}
    n = len(words)
    chars, symbols, dup = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    bits = (n < 20) + 2 * (100 * len(covered) > 30 * n) + 4 * (chars < 2 * n or chars > 20 * n) + 8 * (10 * symbols > n) + 16 * (10 * dup > 3 * len(lines))
    return n, chars, symbols, len(lines), dup, len(covered), bits


EXTRA = [(900, "a b c d e f g h " * 6), (901, "x " * 400), (902, "one line\none line\n\n \nother\n" * 9), (903, "#$% a" * 40), (904, "w" * 5000 + " a" * 30)]


def test_ledger(spark):
    data = rows() + [(i, t, "en", "s", len(t)) for i, t in EXTRA]
    got = quality.ledger(frame(spark, data)).collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute(t)) for i, t, *_ in data)
    assert quality.ledger(frame(spark, [])).collect() == []


def test_policies_and_ablations(spark):
    led = quality.ledger(frame(spark, rows() + [(i, t, "en", "s", len(t)) for i, t in EXTRA])).cache()
    for policy, names in quality.POLICIES.items():
        kept = quality.apply_policy(led, policy).where("kept").count()
        for r in quality.ablations(led, policy).collect():
            m = quality.mask(tuple(x for x in names if x != r.rule))
            assert r.kept_without == led.where(f"fail_bits & {m} = 0").count() == kept + r.only
    assert quality.ablations(led.limit(0)).count() == 4


def test_keep_returns_rows_whole(spark):
    df = frame(spark)
    out = quality.keep(df)
    assert out.columns == df.columns
    assert Counter(out.select("doc_id", "text").collect()) == Counter(r for r in df.select("doc_id", "text").collect() if not brute(r.text)[-1] & 15)


def test_native(spark, sf):
    plan = op2_quality_ledger(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_equal_hashes_of_different_windows(spark, monkeypatch):
    """With a hash that tells nothing apart, words decide."""
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: F.lit(7).cast("long") + 0 * F.length(F.coalesce(c[0].cast("string"), F.lit(""))))
    data = [(i, t, "en", "s", 1) for i, t in EXTRA[:3]] + rows()[:12]
    got = quality.ledger(frame(spark, data)).collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute(t)) for i, t, *_ in data)


def test_ablations_of_the_whole_table(spark, sf):
    bits = [brute(x.text)[-1] for x in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    want = set()
    for policy in quality.POLICIES:
        m = quality.mask(policy)
        for r in quality.RULES:
            if m >> r.bit & 1:
                b = 1 << r.bit
                want.add((r.name, sum(x & b > 0 for x in bits), sum(x & m == b for x in bits), sum(x & m & ~b == 0 for x in bits), policy))
    assert set(map(tuple, QUERIES["quality_ablations"](spark, sf).collect())) == want
