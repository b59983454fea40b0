"""Rule bitmask ledger: quality rules as DataFrame expressions only.

``measure`` computes every measurement of a text once; ``ledger`` evaluates
every rule once and stores the failures as bits of one long beside the
measurements.  A policy is a versioned bit mask: a document is kept if it fails
no rule of the mask.  So a new policy, or an ablation (what a policy would keep
without one rule), needs only bitwise work on the stored bits.

Null texts count as empty: no words, no lines, every count zero, and ratios
null, which fail no rule by themselves (``few_words`` fails).  Every row is
judged by itself: repeated rows and ties get equal bits, an empty table gives
no rows, and the input's other columns are never read.  Repeated windows of
eight words are sought by hash within one text, and those whose hashes agree are
compared by their words.  A very long text is one row, whose words and windows
one task holds at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """bit: place in the ledger, never used for another rule; fails: SQL over the measurements."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule(3, "symbols", "10 * n_symbols > n_words"),
    Rule(4, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
)

#: Policies by version; the first two rules are the base of all.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "word_length", "symbols"),
    "v2": ("few_words", "repeated_windows", "word_length", "symbols", "repeated_lines"),
}
CURRENT = "v1"


def mask(policy: str | tuple[str, ...]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[x] for x in set(names))


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once a row: an expression named inside a lambda would run again for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _beside(s: Column, key: str) -> Column:
    """Of sorted structs those whose key stands beside an equal one."""
    return F.filter(s, lambda x, j: ((j > 0) & (x[key] == F.get(s, j - 1)[key])) | (x[key] == F.get(s, j + 1)[key]))


def _repeat_words(hashes: Column, words: Column) -> Column:
    """Words covered by windows that occur twice or more, from the windows' hashes in order. Windows whose hashes agree are compared by their words."""
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    likely = _bind(F.array_sort(pairs), lambda s: _beside(s, "h"))
    # words have no spaces, so joined windows are equal only if all words are
    spelled = F.transform(likely, lambda x: F.struct(F.array_join(F.slice(words, x["i"] + 1, F.lit(WINDOW)), " ").alias("w"), x["i"].alias("i")))
    places = _bind(F.array_sort(spelled), lambda s: F.array_sort(F.transform(_beside(s, "w"), lambda x: x["i"])))
    return F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("n"), i.alias("at")),
        lambda acc: acc["n"],
    )


def measure(docs: DataFrame, *keep: Column) -> DataFrame:
    """doc_id and the measurements, after the columns to keep, whose names start with _keep."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # a separator at either end splits off an empty word
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    split = docs.select(*keep, F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"), words.alias("_words"), lines.alias("_lines"))
    own = [c for c in split.columns if c.startswith("_keep")]
    hashed = split.select(
        *own,
        "doc_id",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    each = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    windows = F.when(F.col("n_words") >= WINDOW, _bind(F.col("_hashes"), each)).otherwise(F.array().cast("array<bigint>"))
    counted = hashed.withColumn("_windows", windows)
    repeats = F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0).cast("long")).otherwise(_repeat_words(F.col("_windows"), F.col("_words")))
    return counted.select(*own, "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeats.alias("n_repeat_words"))


def ledger(docs: DataFrame, *keep: Column) -> DataFrame:
    """Measurements and fail_bits of every document; keep as in measure."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, *keep).withColumn("fail_bits", total)


def apply_policy(ledger_df: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds base_failed, kept and policy."""
    fails = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")) != 0
    return ledger_df.withColumns({"base_failed": fails(mask("base")), "kept": ~fails(mask("base") | mask(policy)), "policy": F.lit(policy)})


def keep(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of docs, all columns, that the policy keeps."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_keep_row")
    # a filter moves below deterministic columns and would compute the measurements a second time, rule by rule
    marked = ledger(docs, row).withColumn("_mark", F.monotonically_increasing_id())
    return apply_policy(marked, policy).where("kept AND _mark >= 0").select("_keep_row.*")


def ablations(ledger_df: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: failed (documents that fail it), only (that fail nothing else of the policy), and kept_without."""
    m = mask(policy)
    seen = ledger_df.select(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    hit = lambda bit: F.col("b").bitwiseAND(F.lit(1 << bit).cast("long")) != 0
    rules = [r for r in RULES if m >> r.bit & 1]
    sums = [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(f"{k}{r.bit}") for r in rules for k, c in (("f", hit(r.bit)), ("o", F.col("b") == 1 << r.bit))]
    kept = F.coalesce(F.sum(F.when(F.col("b") == 0, F.col("n"))), F.lit(0)).alias("kept")
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("failed"), F.col(f"o{r.bit}").alias("only"), (F.col("kept") + F.col(f"o{r.bit}")).alias("kept_without")) for r in rules])
    return seen.agg(kept, *sums).select(F.inline(rows))
