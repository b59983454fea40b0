"""The thin opN queries and their SQL, where SQL can say the same fast enough on whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, context_tree, digest, filter_audit, license_scan, packing, pieces, quality, repeats, secret_scan, simhash, toxicity, vector_codes
from .common import cut, table


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.harmonic_pack(table(spark, sf_dir, "documents"))


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ablations of every policy over all documents, from a ledger that is written once."""
    stored = cut(quality.ledger(table(spark, sf_dir, "documents")).select("doc_id", "fail_bits"))
    return reduce(DataFrame.unionByName, (quality.ablations(stored, p).withColumn("policy", F.lit(p)) for p in quality.POLICIES))


def op3_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


def op4_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.digests(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_licenses(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op8_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_report(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_harmonic_packing, op2_quality_ledger, quality_ablations, op3_context_tree_weighting, op4_canonical_digest, op5_secret_scan, op6_license_scan, op7_sentencepiece, op8_ftrl_toxicity, op9_simhash_vp_trees, op10_suffix_dedup, op11_filter_audit, op12_byte_bpe, op13_vector_codes)
}

#: Rounds of vector codes: distances d of each vector's parts p to the entries c, the least one a, and the entries after it.
def _nearest(p: str, c: str) -> str:
    return f"(SELECT k, part, any_value(x) AS x, min({{'d': d, 'e': e}}) AS m FROM (SELECT {p}.k, {p}.part, {p}.x, {c}.e, list_sum(list_transform(list_zip({p}.x, {c}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM {p} JOIN {c} USING (part)) GROUP BY k, part)"


def _moved(a: str, c: str) -> str:
    means = f"SELECT part, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (SELECT part, m.e AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM {a}, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY ALL) GROUP BY part, e"
    return f"(SELECT {c}.part, {c}.e, coalesce(z.x, {c}.x) AS x FROM {c} LEFT JOIN ({means}) z ON {c}.part = z.part AND {c}.e = z.e)"


_CODES = f"""
WITH v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS k, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
p AS MATERIALIZED (SELECT k, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS x FROM v, range(16) AS r(part)),
c0 AS MATERIALIZED (SELECT part, k - 1 AS e, x FROM p WHERE k <= 64),
a0 AS MATERIALIZED {_nearest('p', 'c0')}, c1 AS MATERIALIZED {_moved('a0', 'c0')},
a1 AS MATERIALIZED {_nearest('p', 'c1')}, c2 AS MATERIALIZED {_moved('a1', 'c1')},
a2 AS MATERIALIZED {_nearest('p', 'c2')},
g AS (SELECT k, string_agg(lpad(to_hex(m.e), 2, '0'), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a2 GROUP BY k),
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM g JOIN v USING (k), s
"""

#: Filters by documents, counts by mask, all orders; prior: the filters before a step.
_AUDIT = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS ws FROM documents),
f AS (SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (SELECT concat(a, b, c, d, e) AS filter_order FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t1(a), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t2(b), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t3(c), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t4(d), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t5(e)
  WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS letter, 1 << (ascii(filter_order[step]) - 65) AS bit, list_sum(list_transform(range(0, step), lambda i: CASE WHEN i = 0 THEN 0 ELSE 1 << (ascii(filter_order[i]) - 65) END))::INT AS prior FROM o, range(1, 6) AS r(step)),
r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (mask & (prior | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & prior = 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & prior <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails, coalesce(sum(g) FILTER (mask & bit <> 0 AND mask & prior = 0), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (mask & bit <> 0 AND mask & prior = 0), 0)::BIGINT AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""

#: The ledger of all documents, b.
_LEDGER = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS g FROM w, unnest(range(1, len(words) - 6)) AS r(i)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 8)) AS r(k) GROUP BY doc_id),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        len(lines) AS n_lines
      FROM w LEFT JOIN covered c USING (doc_id)),
b AS (SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 4 ELSE 0 END)
        + (CASE WHEN 10 * n_symbols > n_words THEN 8 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 16 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
"""
_RULES = ", ".join(f"({r.bit}, '{r.name}')" for r in quality.RULES)
_POLICIES = ", ".join(f"('{p}', {quality.mask(p)})" for p in quality.POLICIES)

ORACLES: dict[str, str] = {
    "op11_filter_audit": _AUDIT,
    "op13_vector_codes": _CODES,
    "op2_quality_ledger": _LEDGER + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 15) = 0 AS kept, fail_bits FROM b",
    "quality_ablations": _LEDGER
    + f", r(bit, rule) AS (VALUES {_RULES}), p(policy, m) AS (VALUES {_POLICIES}) SELECT policy, rule, count(*) FILTER (fail_bits >> bit & 1 = 1) AS failed, count(*) FILTER (fail_bits & m = 1 << bit) AS only, count(*) FILTER (fail_bits & m & ~(1 << bit) = 0) AS kept_without FROM b, r, p WHERE m >> bit & 1 = 1 GROUP BY policy, rule",
    # windows as hexadecimal text, told by their MD5
    "op10_suffix_dedup": """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, length(h) // 2 AS n_bytes FROM d),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS g FROM n, unnest(range(0, n_bytes - 199)) AS t(i)),
twice AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
hit AS (SELECT r, i FROM w SEMI JOIN twice USING (g)),
fresh AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM hit),
runs AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM fresh) GROUP BY r, k),
of AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM runs GROUP BY r)
SELECT doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(starts) + 1), lambda k: substr(h, 2 * coalesce(ends[k], 0) + 1, 2 * (coalesce(starts[k + 1], n_bytes) - coalesce(ends[k], 0)))), '') END)) AS kept_sha256
FROM n LEFT JOIN of USING (r)
""",
}
