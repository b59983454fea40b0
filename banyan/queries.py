"""The registered queries over the driver's tables, each beside its SQL.

The tables' texts hold no hashtags, Bengali letters or emoji, so text queries
run over whole texts with such tokens added at the end, in the same way on both
sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import patterns as P
from .functions import scores as S
from .functions import tables as T
from .functions import text as X
from .operators import batches as B
from .operators import corpus as C
from .operators import embedding as E
from .operators import language as L
from .operators import metrics as M
from .operators import ranking as R
from .operators import segmentation as G
from .operators import shards as H
from .operators.numbering import by_number
from .plans.translate import translate
from .sources.storage import fresh, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_TAIL = (
    "concat(' #TopicTag', CAST(doc_id % 7 AS {s}), ' @user', CAST(doc_id % 5 AS {s}), CASE WHEN doc_id % 3 = 0 THEN concat(' https://t.co/', CAST(doc_id AS {s})) ELSE '' END, "
    "CASE doc_id % 4 WHEN 0 THEN ' আমি ভালো আছি ১২' WHEN 1 THEN ' 😍🔥 u r gr8' WHEN 2 THEN ' Pls <unk> THX  ki kori' ELSE ' ami bhalo' END)"
)
_W = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
_EMO = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
#: The decorated table, for SQL.
_D = f"d AS (SELECT doc_id, lang, source, concat(text, {_TAIL.format(s='VARCHAR')}) AS t FROM documents)"
_TOK = (
    f"list_transform(regexp_extract_all({{c}}, 'https?://\\S+|www\\.\\S+|#{_W}+|@{_W}+|{_EMO}|{_W}+|[^\\s]'), lambda x: {{{{'token': x, 'kind': CASE WHEN regexp_matches(x, '^(https?://|www\\.).') THEN 'url' "
    f"WHEN regexp_matches(x, '^{_EMO}$') THEN 'emoji' WHEN x[1] = '#' AND length(x) > 1 THEN 'hashtag' WHEN x[1] = '@' AND length(x) > 1 THEN 'mention' WHEN regexp_matches(x, '^{_W}') THEN 'word' ELSE 'punct' END}}}})"
)


def tok(c: str) -> str:
    return _TOK.replace("{c}", c).replace("{{", "{").replace("}}", "}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decorated(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", *more, F.expr(f"concat(text, {_TAIL.format(s='STRING')})").alias("t"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def sql_map(d: dict[str, str]) -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in d.items()) + "}"


_VALID = "text IS NOT NULL AND regexp_replace(text, '\\s', '', 'g') <> '' AND lower(text) <> 'nan'"
_TRIM = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_MD5 = "md5(concat('42|', CAST({c} AS VARCHAR)))"
_DEDUPED = f"e AS (SELECT * FROM documents WHERE {_VALID} QUALIFY row_number() OVER (PARTITION BY {_TRIM} ORDER BY doc_id) = 1)"
_SPLIT = "CASE WHEN rn <= floor(n * CAST(0.85 AS DOUBLE)) THEN 'train' WHEN rn <= floor(n * CAST(0.85 AS DOUBLE)) + floor(n * CAST(0.075 AS DOUBLE)) THEN 'val' ELSE 'test' END"
_RANK = f"row_number() OVER (PARTITION BY source ORDER BY {_MD5.format(c='doc_id')}, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n"


@query(f"WITH {_DEDUPED}, w AS (SELECT source, {_RANK} FROM e) SELECT source, {_SPLIT} AS split, count(*) AS cnt FROM w GROUP BY ALL")
def corpus_split_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    kept = C.valid_first_wins(docs, "text", "doc_id").select("doc_id", "source")
    return C.stratified_split(kept, "source", "doc_id").groupBy("source", "split").agg(F.count("*").alias("cnt"))


@query(f"WITH p AS (SELECT doc_id, source, doc_id % 10 = 0 AS proxy FROM documents), w AS (SELECT doc_id, source, {_RANK} FROM p WHERE NOT proxy) SELECT doc_id, {_SPLIT} AS split FROM w UNION ALL SELECT doc_id, 'test' FROM p WHERE proxy")
def proxy_forced_test_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return C.stratified_split(docs, "source", "doc_id", proxy=F.col("doc_id") % 10 == 0).select("doc_id", "split")


#: Every whole text, and beside each document three texts that aren't valid.
_EDGES = "SELECT doc_id, 0 AS kind, text FROM documents UNION ALL SELECT doc_id, k AS kind, CASE k WHEN 1 THEN ' ' WHEN 2 THEN 'NaN' END AS text FROM documents, (VALUES (1), (2), (3)) AS t(k)"


def _edges(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    odd = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).cast("string").alias("text")) for k, t in ((1, " "), (2, "NaN"), (3, None))])).alias("x"))
    return docs.select("doc_id", F.lit(0).alias("kind"), "text").union(odd.select("doc_id", "x.kind", "x.text"))


@query(f"WITH x AS ({_EDGES}) SELECT doc_id, kind, text FROM x WHERE {_VALID}")
def row_validity(spark, sf_dir):
    return _edges(spark, sf_dir).where(X.is_valid(F.col("text")))


@query(f"WITH x AS ({_EDGES}) SELECT doc_id, kind, CASE WHEN lower(text) <> 'nan' THEN text END AS text FROM x")
def null_canonicalise(spark, sf_dir):
    return _edges(spark, sf_dir).select("doc_id", "kind", X.nan_to_null(F.col("text")).alias("text"))


def _unified(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    pairs = _turn_pairs(spark, sf_dir)
    return C.union_all(
        C.unify(t("documents"), "documents", F.col("doc_id"), "monolingual_social", F.col("text"), "en"),
        C.unify(pairs, "conversations", F.concat_ws("-", "conv_id", "turn"), C.TRANSLATION, F.col("text"), "bn", F.col("parallel_text"), "en", extract=False),
        C.unify(t("benchmark"), "benchmark", F.col("item_id"), "monolingual_social", F.col("text"), "en", is_proxy=True),
        C.unify(t("pages"), "pages", F.col("page_id"), "monolingual_social", F.col("html"), "en", task_labels=F.to_json(F.struct("url"))),
    )


def _turn_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    user, answer = c.where("role = 'user'"), c.where("role = 'assistant'")
    return user.alias("a").join(answer.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") + 1 == F.col("b.turn"))).select("a.conv_id", "a.turn", F.col("a.text").alias("text"), F.col("b.text").alias("parallel_text"))


_PAIRS = "pairs AS (SELECT a.conv_id, a.turn, a.text, b.text AS parallel_text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn WHERE a.role = 'user' AND b.role = 'assistant')"
_RE_W = r"[\p{L}\p{N}_]"
_UNION = f"""WITH {_PAIRS}, u AS (
SELECT concat('documents_', doc_id) AS id, 'documents' AS source_dataset, text, NULL AS parallel_text, true AS x FROM documents
UNION ALL SELECT concat('conversations_', conv_id, '-', turn), 'conversations', text, parallel_text, false FROM pairs
UNION ALL SELECT concat('benchmark_', item_id), 'benchmark', text, NULL, true FROM benchmark
UNION ALL SELECT concat('pages_', page_id), 'pages', html, NULL, true FROM pages),
v AS (SELECT * FROM u WHERE {_VALID})"""


@query(_UNION + f" SELECT id, source_dataset, CASE WHEN lower(parallel_text) <> 'nan' THEN parallel_text END AS parallel_text, CASE WHEN x THEN array_to_string(regexp_extract_all(text, '@({_RE_W}+)', 1), '|') ELSE '' END AS mentions, length(text)::BIGINT AS n_chars FROM v")
def union_sources(spark, sf_dir):
    return _unified(spark, sf_dir).select("id", "source_dataset", "parallel_text", F.array_join("mentions", "|").alias("mentions"), F.length("text").cast("long").alias("n_chars"))


@query(_UNION + " SELECT source_dataset, count(*) AS cnt FROM v GROUP BY ROLLUP (source_dataset)")
def count_by_source_rollup(spark, sf_dir):
    return C.count_by(_unified(spark, sf_dir), "source_dataset")


@query(f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_MD5.format(c='doc_id')}, doc_id) <= 25")
def cap_per_source_sample(spark, sf_dir):
    return C.cap_per_key(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 25, "doc_id")


@query(f"SELECT doc_id FROM documents ORDER BY {_MD5.format(c='doc_id')}, doc_id LIMIT 300")
def exact_n_sample(spark, sf_dir):
    return C.sample_n(table(spark, sf_dir, "documents").select("doc_id"), 300, "doc_id")


@query(f"SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY {_MD5.format(c='doc_id')}, doc_id) <= floor(count(*) OVER () * CAST(0.08 AS DOUBLE))")
def fraction_sample(spark, sf_dir):
    return C.sample_fraction(table(spark, sf_dir, "documents").select("doc_id"), 0.08, "doc_id")


@query(f"WITH {_DEDUPED} SELECT format('proxy_{{:06d}}', doc_id) AS id, text FROM e")
def first_wins_dedupe(spark, sf_dir):
    kept = C.valid_first_wins(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")
    return C.proxy_ids(kept, "doc_id").select("id", "text")


@query(f"WITH {_D} SELECT doc_id, array_to_string(regexp_extract_all(t, '#({_RE_W}+)', 1), '|') AS hashtags, array_to_string(regexp_extract_all(t, '@({_RE_W}+)', 1), '|') AS mentions, array_to_string(regexp_extract_all(t, '{_EMO}'), '|') AS emojis FROM d")
def social_fields(spark, sf_dir):
    t = F.col("t")
    return decorated(spark, sf_dir).select("doc_id", F.array_join(X.hashtags(t), "|").alias("hashtags"), F.array_join(X.mentions(t), "|").alias("mentions"), F.array_join(X.emojis(t), "|").alias("emojis"))


_BN = r"[\x{0980}-\x{09FF}]"


@query(f"WITH {_D} SELECT doc_id, regexp_matches(t, '{_BN}') AS has_bn, regexp_matches(t, '[A-Za-z]') AS has_latin, regexp_matches(t, '{_BN}') AND regexp_matches(t, '[A-Za-z]') AS is_code_mixed, regexp_matches(t, '[A-Za-z]') AND NOT regexp_matches(t, '{_BN}') AS is_romanised FROM d")
def code_mix_flags(spark, sf_dir):
    t = F.col("t")
    return decorated(spark, sf_dir).select("doc_id", X.has_bengali(t).alias("has_bn"), X.has_latin(t).alias("has_latin"), X.is_code_mixed(t).alias("is_code_mixed"), X.is_romanised(t).alias("is_romanised"))


_RATIO = f"length(regexp_replace({{c}}, '[^\\x{{0980}}-\\x{{09FF}}]', '', 'g')) / nullif(length(regexp_replace({{c}}, '[^A-Za-z\\x{{0980}}-\\x{{09FF}}]', '', 'g')), 0)::DOUBLE"


def ratio(c: str) -> str:
    return "coalesce(" + _RATIO.replace("{c}", c).replace("{{", "{").replace("}}", "}") + ", 0.0)"


@query(f"WITH {_D} SELECT doc_id, round({ratio('t')}, 9) AS ratio FROM d")
def unicode_ratio(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", F.round(X.bengali_ratio(F.col("t")), 9).alias("ratio"))


@query(f"WITH {_D}, k AS (SELECT doc_id, {tok('t')} AS k FROM d), x AS (SELECT doc_id, unnest(k) AS x FROM k) SELECT doc_id, x.kind AS kind, count(*) AS cnt, sum(length(x.token))::BIGINT AS chars FROM x GROUP BY ALL")
def tokenize_kinds(spark, sf_dir):
    x = decorated(spark, sf_dir).select("doc_id", F.explode(X.tokenize(F.col("t"))).alias("x"))
    return x.groupBy("doc_id", F.col("x.kind").alias("kind")).agg(F.count("*").alias("cnt"), F.sum(F.length("x.token")).alias("chars"))


@query(f"WITH {_D}, k AS (SELECT doc_id, {tok('t')} AS k FROM d) SELECT doc_id, array_to_string(list_transform(list_filter(k, lambda x: x.kind IN ('hashtag', 'mention', 'url', 'emoji')), lambda x: x.token), '|') AS spans FROM k")
def protected_spans(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", F.array_join(X.protected_spans(F.col("t")), "|").alias("spans"))


@query(
    f"WITH {_D}, m AS (SELECT {sql_map(T.SLANG)} AS m), k AS (SELECT doc_id, regexp_extract_all(t, '{_W}+|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+') AS k FROM d) "
    "SELECT doc_id, array_to_string(list_transform(k, lambda w: CASE WHEN m[lower(w)] IS NULL THEN w WHEN upper(w) = w AND lower(w) <> w THEN upper(m[lower(w)]) "
    "WHEN upper(w[1]) = w[1] AND lower(w[1]) <> w[1] THEN concat(upper(m[lower(w)][1]), m[lower(w)][2:]) ELSE m[lower(w)] END), '') AS normal FROM k, m"
)
def slang_normalise(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", X.normalize_slang(F.col("t")).alias("normal"))


@query(f"WITH {_D} SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(t, '<unk>', ''), '<pad>', ''), '<s>', ''), '</s>', ''), '\\s+', ' ', 'g')) AS clean FROM d")
def sanitise_text(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", X.sanitize(F.col("t")).alias("clean"))


_BN_SQL = (
    f"c AS (SELECT {sql_map(T.CONSONANTS)} AS c, {sql_map(T.SIGNS | {T.VIRAMA: ''})} AS s, {sql_map(T.VOWELS | T.MARKS | T.DIGITS)} AS o)",
    f"array_to_string(list_transform(regexp_extract_all({{t}}, '(?s)[{''.join(T.CONSONANTS)}][{T.VIRAMA}{''.join(T.SIGNS)}]?|.'), lambda p: coalesce(c[p[1]] || CASE WHEN length(p) = 2 THEN s[p[2]] ELSE 'o' END, o[p], p)), '')",
)


@query(f"WITH {_D}, {_BN_SQL[0]} SELECT doc_id, {_BN_SQL[1].format(t='t')} AS latin FROM d, c")
def bn_to_latin(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", X.bn_to_latin(F.col("t")).alias("latin"))


@query(
    f"WITH {_D}, m AS (SELECT {sql_map(T.LATIN)} AS r, {sql_map(T.FIRST_VOWELS)} AS f), k AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]+') AS k FROM d) "
    f"SELECT doc_id, array_to_string(list_transform(k, lambda p: CASE WHEN regexp_matches(p, '^[A-Za-z]') THEN array_to_string(list_transform(regexp_extract_all(p, '(?i){'|'.join(T.LATIN)}|.'), lambda x, i: coalesce(CASE WHEN i = 1 THEN f[lower(x)] END, r[lower(x)], x)), '') ELSE p END), '') AS bengali FROM k, m"
)
def latin_to_bn(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", X.latin_to_bn(F.col("t")).alias("bengali"))


_ONE_TAG = "concat('#', regexp_replace(text, '[ \\t\\n]+', ''{g}))"
#: Camel words without a look ahead: each capital with a small letter after it starts a word.
_CAMEL = "regexp_extract_all(regexp_replace({t}, '([A-Z][a-z])', '|\\1', 'g'), '[A-Z][a-z]+|[a-z]+|[A-Z]+|[০-৯0-9]+|[\\x{0980}-\\x{09FF}]+')"


@query("SELECT doc_id, array_to_string(" + _CAMEL.replace("{t}", f"regexp_replace({_ONE_TAG.replace('{g}', ', ' + repr('g'))}, '^#', '')") + ", '|') AS words FROM documents")
def camel_split(spark, sf_dir):
    """Each whole text as one hashtag."""
    tag = F.expr(_ONE_TAG.replace("{g}", "").replace("\\", "\\\\"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.camel_split(X.without_hash(tag)), "|").alias("words"))


_COUNTS = (
    "c AS (SELECT lower(w) AS word, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+|[\\x{0980}-\\x{09FF}]+')) AS w FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)) WHERE length(w) >= 2 GROUP BY 1)"
)


_DICTIONARIES: dict[tuple[str, str, int], str] = {}


def _dictionary(spark, sf_dir, k=G.TOP):
    """Made once an application and kept in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, k)
    if key not in _DICTIONARIES:
        _DICTIONARIES[key] = fresh(spark, "banyan-dictionary")
    return G.kept_dictionary(spark, _DICTIONARIES[key], lambda: table(spark, sf_dir, "documents").select("text").union(table(spark, sf_dir, "benchmark").select("text")), k)


@query(f"WITH {_COUNTS} SELECT word, cnt FROM c ORDER BY cnt DESC, word LIMIT 500")
def word_freq_topk(spark, sf_dir):
    return _dictionary(spark, sf_dir, 500)


@query(
    f"WITH {_COUNTS}, d AS (SELECT * FROM c ORDER BY cnt DESC, word LIMIT 200000), s AS (SELECT coalesce(nullif(sum(cnt), 0), 1) AS total FROM d), "
    "w AS (SELECT DISTINCT unnest(string_split_regex(text, '[^A-Za-z]+')) AS word FROM benchmark) SELECT w.word AS word, round(CASE WHEN cnt IS NULL THEN ln(total) + 2 * length(w.word) ELSE ln(total / cnt) END, 9) AS cost FROM w LEFT JOIN d ON lower(w.word) = d.word, s"
)
def word_cost(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("word")).distinct()
    return G.word_costs(words, _dictionary(spark, sf_dir)).select("word", F.round("cost", 9).alias("cost"))


#: A fold over the ends of a word's parts: least costs and the last part's start, then the parts from the end. h: costs of known parts by end * 21 + size.
_VITERBI = f"""
{_COUNTS}, d AS (SELECT * FROM c ORDER BY cnt DESC, word LIMIT {G.TOP}), s AS (SELECT coalesce(nullif(sum(cnt), 0), 1)::DOUBLE AS total FROM d),
t AS (SELECT DISTINCT w[k] || w[k + 1] AS w FROM (SELECT regexp_extract_all(lower(text), '[A-Za-z]+|[\\x{{{{0980}}}}-\\x{{{{09FF}}}}]+') AS w FROM documents), unnest(range(1, len(w))) AS r(k)),
y AS (SELECT w, length(w)::INT AS n FROM t),
p AS (SELECT w, e, z FROM y, unnest(range(1, n + 1)) AS r(e), unnest(range(1, least({G.LONGEST}, e) + 1)) AS q(z)),
f AS (SELECT p.w AS w, map_from_entries(list(row(e * {G.LONGEST + 1} + z, ln(total / cnt)))) AS h FROM p JOIN d ON d.word = lower(substr(p.w, e - z + 1, z)), s GROUP BY p.w),
b AS (SELECT y.w AS w, n, ln(total) AS u, coalesce(h, MAP([]::BIGINT[], []::DOUBLE[])) AS h FROM y LEFT JOIN f USING (w), s),
v AS (SELECT w, n, list_reduce(list_prepend({{{{'best': [0.0::DOUBLE], 'cuts': [0::BIGINT], 'e': 0::BIGINT}}}}, list_transform(range(1, n + 1), lambda e: {{{{'best': []::DOUBLE[], 'cuts': []::BIGINT[], 'e': e}}}})),
  lambda a, x: {{{{'best': list_append(a.best, list_min(list_transform(range(greatest(0, x.e - {G.LONGEST}), x.e), lambda i: {{{{'c': a.best[i + 1] + coalesce(h[x.e * {G.LONGEST + 1} + x.e - i], u + 2 * (x.e - i)), 'i': i}}}})).c),
    'cuts': list_append(a.cuts, list_min(list_transform(range(greatest(0, x.e - {G.LONGEST}), x.e), lambda i: {{{{'c': a.best[i + 1] + coalesce(h[x.e * {G.LONGEST + 1} + x.e - i], u + 2 * (x.e - i)), 'i': i}}}})).i), 'e': x.e}}}}).cuts AS cuts FROM b)
""".replace("{{", "{").replace("}}", "}")


@query(
    f"WITH {_VITERBI} SELECT '#' || w AS tag, list_reduce(list_prepend({{'at': n::BIGINT, 'words': '', 'e': 0::BIGINT}}, list_transform(range(n, 0, -1), lambda e: {{'at': 0::BIGINT, 'words': '', 'e': e}})), "
    "lambda a, x: CASE WHEN x.e = a.at THEN {'at': cuts[x.e + 1], 'words': concat(substr(w, cuts[x.e + 1] + 1, x.e - cuts[x.e + 1]), CASE WHEN a.words = '' THEN '' ELSE '|' END, a.words), 'e': x.e} ELSE a END).words AS words FROM v"
)
def hashtag_viterbi(spark, sf_dir):
    """A hashtag of each two neighbouring words of the texts, each tag once."""
    words = X.find_all(F.lower("text"), P.WORD)
    pairs = X.bind(words, lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.lit(0), F.size(w) - 1)), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(F.lit("#"), a, b)))
    tags = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(pairs)).alias("tag")).distinct()
    # in order within a task, so that tags of a batch have long heads in common
    tags = tags.sortWithinPartitions("tag")
    # G.segmented gives the same without Python and takes over three times as long
    segment = G.segmenter(_dictionary(spark, sf_dir))
    return tags.select("tag", F.array_join(segment(F.col("tag")), "|").alias("words"))


_TAG_WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


@query(
    f"SELECT doc_id, t AS target, CASE t WHEN 'en' THEN '#' || array_to_string(list_transform({_TAG_WORDS}, lambda w: concat(upper(w[1]), w[2:])), '') WHEN 'bn' THEN '#' || array_to_string({_TAG_WORDS}, '') ELSE '#kept' END AS tag FROM documents, (VALUES ('en'), ('bn'), ('none')) AS v(t) WHERE t = 'none' OR len({_TAG_WORDS}) > 0 "
    f"UNION ALL SELECT doc_id, t, '#kept' FROM documents, (VALUES ('en'), ('bn')) AS v(t) WHERE text IS NULL OR len({_TAG_WORDS}) = 0"
)
def rebuild_hashtag(spark, sf_dir):
    """The words of each whole text as a hashtag's, towards both languages; none: the tag is kept."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(X.find_all(F.lower("text"), "[a-z]+"), F.array().cast("array<string>")).alias("w"), F.explode(F.array(F.lit("en"), F.lit("bn"), F.lit("none"))).alias("target"))
    words = F.when(F.col("target") == "none", F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit("")), "w"))
    tag = F.when((F.col("target") == "none") | (F.size("w") == 0), X.rebuild_hashtag(F.lit("#kept"), F.array().cast("array<string>"), F.lit("en"))).when(F.col("target") == "en", X.rebuild_hashtag(F.lit("#kept"), words, F.lit("en"))).otherwise(X.rebuild_hashtag(F.lit("#kept"), words, F.lit("bn")))
    return rows.select("doc_id", "target", tag.alias("tag"))


def reassemble_sql(translated: str, tokens: str) -> str:
    """The fold of protected tokens into a translation; the text so far goes along as an element's token."""
    rtrim = lambda x: f"regexp_replace({x}, '\\s+$', '')"
    camel = _CAMEL.replace("{t}", "x.token[2:]")
    rebuilt = f"CASE WHEN len({camel}) = 0 THEN x.token ELSE concat('#', array_to_string(list_transform({camel}, lambda w: concat(upper(w[1]), w[2:])), '')) END"
    own = f"list_transform(list_filter({tokens}, lambda x: x.kind IN ('hashtag', 'mention', 'url', 'emoji')), lambda x: {{'token': x.token, 'kind': x.kind, 'new': CASE WHEN x.kind = 'hashtag' THEN {rebuilt} ELSE '' END}})"
    gone = f"CASE WHEN contains(a.token, x.token) THEN {rtrim('replace(a.token, x.token, ' + repr('') + ')')} ELSE a.token END"
    step = f"CASE WHEN x.kind = 'hashtag' THEN concat({rtrim(gone)}, ' ', x.new) WHEN NOT contains(a.token, x.token) THEN concat({rtrim('a.token')}, ' ', x.token) ELSE a.token END"
    return f"list_reduce(list_prepend({{'token': {translated}, 'kind': '', 'new': ''}}, {own}), lambda a, x: {{'token': {step}, 'kind': '', 'new': ''}}).token"


@query(f"WITH {_D}, k AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN t ELSE text END AS o, {tok('t')} AS k FROM d JOIN documents USING (doc_id)) SELECT doc_id, {reassemble_sql('o', 'k')} AS final FROM k")
def reassemble(spark, sf_dir):
    """Against whole texts that keep all tokens or have lost them; hashtags are rebuilt from their camel words."""
    rows = decorated(spark, sf_dir, "text").withColumn("tokens", X.protected(F.col("t")))
    tags = F.array_distinct(X.of_kind(F.col("tokens"), "hashtag"))
    rebuilt = F.map_from_entries(F.transform(tags, lambda t: F.struct(t, X.rebuild_hashtag(t, X.camel_split(X.without_hash(t)), F.lit("en")))))
    translated = F.when(F.col("doc_id") % 2 == 0, F.col("t")).otherwise(F.col("text"))
    return rows.select("doc_id", X.bind(rebuilt, lambda m: X.reassemble(F.col("tokens"), translated, m)).alias("final"))


_SAN = "trim(regexp_replace(replace(replace(replace(replace({c}, '<unk>', ''), '<pad>', ''), '<s>', ''), '</s>', ''), '\\s+', ' ', 'g'))"


@query(f"WITH {_PAIRS} SELECT concat('conversations_', conv_id, '-', turn) AS id, {_SAN.format(c='parallel_text')} AS source, {_SAN.format(c='text')} AS target FROM pairs WHERE {_VALID} AND text <> '' AND lower(parallel_text) <> 'nan' AND {_SAN.format(c='parallel_text')} <> '' AND {_SAN.format(c='text')} <> ''")
def mt_pair_projection(spark, sf_dir):
    return C.translation_pairs(_unified(spark, sf_dir), "en2bn", order="id")


_SHARD = "SELECT *, (rn - 1) // 100 AS shard, (rn - 1) % 100 AS place FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('42|', doc_id)), doc_id) AS rn FROM documents)"


@query(f"SELECT doc_id, shard, place FROM ({_SHARD})")
def shuffled_shards(spark, sf_dir):
    """The table shuffled as a whole, in shards of 100 rows."""
    return H.placed(table(spark, sf_dir, "documents"), "doc_id", rows=100).select("doc_id", "shard", "place")


@query(f"""SELECT shard, count(*) AS "rows", sum(('0x' || substr(md5(concat_ws('|', place, doc_id, coalesce(text, '\\N'), coalesce(lang, '\\N'), coalesce(source, '\\N'), n_chars)), 1, 12))::BIGINT)::VARCHAR AS checksum FROM ({_SHARD}) GROUP BY shard""")
def shard_manifest(spark, sf_dir):
    """Rows and checksums of the shards as they were written."""
    return H.write_shards(table(spark, sf_dir, "documents"), fresh(spark, "banyan-shards"), "doc_id", rows=100)


_BATCHED = (
    f"WITH {_PAIRS}, y AS (SELECT concat('conversations_', conv_id, '-', turn) AS id, {_SAN.format(c='parallel_text')} AS source, {_SAN.format(c='text')} AS target FROM pairs WHERE {_VALID} AND text <> '' AND lower(parallel_text) <> 'nan' AND {_SAN.format(c='parallel_text')} <> '' AND {_SAN.format(c='text')} <> ''), "
    "z AS (SELECT id, (rn - 1) // 256 AS shard, (rn - 1) % 256 AS place, least(128, strlen(concat('eng_Latn ben_Beng ', source)) + 1)::BIGINT AS source_length, least(128, strlen(target) + 1)::BIGINT AS target_length FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('42|', id)), id) AS rn FROM y)), "
    "c AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY {order} place) - 1 AS pos FROM z), b AS (SELECT *, pos // 32 AS cut, pos % 32 AS row FROM c), "
    "m AS (SELECT *, dense_rank() OVER (PARTITION BY shard ORDER BY md5(concat('42|', shard, '|', cut)), cut) - 1 AS batch, max(source_length) OVER (PARTITION BY shard, cut) - source_length AS source_pad, max(target_length) OVER (PARTITION BY shard, cut) - target_length AS target_pad FROM b) "
)


def _training_rows(spark, sf_dir, by_length: bool = True):
    pairs = C.translation_pairs(_unified(spark, sf_dir), "en2bn", order="id")
    return B.training_rows(pairs, "id", "en2bn", longest=128, size=32, rows=256, codes=("eng_Latn", "ben_Beng"), by_length=by_length)


@query(_BATCHED.replace("{order}", "source_length, target_length,") + "SELECT id, shard, batch, row, source_length, target_length, source_pad, target_pad FROM m")
def training_batches(spark, sf_dir):
    """Pairs in batches of like lengths, with what each row lacks to its batch's longest."""
    return _training_rows(spark, sf_dir).select("id", "shard", "batch", "row", "source_length", "target_length", "source_pad", "target_pad")


_SHARE = 'SELECT \'{name}\' AS batches_by, count(*) AS "rows", count(DISTINCT (shard, batch)) AS batches, sum(source_length + target_length)::BIGINT AS ids, sum(source_length + target_length + source_pad + target_pad)::BIGINT AS cells, round(sum(source_pad + target_pad) / sum(source_length + target_length + source_pad + target_pad)::DOUBLE, 6) AS share FROM m'


@query(f"SELECT * FROM ({_BATCHED.replace('{order}', 'source_length, target_length,') + _SHARE.format(name='length')}) UNION ALL SELECT * FROM ({_BATCHED.replace('{order}', '') + _SHARE.format(name='place')})")
def padding_share(spark, sf_dir):
    """How much of all batches is padding, by length and as rows come."""
    return C.union_all(*[B.padding_share(_training_rows(spark, sf_dir, by)).withColumn("batches_by", F.lit(name)) for name, by in (("length", True), ("place", False))])


@query("WITH a AS (SELECT text AS bn, row_number() OVER (ORDER BY doc_id) AS line_no FROM documents), b AS (SELECT text AS en, row_number() OVER (ORDER BY item_id) AS line_no FROM benchmark) SELECT line_no, trim(bn) AS bn, trim(en) AS en FROM a JOIN b USING (line_no)")
def positional_zip_join(spark, sf_dir):
    a = by_number(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("bn")), "doc_id")
    b = by_number(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("en")), "item_id")
    return a.join(b, "line_no").select("line_no", F.trim("bn").alias("bn"), F.trim("en").alias("en"))


@query(f"WITH l AS (SELECT text, row_number() OVER (ORDER BY item_id) AS line_no FROM benchmark), s AS (SELECT line_no FROM l ORDER BY {_MD5.format(c='line_no')}, line_no LIMIT 25) SELECT line_no, text FROM l SEMI JOIN s USING (line_no)")
def sampled_lines(spark, sf_dir):
    """Lines whose number is in a sample of line numbers."""
    lines = by_number(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id").select("line_no", "text")
    return lines.join(C.sample_n(lines.select("line_no"), 25, "line_no"), "line_no", "left_semi")


def _candidates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("source_id"), F.col("event_type").alias("engine"), F.when(F.col("event_id") % 17 == 0, "").otherwise(F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string"))).alias("text"), F.col("event_id").alias("cand_idx"), F.when(F.col("event_id") % 3 != 0, F.round(F.col("value"), 0)).alias("score"))


_CAND = "c AS (SELECT user_id AS source_id, event_type AS engine, CASE WHEN event_id % 17 = 0 THEN '' ELSE concat('t', event_id % 5) END AS text, event_id AS cand_idx, CASE WHEN event_id % 3 <> 0 THEN round(value, 0) END AS score FROM events)"


@query(f"WITH {_CAND} SELECT source_id, engine, text, min(cand_idx) AS cand_idx FROM c WHERE text <> '' GROUP BY ALL")
def candidate_dedupe(spark, sf_dir):
    return R.dedupe_candidates(_candidates(spark, sf_dir)).select("source_id", "engine", "text", "cand_idx")


@query(f"WITH {_CAND} SELECT source_id, engine, text, cand_idx, score FROM c QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score IS NULL, score DESC, cand_idx) = 1")
def candidate_top1(spark, sf_dir):
    return R.best(_candidates(spark, sf_dir)).select("source_id", "engine", "text", "cand_idx", "score")


@query("SELECT user_id AS source_id, min(event_id) AS cand_idx, NULL::DOUBLE AS score FROM events WHERE event_id % 3 = 0 GROUP BY 1")
def null_score_last(spark, sf_dir):
    return R.best(_candidates(spark, sf_dir).where("score IS NULL")).select("source_id", "cand_idx", "score")


_CONF = "(doc_id % 100) / CAST(100 AS DOUBLE)"
_GATE_L = "CASE WHEN doc_id % 5 = 0 THEN 'bn' ELSE lang END"
_TRAINED = "substr(md5(concat('42|', CAST({c} AS {s}))), 1, 1) < 'c'"
#: Label m.label and confidence of each document, by a model of those that are trained on.
_LANGUAGE = rf"""
lt AS (SELECT doc_id, lang, concat(' ', trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{M}}]+', ' ', 'g')), ' ') AS s FROM documents),
lp AS (SELECT doc_id, lang, list_transform(string_split(s, ''), lambda c: unicode(c)::BIGINT) AS c FROM lt WHERE length(s) > 2),
lg AS MATERIALIZED (SELECT doc_id, lang, b, count(*) AS k FROM (SELECT doc_id, lang, unnest(list_concat(list_transform(list_filter(c, lambda x: x <> 32), lambda x: x % {L.PRIME}),
  list_transform(range(1, len(c)), lambda i: {L.PRIME} + ((c[i] << 20) + c[i + 1]) % {L.PRIME}), list_transform(range(1, len(c) - 1), lambda i: {2 * L.PRIME} + ((c[i] << 40) + (c[i + 1] << 20) + c[i + 2]) % {L.PRIME}))) AS b FROM lp) GROUP BY ALL),
ln AS MATERIALIZED (SELECT lang AS label, b, sum(k) AS n FROM lg WHERE {_TRAINED.format(c='doc_id', s='VARCHAR')} AND lang IS NOT NULL GROUP BY ALL), lw AS (SELECT label, sum(n) AS total FROM ln GROUP BY label),
ls AS (SELECT doc_id, w.label, sum(k * ln((coalesce(n, 0) + {L.SMOOTH}::DOUBLE) / (total + {L.SMOOTH}::DOUBLE * {L.BUCKETS}))) / sum(k) AS m, sum(k) AS k FROM lg CROSS JOIN lw w LEFT JOIN ln ON ln.label = w.label AND ln.b = lg.b GROUP BY ALL),
lm AS (SELECT doc_id, min({{'x': -m, 'label': label}}).label AS label, 1 / sum(exp(least(k, {L.SHARP}) * (m - top))) AS confidence FROM (SELECT *, max(m) OVER (PARTITION BY doc_id) AS top FROM ls) GROUP BY doc_id)
"""


def _language_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return docs, L.fit(docs.where(F.expr(_TRAINED.format(c="doc_id", s="STRING"))), "text", "lang")


@query(f"WITH {_LANGUAGE} SELECT doc_id, NOT {_TRAINED.format(c='doc_id', s='VARCHAR')} AS held_out, label, round(coalesce(confidence, 0.0), 6) AS confidence FROM documents LEFT JOIN lm USING (doc_id)")
def language_identify(spark, sf_dir):
    """Each document's language by a model that a quarter of them is held out from."""
    docs, model = _language_model(spark, sf_dir)
    found = L.identified(docs, model, "text", "label")
    return found.select("doc_id", (~F.expr(_TRAINED.format(c="doc_id", s="STRING"))).alias("held_out"), "label", F.round("confidence", 6).alias("confidence"))


_BENGALI = "concat('আমি ভালো আছি ', lang)"


@query(
    f"WITH {_LANGUAGE}, x AS (SELECT doc_id, 'text' AS kind, text AS t, label AS p, coalesce(confidence, 0.0) AS c FROM documents LEFT JOIN lm USING (doc_id) UNION ALL SELECT doc_id, 'bengali', {_BENGALI}, 'bn', length(regexp_replace({_BENGALI}, '[^\\p{{Bengali}}]|\\P{{L}}', '', 'g')) / length(regexp_replace({_BENGALI}, '\\P{{L}}', '', 'g'))::DOUBLE FROM documents "
    f"UNION ALL SELECT doc_id, 'blank', ' ', NULL, 0.0 FROM documents), r AS (SELECT *, trim(t) = '' AS e, {ratio('t')} AS r FROM x) "
    "SELECT doc_id, kind, CASE WHEN e THEN 'unsupported' WHEN r >= 0.5 THEN 'bn' WHEN p IN ('bn', 'en') AND c >= 0.5 THEN p ELSE 'unsupported' END AS language, "
    "round(CASE WHEN e THEN 0.0 WHEN r >= 0.5 THEN greatest(r, CASE WHEN p = 'bn' THEN c ELSE 0.0 END) ELSE c END::DOUBLE, 6) AS confidence, "
    "CASE WHEN e THEN 'empty input' WHEN r >= 0.5 THEN 'bengali_unicode_ratio' WHEN p IN ('bn', 'en') AND c >= 0.5 THEN 'fasttext' ELSE 'unsupported_language_or_low_confidence' END AS reason, "
    "CASE WHEN e THEN NULL WHEN r >= 0.5 THEN 'bn2en' WHEN p = 'bn' AND c >= 0.5 THEN 'bn2en' WHEN p = 'en' AND c >= 0.5 THEN 'en2bn' END AS direction FROM r"
)
def language_gate_route(spark, sf_dir):
    """Whole texts, and a Bengali and a blank one of each document, by the fitted language model."""
    docs, model = _language_model(spark, sf_dir)
    rows = docs.select("doc_id", F.lit("text").alias("kind"), F.col("text").alias("t")).union(docs.select("doc_id", F.lit("bengali"), F.expr(_BENGALI))).union(docs.select("doc_id", F.lit("blank"), F.lit(" ")))
    x = L.identified(rows, model, "t", "p", "c").withColumn("r", X.bengali_ratio(F.col("t")))
    g = S.gate(F.col("t"), F.col("p"), F.col("c"), ratio=F.col("r"))
    out = x.select("doc_id", "kind", *[g[k].alias(k) for k in ("language", "confidence", "reason")])
    return out.withColumns({"direction": S.direction_of(F.col("language")), "confidence": F.round("confidence", 6)})


@query("SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) + 0.0 AS similarity, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) >= 0.85 AS passed FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_verify_threshold(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    pairs = e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"), (F.col("vec_id") + 1).alias("b_id")).join(e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b")), "b_id")
    scored = pairs.select("a_id", "b_id", (F.round(S.cosine(F.col("a"), F.col("b")), 4) + F.lit(0.0)).alias("similarity"))
    return scored.withColumn("passed", F.col("similarity") >= 0.85)


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+')"
_VECTORS = f"""
ew AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents), en AS (SELECT count(*) AS n FROM documents),
ed AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(ws)) AS word FROM ew) GROUP BY word ORDER BY df DESC, word LIMIT {E.WORDS}),
eo AS (SELECT doc_id, word, count(*) AS k FROM (SELECT doc_id, unnest(ws) AS word FROM ew) GROUP BY ALL),
ex AS (SELECT doc_id, k * (ln((n + 1) / (coalesce(df, 0) + 1)::DOUBLE) + 1) AS x, md5(concat('{E.SEED}|', word)) AS h FROM eo LEFT JOIN ed USING (word), en),
ev AS MATERIALIZED (SELECT doc_id, ('0x' || substr(h, 3 * j + 1, 2))::INT % {E.SIZE} AS i, sum(CASE WHEN ('0x' || substr(h, 3 * j + 3, 1))::INT % 2 = 0 THEN x ELSE -x END) AS x FROM ex, range({E.NONZERO}) AS r(j) GROUP BY ALL)
"""


@query(
    f"WITH {_VECTORS}, p AS (SELECT doc_id AS a_id, doc_id + 1 AS b_id FROM documents WHERE doc_id + 1 IN (SELECT doc_id FROM documents)), q AS (SELECT doc_id, sum(x * x) AS q FROM ev GROUP BY doc_id), d AS (SELECT a.doc_id AS a_id, sum(a.x * b.x) AS d FROM ev a JOIN ev b ON b.doc_id = a.doc_id + 1 AND a.i = b.i GROUP BY a.doc_id) "
    "SELECT a_id, b_id, round(CASE WHEN coalesce(qa.q, 0) = 0 OR coalesce(qb.q, 0) = 0 THEN CASE WHEN coalesce(qa.q, 0) = coalesce(qb.q, 0) THEN 1.0 ELSE 0.0 END ELSE coalesce(d, 0) / sqrt(qa.q * qb.q) END, 6) AS similarity FROM p LEFT JOIN d USING (a_id) LEFT JOIN q qa ON qa.doc_id = a_id LEFT JOIN q qb ON qb.doc_id = b_id"
)
def embedding_neighbours(spark, sf_dir):
    """Similarity of each document to the one of the next id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # read twice
    v = stored(E.vectors(docs, "doc_id", "text", E.frequencies(docs, "text")).drop("_text"), "banyan-vectors")
    pairs = v.select(F.col("doc_id").alias("a_id"), F.col("vector").alias("a"), (F.col("doc_id") + 1).alias("b_id")).join(v.select(F.col("doc_id").alias("b_id"), F.col("vector").alias("b")), "b_id")
    return pairs.select("a_id", "b_id", F.round(E.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


_CASES = {
    "n": "CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 4 END", "w": "CASE WHEN doc_id % 6 = 1 THEN NULL ELSE text END", "post": "concat(text, ' post', doc_id % 2)", "pre": "concat(text, ' post0')",
    "applied": "doc_id % 5 <> 0", "post_ok": "doc_id % 7 < 3", "pre_ok": "doc_id % 3 = 0",
}
_CASE_SQL = ", ".join(f"{v} AS {k}" for k, v in _CASES.items())


@query(
    f"WITH x AS (SELECT doc_id, {_CASE_SQL} FROM documents), y AS (SELECT *, n = 0 OR w IS NULL AS none, NOT post_ok AND applied AND post <> pre AND pre_ok AS back FROM x) SELECT doc_id, CASE WHEN none THEN NULL WHEN back THEN pre ELSE post END AS translation, "
    "none OR (NOT post_ok AND NOT back) AS low_confidence, CASE WHEN none OR post_ok THEN NULL WHEN back THEN 'fell back to the text before the edit' WHEN applied AND post <> pre THEN 'neither text verified' ELSE 'not verified' END AS note, CASE WHEN n = 0 THEN 'no candidates' WHEN w IS NULL THEN 'no winner' END AS error FROM y"
)
def quality_decision_table(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", *[F.expr(v).alias(k) for k, v in _CASES.items()])
    q = S.quality(*[F.col(c) for c in ("n", "w", "post", "pre", "applied", "post_ok", "pre_ok")])
    return x.select("doc_id", *[c.alias(k) for k, c in q.items()])


_EDIT = "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN t WHEN 2 THEN '' ELSE replace(t, '@user', '@') END"


@query(
    f"WITH {_D}, k AS (SELECT doc_id, t, {_EDIT} AS e, list_transform(list_filter({tok('t')}, lambda x: x.kind IN ('hashtag', 'mention', 'url', 'emoji')), lambda x: x.token) AS p FROM d), m AS (SELECT *, list_filter(p, lambda x: NOT contains(e, x)) AS lost FROM k) "
    "SELECT doc_id, e IS NOT NULL AND len(lost) = 0 AND e <> '' AS edit_applied, e IS NULL OR len(lost) = 0 AS protected_tokens_preserved, CASE WHEN e IS NULL THEN 'unavailable' WHEN len(lost) > 0 THEN 'tokens_lost' WHEN e = '' THEN 'empty' END AS fallback, CASE WHEN e IS NULL THEN '' ELSE array_to_string(lost, '|') END AS missing FROM m"
)
def postedit_guard(spark, sf_dir):
    x = decorated(spark, sf_dir).select("doc_id", "t", F.expr(_EDIT).alias("e"), X.protected_spans(F.col("t")).alias("p"))
    q = S.postedit(F.col("t"), F.col("e"), F.col("p"))
    return x.select("doc_id", q["edit_applied"].alias("edit_applied"), q["protected_tokens_preserved"].alias("protected_tokens_preserved"), q["fallback"].alias("fallback"), F.array_join(q["missing"], "|").alias("missing"))


_OUT = "CASE doc_id % 3 WHEN 0 THEN replace(t, '@user', 'user') WHEN 1 THEN replace(t, '🔥', '') ELSE concat(t, ' #More') END"


def _pfs_sql(out: str = _OUT, rows: str = "d") -> str:
    of = lambda c, *k: f"list_transform(list_filter({c}, lambda x: x.kind IN ({', '.join(map(repr, k))})), lambda x: x.token)"
    share = lambda *k: f"CASE WHEN len({of('s', *k)}) > 0 THEN len(list_intersect(list_distinct({of('s', *k)}), list_distinct({of('o', *k)}))) / len(list_distinct({of('s', *k)}))::DOUBLE END"
    tags = f"CASE WHEN len({of('s', 'hashtag')}) > 0 THEN least(1.0, len({of('o', 'hashtag')}) / len({of('s', 'hashtag')})::DOUBLE) END"
    return f"WITH {_D}, k AS (SELECT doc_id, {tok('t')} AS s, {tok(out)} AS o FROM {rows}), p AS (SELECT doc_id, {share('emoji')} AS e, {share('mention', 'url')} AS v, {tags} AS h FROM k), q AS (SELECT *, list_avg(list_filter([e, v, h], lambda x: x IS NOT NULL)) AS a FROM p)"


@query(_pfs_sql() + " SELECT doc_id, round(a, 9) AS overall, round(e, 9) AS emoji_preservation, round(v, 9) AS verbatim_preservation, round(h, 9) AS hashtag_count_preservation FROM q")
def pfs_example(spark, sf_dir):
    return _pfs_rows(spark, sf_dir).select("doc_id", *[F.round(c, 9).alias(c) for c in M.PFS])


def _pfs_rows(spark, sf_dir):
    return M.fidelity_rows(decorated(spark, sf_dir).select("doc_id", "t", F.expr(_OUT).alias("o")), "t", "o")


@query(_pfs_sql() + " SELECT k.d AS dimension, round(avg(k.x), 6) AS mean, count(k.x) AS n_applicable, count(*) AS n_total FROM (SELECT unnest([{'d': 'overall', 'x': a}, {'d': 'emoji_preservation', 'x': e}, {'d': 'verbatim_preservation', 'x': v}, {'d': 'hashtag_count_preservation', 'x': h}]) AS k FROM q) GROUP BY 1")
def pfs_aggregate(spark, sf_dir):
    return M.fidelity_summary(_pfs_rows(spark, sf_dir)).select("dimension", F.round("mean", 6).alias("mean"), "n_applicable", "n_total")


_HYP = "CASE WHEN doc_id % 4 = 0 THEN regexp_replace(text, '^[^ ]+ ', '') WHEN doc_id % 4 = 1 THEN concat(text, ' the end of it') ELSE text END"


_FULL = "CASE WHEN doc_id % 5 = 0 THEN concat('so ', text) WHEN doc_id % 5 = 1 THEN replace(text, 'th', 'ht') ELSE text END"


def _modes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    one = d.select(F.lit("single").alias("mode"), "doc_id", F.expr(_HYP).alias("hyp"), F.col("text").alias("ref"))
    return one.union(d.select(F.lit("full"), "doc_id", F.expr(_FULL), F.col("text")))


def t13a(c: str) -> str:
    """The usual BLEU tokens, as a list."""
    x = f"concat(' ', replace(replace({c}, '<skipped>', ''), chr(10), ' '), ' ')"
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, '{a}', '{b}')"
    for pattern, by in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def _bleu_sql(end: str, hyp: str = _HYP) -> str:
    grams = " UNION ALL ".join(f"SELECT doc_id, {n} AS n, unnest(list_transform(range(1, len(x) - {n - 2}), lambda i: array_to_string(x[i:i + {n - 1}], ' '))) AS g FROM {{t}}" for n in range(1, 5))
    return (
        f"WITH h AS (SELECT doc_id, {t13a(hyp)} AS x FROM documents), r AS (SELECT doc_id, {t13a('text')} AS x FROM documents), "
        f"hg AS (SELECT doc_id, n, g, count(*) AS c FROM ({grams.format(t='h')}) GROUP BY ALL), rg AS (SELECT doc_id, n, g, count(*) AS c FROM ({grams.format(t='r')}) GROUP BY ALL), "
        "m AS (SELECT hg.n AS n, sum(least(hg.c, coalesce(rg.c, 0))) AS m, sum(hg.c) AS t FROM hg LEFT JOIN rg USING (doc_id, n, g) GROUP BY hg.n), l AS (SELECT (SELECT sum(len(x)) FROM h) AS hl, (SELECT sum(len(x)) FROM r) AS rl), "
        "s AS (SELECT max(m) FILTER (n = 1)::BIGINT AS m1, max(m) FILTER (n = 4)::BIGINT AS m4, max(t) FILTER (n = 4)::BIGINT AS t4, any_value(hl)::BIGINT AS hyp_len, any_value(rl)::BIGINT AS ref_len, 100 * CASE WHEN any_value(hl) < any_value(rl) THEN exp(1 - any_value(rl) / any_value(hl)) ELSE 1 END * exp(avg(ln(m / t))) AS bleu FROM m, l) "
    ) + end


@query(_bleu_sql("SELECT m1, m4, t4, hyp_len, ref_len, round(bleu, 6) AS bleu FROM s"))
def bleu_corpus(spark, sf_dir):
    counts = M.bleu_counts(_modes(spark, sf_dir).where("mode = 'single'"), "hyp", "ref")
    return M.bleu(counts).select("m1", "m4", "t4", "hyp_len", "ref_len", F.round("bleu", 6).alias("bleu"))


def _chrf_sql(mode: str, hyp: str) -> str:
    letters = lambda c: f"regexp_replace({c}, '\\s+', '', 'g')"
    mark = r"[!-/:-@\[-`{-~]"
    words = lambda c: (
        f"flatten(list_transform(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''), lambda w: CASE WHEN length(w) = 1 THEN [w] WHEN regexp_matches(w, '{mark}$') THEN [w[:-2], w[-1]] WHEN regexp_matches(w, '^{mark}') THEN [w[1], w[2:]] ELSE [w] END))"
    )
    gram = lambda k, n: f"SELECT doc_id, unnest(list_transform(range(1, len({k}) - {n - 2}), lambda i: hash({'substr(' + k + ', i, ' + str(n) + ')' if k[0] == 'c' else 'array_to_string(' + k + '[i:i + ' + str(n - 1) + '], chr(1))'}))) AS g FROM x"
    one = lambda k, n: (
        f"(SELECT sum(least(h.c, coalesce(r.c, 0))) AS m, sum(h.c) AS h, (SELECT sum(greatest(0, len({k}r) - {n - 1})) FROM x) AS r FROM (SELECT doc_id, g, count(*) AS c FROM ({gram(k + 'h', n)}) GROUP BY ALL) h LEFT JOIN (SELECT doc_id, g, count(*) AS c FROM ({gram(k + 'r', n)}) GROUP BY ALL) r USING (doc_id, g))"
    )
    orders = " UNION ALL ".join(f"SELECT * FROM {one(k, n)}" for k, n in [("c", n) for n in range(1, 7)] + [("w", 1), ("w", 2)])
    return (
        f"WITH x AS (SELECT doc_id, {letters(hyp)} AS ch, {letters('text')} AS cr, {words(hyp)} AS wh, {words('text')} AS wr FROM documents), o AS ({orders}), s AS (SELECT avg(m / h) AS p, avg(m / r) AS q FROM o) "
        f"SELECT '{mode}' AS mode, round(100 * 5 * p * q / (4 * p + q), 6) AS chrf FROM s"
    )


@query(f"SELECT * FROM ({_chrf_sql('single', _HYP)}) UNION ALL SELECT * FROM ({_chrf_sql('full', _FULL)})")
def chrf_corpus(spark, sf_dir):
    return M.chrf(M.chrf_counts(_modes(spark, sf_dir), "hyp", "ref", "mode")).select("mode", F.round("chrf", 6).alias("chrf"))


@query()
def ter_corpus(spark, sf_dir):
    turns = _turn_pairs(spark, sf_dir)
    return M.ter(turns, "text", "parallel_text").select("edits", "ref_words", F.round("ter", 6).alias("ter"))


@query(f"SELECT 'bleu' AS metric, round(f.bleu - s.bleu, 6) AS delta FROM ({_bleu_sql('SELECT bleu FROM s', _FULL)}) AS f, ({_bleu_sql('SELECT bleu FROM s')}) AS s")
def mode_delta(spark, sf_dir):
    modes = _modes(spark, sf_dir)
    b = M.bleu(M.bleu_counts(modes, "hyp", "ref", "mode")).select("mode", F.lit("bleu").alias("metric"), F.col("bleu").alias("value"))
    return R.mode_delta(b, "full", "single").select("metric", F.round("delta", 6).alias("delta"))


@query(
    f"SELECT 'single' AS mode, 'bleu' AS metric, round(bleu, 6) AS value FROM ({_bleu_sql('SELECT bleu FROM s')}) UNION ALL SELECT mode, 'chrf', chrf FROM ({_chrf_sql('single', _HYP)}) "
    f"UNION ALL SELECT 'single', 'pfs', round(avg(a), 6) FROM ({_pfs_sql(_HYP, 'd JOIN documents USING (doc_id)')} SELECT a FROM q)"
)
def evaluation_report(spark, sf_dir):
    """The metrics of an evaluation from one pass over whole texts; edits, which SQL can't count, are left out."""
    from .operators import evaluation

    rows = decorated(spark, sf_dir, "text").select(F.lit("single").alias("mode"), F.col("t").alias("source"), F.expr(_HYP).alias("hypothesis"), F.col("text").alias("reference"))
    return evaluation.report(rows, edits=False).select("mode", "metric", F.round("value", 6).alias("value"))


def codemix_sql(source: str, columns: str) -> str:
    """source: SQL of rows with i, an id as text, and w, a text; new: w with some of its words in Latin letters, null if that changes nothing."""
    bn = _BN_SQL[1].format(t="p").replace("lambda p:", "lambda q:").replace("c[p[1]]", "c[q[1]]").replace("length(p) = 2", "length(q) = 2").replace("s[p[2]]", "s[q[2]]").replace("o[p], p)", "o[q], q)")
    return (
        f"{_BN_SQL[0]}, cm1 AS (SELECT *, string_split_regex({_TRIM.replace('text', 'w')}, '\\s+') AS ws FROM ({source})), "
        "cm2 AS (SELECT *, list_transform(range(0, len(ws)), lambda k: {'d': md5(concat('42|', i, '|', CAST(k AS VARCHAR))), 'k': k}) AS ds FROM cm1), cm3 AS (SELECT *, list_sort(ds)[greatest(1, floor(len(ws) * 0.3)::INT)] AS kth FROM cm2), "
        f"cm4 AS (SELECT *, list_transform(range(1, len(ws) + 1), lambda k: {{'p': ws[k], 'y': ds[k] <= kth}}) AS marked FROM cm3), cm AS (SELECT {columns}, w, CASE WHEN len(ws) >= 3 THEN array_to_string(list_transform(marked, lambda z: CASE WHEN z.y AND regexp_matches(z.p, '[\\x{{0980}}-\\x{{09FF}}]') THEN {bn.replace('regexp_extract_all(p,', 'regexp_extract_all(z.p,')} ELSE z.p END), ' ') END AS new FROM cm4, c)"
    )


_CM = "concat('আমি ভালো আছি ', text)"


@query("WITH " + codemix_sql(f"SELECT doc_id, CAST(doc_id AS VARCHAR) AS i, {_CM} AS w FROM documents", "doc_id") + " SELECT doc_id, new AS mixed FROM cm WHERE new <> w")
def synthetic_codemix(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", F.expr(_CM).alias("w"))
    return x.select("doc_id", C.where_known(C.code_mix(F.col("w"), F.col("doc_id"))).alias("mixed"))


_AUGMENTED = (
    f"SELECT i, w, rn FROM (SELECT i, w, row_number() OVER (ORDER BY md5(concat('42|', i)), i) AS rn, count(*) OVER () AS n FROM (SELECT concat('conversations_', conv_id, '-', turn) AS i, {_CM} AS w FROM pairs)) WHERE rn <= floor(n * CAST(0.08 AS DOUBLE))"
)


@query(f"WITH {_PAIRS}, " + codemix_sql(_AUGMENTED, "i, rn") + " SELECT concat(i, '_synthcm_', CAST(rn - 1 AS VARCHAR)) AS id, 'conversations+synthetic_codemix' AS source_dataset, new AS text, 'bn_en_mixed' AS text_lang, true AS is_synthetic FROM cm WHERE new <> w")
def augmented_rows(spark, sf_dir):
    rows = _turn_pairs(spark, sf_dir).withColumn("text", F.concat(F.lit("আমি ভালো আছি "), "text"))
    unified = C.unify(rows, "conversations", F.concat_ws("-", "conv_id", "turn"), C.TRANSLATION, F.col("text"), "bn", F.col("parallel_text"), "en")
    return C.augment(unified).select("id", "source_dataset", "text", "text_lang", "is_synthetic")


#: Each document's language stands for one of the sets that the samples come from, the benchmark for the last.
_SETS = {name: f"SELECT doc_id AS row_id, text FROM documents WHERE lang = '{x}'" for (name, *_), x in zip(C.PROXY_SAMPLES, ("en", "de", "fr", "es"), strict=False)} | {C.PROXY_SAMPLES[4][0]: "SELECT item_id AS row_id, text FROM benchmark"}
_SAMPLES = " UNION ALL ".join(
    f"SELECT * FROM (SELECT {k} AS k, row_id, text, '{name}' AS source_dataset, '{domain}' AS domain, '{language}' AS language_hint FROM ({_SETS[name]}) ORDER BY {_MD5.format(c='row_id')}, row_id LIMIT {n})" for k, (name, n, domain, language) in enumerate(C.PROXY_SAMPLES)
)


@query(f"WITH u AS ({_SAMPLES}) SELECT row_id, text, source_dataset, domain, language_hint FROM u WHERE {_VALID} QUALIFY row_number() OVER (PARTITION BY {_TRIM} ORDER BY k, row_id) = 1")
def proxy_samples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sets = {name: (docs.where(F.col("lang") == x), "text", "doc_id") for (name, *_), x in zip(C.PROXY_SAMPLES, ("en", "de", "fr", "es"), strict=False)}
    return C.proxy_set(sets | {C.PROXY_SAMPLES[4][0]: (table(spark, sf_dir, "benchmark"), "text", "item_id")})


_OCR = "concat('আমি ভালো আছি | সে ভালো l ', {c7}, ' é  ', {c9}, ' x', {nl}, text)"
_B = r"[\x{0980}-\x{09FF}]"
#: The danda rule without look-arounds: the letter after a mark is taken along, so every other mark waits for a second pass.
_DANDA = rf"regexp_replace({{t}}, '({_B})\s*[|Il1](?:\s*({_B}|$)|\s*(\s))', '\1।\2\3', 'g')".replace("{{t}}", "{t}")


def _ocr_sql() -> str:
    x = f"nfc_normalize({_OCR.format(c7='chr(7)', c9='chr(9)', nl='repeat(chr(10), 4)')})"
    x = f"regexp_replace({x}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
    for _ in range(2):
        x = _DANDA.replace("{t}", x)
    return f"SELECT doc_id, {_TRIM.replace('text', f'regexp_replace(regexp_replace({x}, {chr(39)}[ \\t]+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)}), {chr(39)}\\n{{{{3,}}}}{chr(39)}, chr(10) || chr(10), {chr(39)}g{chr(39)})'.replace('{{', '{').replace('}}', '}'), 1)} AS clean FROM documents"


@query(_ocr_sql())
def ocr_cleanup_rules(spark, sf_dir):
    from .operators.ocr import clean_text

    x = table(spark, sf_dir, "documents").select("doc_id", F.expr(_OCR.format(c7="char(7)", c9="char(9)", nl="repeat(char(10), 4)")).alias("t"))
    return x.select("doc_id", clean_text(F.col("t")).alias("clean"))


@query("SELECT user_id, round(coalesce(avg(CASE WHEN value >= 0 AND event_id % 9 <> 0 THEN value / 100 ELSE 0 END), 0), 9) AS avg_confidence FROM events GROUP BY 1")
def ocr_confidence(spark, sf_dir):
    raw = F.when(F.col("event_id") % 9 == 0, "n/a").otherwise(F.col("value").cast("string"))
    e = table(spark, sf_dir, "events").select("user_id", X.ocr_confidence(raw).alias("c"))
    return e.groupBy("user_id").agg(F.round(F.coalesce(F.avg("c"), F.lit(0.0)), 9).alias("avg_confidence"))


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 500")
def topic_quota(spark, sf_dir):
    return R.quota(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), ["event_type"], 500, [F.col("ts"), F.col("event_id")]).select("event_id", "event_type")


@query("SELECT event_type, greatest(0, 500 - count(*)) AS remaining FROM events GROUP BY 1")
def quota_remaining(spark, sf_dir):
    return R.remaining(table(spark, sf_dir, "events"), ["event_type"], 500)


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0")
def id_dedupe(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return R.unseen(e.union(e), e.where("event_id % 3 = 0"), "event_id")


@query("SELECT event_type, least(500, count(DISTINCT event_id))::BIGINT AS kept FROM events GROUP BY 1")
def stream_dedupe_quota(spark, sf_dir):
    from .streaming.ingest import stream_quota_counts

    return stream_quota_counts(spark, f"{sf_dir}/events.parquet", "event_id", "event_type", 500, "ts", "30 days")


@query(f"SELECT doc_id, substr(sha256(text), 1, 16) AS image_hash, CASE WHEN {_GATE_L} IN ('bn', 'en') AND {_CONF} >= 0.5 THEN 'accepted' ELSE 'rejected' END AS routing_decision FROM documents")
def gate_log_append(spark, sf_dir):
    from .sources.sinks import append_log, decision_log

    x = table(spark, sf_dir, "documents").withColumns({"language": F.expr(f"CASE WHEN {_GATE_L} IN ('bn', 'en') AND {_CONF} >= 0.5 THEN {_GATE_L} ELSE 'unsupported' END")})
    rows = decision_log(x.select("doc_id", F.col("text").cast("binary").alias("content"), "language"), "doc_id")
    # two appends, as two runs would make
    path = fresh(spark, "banyan-log")
    for part in ("accepted", "rejected"):
        append_log(rows.where(F.col("routing_decision") == part), path)
    return spark.read.schema("doc_id long, image_hash string, routing_decision string, timestamp string").json(path).drop("timestamp")


@query("SELECT c_custkey % 3 AS k, 'engine' || CAST(e AS VARCHAR) AS engine, count(*) AS cnt FROM customer, range(0, 3) AS r(e) GROUP BY ALL")
def engine_fan_out(spark, sf_dir):
    return R.fan_out(table(spark, sf_dir, "customer"), [f"engine{i}" for i in range(3)]).groupBy((F.col("c_custkey") % 3).alias("k"), "engine").agg(F.count("*").alias("cnt"))


def _translate_sql(fast: bool) -> str:
    """Engines that return their input: the one with the shortest name wins, and a round trip returns its text."""
    slang = (
        f"array_to_string(list_transform(regexp_extract_all(t, '{_W}+|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+'), lambda w: CASE WHEN m[lower(w)] IS NULL THEN w WHEN upper(w) = w AND lower(w) <> w THEN upper(m[lower(w)]) "
        "WHEN upper(w[1]) = w[1] AND lower(w[1]) <> w[1] THEN concat(upper(m[lower(w)][1]), m[lower(w)][2:]) ELSE m[lower(w)] END), '')"
    )
    latin = f"array_to_string(list_transform(regexp_extract_all(n, '[A-Za-z]+|[^A-Za-z]+'), lambda p: CASE WHEN regexp_matches(p, '^[A-Za-z]') THEN array_to_string(list_transform(regexp_extract_all(p, '(?i){'|'.join(T.LATIN)}|.'), lambda x, i: coalesce(CASE WHEN i = 1 THEN f[lower(x)] END, r[lower(x)], x)), '') ELSE p END), '')"
    words = lambda c: f"list_distinct(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"
    share = f"CASE WHEN len({words('work')}) = 0 THEN 1.0 ELSE len(list_intersect({words('work')}, {words('pre')})) / len({words('work')})::DOUBLE END"
    end = (
        "SELECT doc_id AS id, pre AS translation, final, false AS low_confidence, 'nllb' AS winning_engine, 'skipped_fast_mode' AS qe_method, NULL::DOUBLE AS qe_score FROM z"
        if fast
        else "SELECT doc_id AS id, pre AS translation, final, pre IS NULL OR sim < 0.85 AS low_confidence, CASE WHEN pre IS NOT NULL THEN 'nllb' END AS winning_engine, CASE WHEN pre IS NULL THEN 'none' ELSE 'logprob_fallback' END AS qe_method, CASE WHEN pre IS NOT NULL THEN -4.0::DOUBLE END AS qe_score FROM z"
    )
    return (
        f"WITH {_D}, m AS (SELECT {sql_map(T.SLANG)} AS m, {sql_map(T.LATIN)} AS r, {sql_map(T.FIRST_VOWELS)} AS f), n AS (SELECT doc_id, t, {slang} AS n FROM d, m), w AS (SELECT doc_id, t, CASE WHEN regexp_matches(n, '[A-Za-z]') AND NOT regexp_matches(n, '{_BN}') THEN {latin} ELSE n END AS work FROM n, m), "
        f"p AS (SELECT *, nullif({_SAN.format(c='work')}, '') AS pre FROM w), y AS (SELECT *, {tok('t')} AS k, {share} AS sim FROM p), z AS (SELECT doc_id, pre, sim, CASE WHEN pre IS NOT NULL THEN {reassemble_sql('pre', 'k')} END AS final FROM y) "
    ) + end


_SHOWN = ("id", "translation", "final", "low_confidence", "winning_engine", "qe_method", "qe_score")


@query(_translate_sql(False))
def translate_quality(spark, sf_dir):
    return translate(decorated(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("t").alias("text")), "bn2en").select(*_SHOWN)


@query(_translate_sql(True))
def translate_fast(spark, sf_dir):
    return translate(decorated(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("t").alias("text")), "bn2en", fast_mode=True).select(*_SHOWN)
