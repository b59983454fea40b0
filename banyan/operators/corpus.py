"""Corpus building: unified rows, dedupe, samples, splits, synthetic rows, training pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .numbering import by_digest

UNIFIED = (
    "id STRING, source_dataset STRING, pair_type STRING, text STRING, text_lang STRING, parallel_text STRING, parallel_lang STRING, romanized_text STRING, "
    "register STRING, hashtags ARRAY<STRING>, emojis ARRAY<STRING>, mentions ARRAY<STRING>, is_code_mixed BOOLEAN, is_romanized_bn BOOLEAN, task_labels STRING, license STRING, is_proxy_test_set BOOLEAN"
)
TRANSLATION = "bn_en_translation"


def unify(
    df: DataFrame, source: str, idx: Column, pair_type: str, text: Column, text_lang: str | Column, parallel_text: Column | None = None, parallel_lang: str | None = None, romanized_text: Column | None = None,
    register: str = "social_media", task_labels: Column | None = None, license: str = "unknown", extract: bool = True, is_proxy: bool = False, is_romanized: bool = False,
) -> DataFrame:
    """Rows with valid text in the unified schema. Without extract, text isn't searched for social fields."""
    null = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    optional = lambda c: null if c is None else X.nan_to_null(c.cast("string"))
    text = text.cast("string")
    fields = {"hashtags": X.hashtags(text), "emojis": X.emojis(text), "mentions": X.mentions(text), "is_code_mixed": X.is_code_mixed(text)}
    if not extract:
        fields = {k: empty for k in ("hashtags", "emojis", "mentions")} | {"is_code_mixed": F.lit(False)}
    columns = {
        "id": F.concat_ws("_", F.lit(source), idx.cast("string")), "source_dataset": F.lit(source), "pair_type": F.lit(pair_type), "text": text, "text_lang": text_lang if isinstance(text_lang, Column) else F.lit(text_lang),
        "parallel_text": optional(parallel_text), "parallel_lang": F.lit(parallel_lang).cast("string"), "romanized_text": optional(romanized_text), "register": F.lit(register),
        **fields, "is_romanized_bn": F.lit(is_romanized), "task_labels": null if task_labels is None else task_labels, "license": F.lit(license), "is_proxy_test_set": F.lit(is_proxy),
    }
    return df.where(X.is_valid(text)).select(*[c.alias(k) for k, c in columns.items()])


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Counts of each group and, with null keys, of all above."""
    return df.rollup(*keys).agg(F.count("*").alias("cnt"))


def first_wins(df: DataFrame, key: Column, order: Column, long: bool = False) -> DataFrame:
    """The first row of each key, whole. Aggregated by each task before rows meet, so a common key is no burden. long: keys are texts, which go by their SHA-256 and aren't shuffled beside the rows that hold them."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy((F.sha2(key, 256) if long else key).alias("_key")).agg(F.min_by(row, order).alias("_row")).select("_row.*")


def valid_first_wins(df: DataFrame, text: str, order: str) -> DataFrame:
    """Rows with valid text, the first of each text without outer white space; kept texts stay as they are."""
    return first_wins(df.where(X.is_valid(F.col(text))), X.strip(F.col(text)), F.col(order), long=True)


def proxy_ids(df: DataFrame, position: str) -> DataFrame:
    """Ids from positions, for rows held as a proxy test set."""
    return df.withColumns({"id": F.format_string("proxy_%06d", F.col(position)), "is_proxy_test_set": F.lit(True)})


def cap_per_key(df: DataFrame, key: str, cap: int, id_col: str, seed: int = 42) -> DataFrame:
    """At most cap rows of each key, chosen by digest; Spark keeps cap rows a key in each task before keys meet."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    at = F.row_number().over(Window.partitionBy(key).orderBy(digest, id_col))
    return df.withColumn("_rn", at).where(F.col("_rn") <= cap).drop("_rn")


def sample_n(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """n rows (or all) without replacement, the lowest by digest."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string"))), id_col).limit(n)


def sample_fraction(df: DataFrame, fraction: float, id_col: str, seed: int = 42) -> DataFrame:
    """int(rows * fraction) rows, chosen by digest."""
    return by_digest(df, [], seed, id_col, "_rn", "_n").where(F.col("_rn") <= F.floor(F.col("_n") * F.lit(fraction))).drop("_rn", "_n")


def split_name(rn: Column, n: Column, train: float = 0.85, val: float = 0.075) -> Column:
    a, b = F.floor(n * F.lit(train)), F.floor(n * F.lit(val))
    return F.when(rn <= a, "train").when(rn <= a + b, "val").otherwise("test")


def stratified_split(df: DataFrame, source: str, id_col: str, seed: int = 42, proxy: Column | None = None) -> DataFrame:
    """Adds split: train, val or test by exact shares of each source, in an order that every run repeats; proxy rows go to test."""
    if proxy is None:
        return by_digest(df, [source], seed, id_col, "_rn", "_n").withColumn("split", split_name(F.col("_rn"), F.col("_n"))).drop("_rn", "_n")
    marked = df.withColumn("_proxy", F.coalesce(proxy, F.lit(False)))
    rest = stratified_split(marked.where(~F.col("_proxy")), source, id_col, seed)
    return rest.unionByName(marked.where("_proxy").withColumn("split", F.lit("test"))).drop("_proxy")


def without_leaks(df: DataFrame, proxy: DataFrame, text: str = "text") -> DataFrame:
    """df without rows whose text stands in proxy."""
    return df.join(proxy.select(text).distinct(), text, "left_anti")


def code_mix(text: Column, id_col: Column, share: float = 0.3, seed: int = 42) -> Column:
    """Text with a share of its words (one at least) in Latin letters; null under three words or if nothing changed."""
    words = F.split(X.strip(text), r"(?U)\s+")
    digest = lambda i: F.struct(F.md5(F.concat(F.lit(f"{seed}|"), id_col.cast("string"), F.lit("|"), i.cast("string"))).alias("d"), i.alias("i"))
    # the share's words are those up to a digest: one comparison a word
    last = lambda ds: F.get(F.sort_array(ds), F.greatest(F.lit(1), F.floor(F.size(ds) * F.lit(share)).cast("int")) - 1)
    latin = lambda x: F.when(X.has_bengali(x), X.bn_to_latin(x)).otherwise(x)
    chosen = lambda w, ds, k: F.array_join(F.zip_with(w, ds, lambda x, d: F.when(d <= k, latin(x)).otherwise(x)), " ")
    mixed = lambda w: X.bind(F.transform(w, lambda x, i: digest(i)), lambda ds: X.bind(last(ds), lambda k: chosen(w, ds, k)))

    new = X.bind(words, lambda w: F.when(F.size(w) >= 3, mixed(w)))
    return X.bind(new, lambda n: F.when(n != text, n))


def where_known(column: Column) -> Column:
    """A generator of the column's value where it isn't null: unlike a filter on it, which would be moved below and compute it twice."""
    return F.explode(F.array_compact(F.array(column)))


def augment(df: DataFrame, fraction: float = 0.08, seed: int = 42) -> DataFrame:
    """Synthetic code-mixed rows from a fraction of Bengali translation rows in the unified schema; ids count sampled rows, skipped ones included."""
    eligible = df.where((F.col("pair_type") == TRANSLATION) & (F.col("text_lang") == "bn"))
    sampled = by_digest(eligible, [], seed, "id", "_rn", "_n").where(F.col("_rn") <= F.floor(F.col("_n") * F.lit(fraction)))
    new = sampled.select("*", where_known(code_mix(F.col("text"), F.col("id"), seed=seed)).alias("_new"))
    return new.withColumns({
        "id": F.concat(F.col("id"), F.lit("_synthcm_"), (F.col("_rn") - 1).cast("string")), "source_dataset": F.concat(F.col("source_dataset"), F.lit("+synthetic_codemix")),
        "text": F.col("_new"), "text_lang": F.lit("bn_en_mixed"), "is_code_mixed": F.lit(True), "is_synthetic": F.lit(True),
    }).drop("_rn", "_n", "_new")


def translation_pairs(df: DataFrame, direction: str, max_rows: int | None = None, order: str | None = None, target: str = "target", exclude_synthetic: bool = False) -> DataFrame:
    """source and target of translation rows, cleaned; the first max_rows in order (none and 0: all)."""
    rows = df.where((F.col("pair_type") == TRANSLATION) & (F.col("text") != "") & (F.col("parallel_text") != ""))
    if exclude_synthetic and "is_synthetic" in df.columns:
        rows = rows.where(~F.coalesce("is_synthetic", F.lit(False)))
    a, b = ("text", "parallel_text") if direction == "bn2en" else ("parallel_text", "text")
    out = rows.select(*([F.col(order)] if order else []), X.sanitize(F.col(a)).alias("source"), X.sanitize(F.col(b)).alias(target)).where((F.col("source") != "") & (F.col(target) != ""))
    if max_rows:
        out = (out.orderBy(order) if order else out).limit(max_rows)
    return out


# The samples of the proxy test set: name, rows, domain, language.
PROXY_SAMPLES = (
    ("banth", 800, "youtube_comment", "bn_transliterated"), ("bnsentmix", 800, "facebook_youtube_ecommerce", "bn_en_code_mixed"), ("sentmix_3l", 400, "social_media", "bn_en_hi_code_mixed"),
    ("emomix_3l", 400, "social_media", "bn_en_hi_code_mixed"), ("en_bn_code_mixed_sentiment", 600, "review", "bn_en_code_mixed"),
)


def proxy_set(sources: dict[str, tuple[DataFrame, str, str]], seed: int = 42) -> DataFrame:
    """The tagged samples' union: by the sample's name a frame, its text's column and its id's; the first of each text stays, by sample and then id."""
    parts = []
    for k, (name, n, domain, language) in enumerate(PROXY_SAMPLES):
        if name not in sources:
            continue
        df, text, row_id = sources[name]
        rows = sample_n(df.select(F.col(text).cast("string").alias("text"), F.col(row_id).cast("long").alias("row_id")), n, "row_id", seed)
        parts.append(rows.withColumns({"source_dataset": F.lit(name), "domain": F.lit(domain), "language_hint": F.lit(language), "_at": F.struct(F.lit(k).alias("k"), F.col("row_id").alias("r"))}))
    every = union_all(*parts)
    return first_wins(every.where(X.is_valid(F.col("text"))), X.strip(F.col("text")), F.col("_at"), long=True).drop("_at")


def infer_column(columns: list[str], *parts: str) -> str:
    """The first column whose lower-case name holds one of parts, else the first."""
    return next((c for c in columns if any(p in c.lower() for p in parts)), columns[0])


def flatten_tweets(df: DataFrame, topic: Column) -> DataFrame:
    """Flat rows of nested tweets; new lines in texts become spaces, hashtags are joined by semicolons."""
    return df.select(
        F.col("id").cast("string").alias("id"), topic.alias("topic"), "lang", F.col("createdAt").alias("created_at"), F.trim(F.replace("text", F.lit("\n"), F.lit(" "))).alias("text"),
        F.array_join("entities.hashtags.text", ";").alias("hashtags"), F.col("author.userName").alias("username"), F.col("author.name").alias("author_name"),
        F.col("likeCount").alias("like_count"), F.col("retweetCount").alias("retweet_count"), F.col("replyCount").alias("reply_count"), F.col("viewCount").alias("view_count"), "url",
    )
