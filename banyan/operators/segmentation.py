"""Word frequencies and hashtag segmentation."""

from __future__ import annotations

import math
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..sources.storage import bounded_batches, kept_table, stored

#: Words a dictionary keeps at most: what is broadcast stays bounded.
TOP = 200_000
LONGEST = 20


def word_counts(df: DataFrame, *columns: str) -> DataFrame:
    """word and cnt over all rows: runs of Latin or Bengali letters of two code points or more, in lower case."""
    every = F.flatten(F.array(*[X.find_all(F.coalesce(c, F.lit("")), P.WORD) for c in columns]))
    return df.select(F.explode(every).alias("w")).where(F.length("w") >= 2).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("cnt"))


def top_words(counts: DataFrame, k: int = TOP) -> DataFrame:
    return counts.orderBy(F.desc("cnt"), "word").limit(k)


def kept_dictionary(spark: SparkSession, path: str, texts, k: int = TOP) -> DataFrame:
    """The dictionary at path; where it isn't there, the k most frequent words of what texts() gives (a frame with column text), kept there."""
    return kept_table(spark, path, lambda: top_words(word_counts(texts(), "text"), k))


def word_costs(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word and cost of words: log(total / count), or log(total) + 2 a code point if unseen."""
    total = dictionary.agg(F.sum("cnt")).first()[0] or 1
    joined = words.withColumn("_low", F.lower("word")).join(dictionary.withColumnRenamed("word", "_low"), "_low", "left")
    cost = F.when(F.col("cnt").isNull(), F.lit(math.log(total)) + 2 * F.length("word")).otherwise(F.log(F.lit(total) / F.col("cnt")))
    return joined.select("word", cost.alias("cost"))


def costs_of(counts: dict[str, int]) -> tuple[dict[str, float], float]:
    """Each word's cost, and what an unseen word costs besides 2 a code point."""
    total = sum(counts.values()) or 1
    return {w: math.log(total / n) for w, n in counts.items() if n}, math.log(total)


class Splitter:
    """The cheapest splits of words; of equal ones, that with the longest last word.

    Least costs of a word's heads are those of any other word with this head, so
    they are kept for the next word: words that come in order cost little each.
    """

    def __init__(self, costs: dict[str, float], unseen: float, longest: int = LONGEST):
        self.costs, self.longest = costs, longest
        self.plain = [unseen + 2 * n for n in range(longest + 1)]
        self.low, self.best, self.cuts = "", [0.0], [0]

    def __call__(self, word: str) -> list[str]:
        low = word.lower()
        if len(low) != len(word):
            return self._parts(word, self._solved(word, 0, [0.0], [0], lambda a, b: word[a:b].lower())[1])
        shared = len(os.path.commonprefix((low, self.low)))
        self.best, self.cuts = self._solved(word, shared, self.best[: shared + 1], self.cuts[: shared + 1], None, low)
        self.low = low
        return self._parts(word, self.cuts)

    def _solved(self, word: str, done: int, best: list[float], cuts: list[int], part, low: str | None = None) -> tuple[list[float], list[int]]:
        known, plain = self.costs.get, self.plain
        for end in range(done + 1, len(word) + 1):
            least, cut = math.inf, 0
            for start in range(max(0, end - self.longest), end):
                before = best[start]
                # no word costs less than nothing
                if before >= least:
                    continue
                cost = known(part(start, end) if low is None else low[start:end])
                cost = before + (plain[end - start] if cost is None else cost)
                if cost < least:
                    least, cut = cost, start
            best.append(least)
            cuts.append(cut)
        return best, cuts

    @staticmethod
    def _parts(word: str, cuts: list[int]) -> list[str]:
        parts, end = [], len(word)
        while end:
            parts.append(word[cuts[end] : end])
            end = cuts[end]
        return parts[::-1]


def viterbi(word: str, costs: dict[str, float], unseen: float, longest: int = LONGEST) -> list[str]:
    """The cheapest split of word; of equal ones, that with the longest last word."""
    return Splitter(costs, unseen, longest)(word)


def costed(dictionary: DataFrame) -> tuple[DataFrame, float]:
    """word and cost of the dictionary's TOP words, and what an unseen word costs besides 2 a code point."""
    top = top_words(dictionary)
    total = top.agg(F.sum("cnt")).first()[0] or 1
    return top.where("cnt > 0").select("word", F.log(F.lit(total) / F.col("cnt")).alias("cost")), math.log(total)


def split_words(df: DataFrame, word: str, costs: DataFrame, unseen: float, longest: int = LONGEST) -> DataFrame:
    """word and parts: each different word with its cheapest split, as viterbi gives it, without Python.

    Parts of a word that may be words of the dictionary meet it by broadcast
    (TOP words); those that are, at most longest a place, come back to the word,
    and a fold over its places keeps the least cost and the start of the last
    word up to each.
    """
    low = F.lower("w")
    part = lambda a, n: F.when(F.length(low) == F.length("w"), F.substring(low, a + 1, n)).otherwise(F.lower(F.substring("w", a + 1, n)))
    # read twice: once for the parts, once for what they come back to
    words = stored(df.select(F.col(word).alias("w")).where(F.col("w").isNotNull()).distinct(), "banyan-words")
    starts = words.select("w", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("w") - 1))).alias("a")).where(F.length("w") > 0)
    sizes = starts.select("w", "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("w") - F.col("a")))).alias("n"))
    known = sizes.withColumn("word", part(F.col("a"), F.col("n"))).join(F.broadcast(costs), "word")
    # a place's number is its end, and below that its size
    place = lambda end, n: end * (longest + 1) + n
    found = known.groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct(place(F.col("a") + F.col("n"), F.col("n")).alias("k"), F.col("cost").alias("c")))).alias("m"))
    every = words.join(found, "w", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<int,double>")))

    def step(acc: Column, end: Column) -> Column:
        one = lambda n: F.struct((F.element_at(acc["best"], end - n + 1) + F.coalesce(F.col("m")[place(end, n)], F.lit(unseen) + 2 * n)).alias("c"), (end - n).alias("a"))
        # of equal costs the least start
        least = F.array_min(F.transform(F.sequence(F.least(F.lit(longest), end), F.lit(1), F.lit(-1)), one))
        return X.bind(least, lambda x: F.struct(F.concat(acc["best"], F.array(x["c"])).alias("best"), F.concat(acc["cuts"], F.array(x["a"])).alias("cuts")))

    start = F.struct(F.array(F.lit(0.0)).alias("best"), F.array(F.lit(0)).alias("cuts"))
    ends = F.when(F.length("w") > 0, F.sequence(F.lit(1), F.length("w"))).otherwise(F.array().cast("array<int>"))
    cuts = every.select("w", F.aggregate(ends, start, step, lambda acc: acc["cuts"]).alias("cuts"), ends.alias("ends"))

    def back(acc: Column, end: Column) -> Column:
        cut = F.element_at(F.col("cuts"), end + 1)
        return F.when(end == acc["at"], F.struct(cut.alias("at"), F.concat(F.array(F.substring("w", cut + 1, end - cut)), acc["parts"]).alias("parts"))).otherwise(acc)

    none = F.struct(F.length("w").alias("at"), F.array().cast("array<string>").alias("parts"))
    return cuts.select(F.col("w").alias(word), F.aggregate(F.reverse("ends"), none, back, lambda acc: acc["parts"]).alias("parts"))


def segmented(df: DataFrame, tag: str, dictionary: DataFrame, name: str = "words") -> DataFrame:
    """df with the words of a column of hashtags: by capitals, else by the cheapest split; each different tag is split once and joined back. segmenter gives the same as a column."""
    costs, unseen = costed(dictionary)
    raw = X.without_hash(F.col(tag))
    rows = df.withColumns({"_raw": raw, "_camel": X.camel_split(raw)})
    rest = F.when((F.size("_camel") <= 1) & (F.col("_raw") != ""), F.col("_raw"))
    split = split_words(rows.select(rest.alias("_split")), "_split", costs, unseen)
    joined = rows.withColumn("_split", rest).join(split, "_split", "left")
    words = F.when(F.col("_raw") == "", F.array().cast("array<string>")).when(F.size("_camel") > 1, F.col("_camel")).otherwise(F.col("parts"))
    return joined.withColumn(name, words).select(*[f"`{c}`" for c in df.columns], name)


def segmenter(dictionary: DataFrame):
    """Column function from hashtags to words; the dictionary, TOP words at most, goes to all workers once."""
    bounded_batches(dictionary.sparkSession)
    rows = top_words(dictionary).collect()
    counts = {r.word: r.cnt for r in rows}
    shared = dictionary.sparkSession.sparkContext.broadcast(costs_of(counts))

    @F.pandas_udf("array<string>")
    def by_cost(tags: pd.Series) -> pd.Series:
        split = Splitter(*shared.value)
        # in order, so that words share what is known of their heads
        found = {t: split(t) for t in sorted(t for t in tags.unique() if t is not None)}
        return tags.map(lambda t: None if t is None else found[t])

    def segment(tag: Column) -> Column:
        raw = X.without_hash(tag)
        camel = X.camel_split(raw)
        # a Python function runs for every row it is given, so rows that the first rule settles give it null
        rest = by_cost(F.when((F.size(camel) <= 1) & (raw != ""), raw))
        return F.when(raw == "", F.array().cast("array<string>")).when(F.size(camel) > 1, camel).otherwise(rest)

    return segment
