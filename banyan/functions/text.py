"""Text operators as Column expressions: no Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import tables as T


def bind(value: Column, body) -> Column:
    """body(value), with value computed once a row: an expression named inside a lambda would run for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def mapping(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"(?U)^\s++|{P.AT_END}", "")


def is_valid(text: Column) -> Column:
    """Neither null, nor white space alone, nor 'nan' in any case."""
    return text.isNotNull() & (F.regexp_replace(text, P.SPACE, "") != "") & (F.lower(text) != "nan")


def nan_to_null(text: Column) -> Column:
    return F.when(F.lower(text) != "nan", text)


def has_bengali(text: Column) -> Column:
    return text.rlike(P.BENGALI)


def has_latin(text: Column) -> Column:
    return text.rlike(P.LATIN)


def is_code_mixed(text: Column) -> Column:
    return has_bengali(text) & has_latin(text)


def is_romanised(text: Column) -> Column:
    """Latin letters and no Bengali ones."""
    return has_latin(text) & ~has_bengali(text)


def hashtags(text: Column) -> Column:
    return find_all(F.coalesce(text, F.lit("")), P.HASHTAG, 1)


def mentions(text: Column) -> Column:
    return find_all(F.coalesce(text, F.lit("")), P.MENTION, 1)


def emojis(text: Column) -> Column:
    """Single code points: parts of a sequence come one by one."""
    return find_all(F.coalesce(text, F.lit("")), P.EMOJI_CHAR)


def _kind(t: Column) -> Column:
    """Of a token. Most start with an ASCII letter and need one comparison."""
    first = F.substring(t, 1, 1)
    letter = first.between("a", "z") | first.between("A", "Z")
    url = first.isin("h", "w") & t.rlike(r"^(https?://|www\.).")
    return (
        F.when(letter, F.when(url, "url").otherwise("word"))
        .when(t.rlike(rf"^{P.EMOJI}$"), "emoji")
        .when((first == "#") & (F.length(t) > 1), "hashtag")
        .when((first == "@") & (F.length(t) > 1), "mention")
        .when(t.rlike(r"(?U)^\w"), "word")
        .otherwise("punct")
    )


def _with_kind(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.struct(t.alias("token"), _kind(t).alias("kind")))


def tokenize(text: Column) -> Column:
    """Array of (token, kind); kinds: url, hashtag, mention, emoji, word, punct."""
    return _with_kind(find_all(F.coalesce(text, F.lit("")), P.TOKEN))


def protected(text: Column) -> Column:
    """tokenize without words and punctuation, which aren't looked for."""
    return _with_kind(find_all(F.coalesce(text, F.lit("")), P.PROTECTED))


def of_kind(tokens: Column, *kinds: str) -> Column:
    return F.transform(F.filter(tokens, lambda x: x["kind"].isin(*kinds)), lambda x: x["token"])


def protected_spans(text: Column) -> Column:
    """Hashtags, mentions, URLs and emoji in order."""
    return find_all(F.coalesce(text, F.lit("")), P.PROTECTED)


def _cased_as(word: Column, new: Column) -> Column:
    """new in capitals if word is, with a capital if word has one first."""
    first = F.substring(word, 1, 1)
    return (
        F.when((F.upper(word) == word) & (F.lower(word) != word), F.upper(new))
        .when((F.upper(first) == first) & (F.lower(first) != first), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, 1 << 30)))
        .otherwise(new)
    )


def normalize_slang(text: Column, extra: dict[str, str] | None = None, phrases: bool = False) -> Column:
    """Known words replaced, in the case that they had. extra goes before the table; phrases: keys of several words as well."""
    table = {**T.SLANG, **(extra or {})}
    if phrases:
        for k in sorted((k for k in table if " " in k), key=len, reverse=True):
            text = F.regexp_replace(text, rf"(?iU)\b{k}\b", table[k])
    known, words = mapping(table), [k for k in table if " " not in k]

    def one(w: Column) -> Column:
        # a set tells most words apart before the map is searched
        return F.when(F.lower(w).isin(words), _cased_as(w, F.try_element_at(known, F.lower(w)))).otherwise(w)

    return F.array_join(F.transform(find_all(text, P.WORD_OR_GAP), one), "")


def bn_to_latin(text: Column, fix_nukta: bool = False) -> Column:
    """Consonants take the sound of the sign after them, none before a virama, else 'o'."""
    consonants = T.CONSONANTS | (T.NUKTA if fix_nukta else {})
    if fix_nukta:
        for joined, letter in (("ড়", "ড"), ("ঢ়", "ঢ"), ("য়", "য")):
            text = F.replace(text, F.lit(letter + "়"), F.lit(joined))
    letters, after = mapping(consonants), mapping(T.SIGNS | {T.VIRAMA: ""})
    others = mapping(T.VOWELS | T.MARKS | T.DIGITS)
    # what has no Bengali letter passes in runs
    pieces = find_all(text, f"(?s)[{''.join(consonants)}][{T.VIRAMA}{''.join(T.SIGNS)}]?|[^\\x{{0980}}-\\x{{09FF}}０]+|.")

    def one(p: Column) -> Column:
        base = F.try_element_at(letters, F.substring(p, 1, 1))
        sound = F.when(F.length(p) == 2, F.try_element_at(after, F.substring(p, 2, 1))).otherwise("o")
        return F.coalesce(F.concat(base, sound), F.try_element_at(others, p), p)

    return F.array_join(F.transform(pieces, one), "")


#: Stands before a vowel that starts a run of Latin letters; texts that have it themselves keep it.
_START = "\ufdd0"


def latin_to_bn(text: Column) -> Column:
    """Runs of Latin letters by the first spelling that fits; a vowel that starts a run has its own form.

    Spellings are replaced in the whole text one after another.  Where the end of
    one is the start of another, the one that would be read first goes first.
    """
    letters = "".join(sorted({c for k in T.LATIN for c in k}))
    text = F.regexp_replace(F.translate(text, letters.upper(), letters), "(?<![A-Za-z])(?=[aeiou])", _START)
    by_length = lambda d: sorted(d, key=lambda k: -len(k))
    for k in by_length(T.FIRST_VOWELS):
        text = F.replace(text, F.lit(_START + k), F.lit(T.FIRST_VOWELS[k]))
    reachable = [k for i, k in enumerate(T.LATIN) if not any(k.startswith(x) for x in list(T.LATIN)[:i])]
    # k goes before x if it may take x's first letter
    pairs = [k for k in reachable if len(k) > 1]
    for k in sorted(pairs, key=lambda k: not any(k != x and k[-1] == x[0] for x in pairs)):
        text = F.replace(text, F.lit(k), F.lit(T.LATIN[k]))
    single = {k: T.LATIN[k] for k in reachable if len(k) == 1}
    for k, new in single.items():
        if len(new) > 1:
            text = F.replace(text, F.lit(k), F.lit(new))
    single = {k: new for k, new in single.items() if len(new) == 1}
    return F.translate(text, "".join(single), "".join(single.values()))


def sanitize(text: Column) -> Column:
    for x in T.ARTIFACTS:
        text = F.replace(text, F.lit(x), F.lit(""))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def camel_split(tag: Column) -> Column:
    return find_all(tag, P.CAMEL)


def without_hash(tag: Column) -> Column:
    """Without one leading #."""
    return F.regexp_replace(tag, "^#", "")


def bengali_ratio(text: Column) -> Column:
    """Bengali code points among those and ASCII letters; 0.0 if there are none."""
    # runs go at once, which is faster than to count letter by letter
    count = lambda p: F.length(text) - F.length(F.regexp_replace(text, f"{p}+", ""))
    bn, en = count(P.BENGALI), count(P.LATIN)
    return F.when(bn + en > 0, bn / (bn + en)).otherwise(F.lit(0.0))


def rebuild_hashtag(original: Column, words: Column, language: Column) -> Column:
    kept = F.filter(words, lambda w: w.isNotNull() & (w != ""))
    capital = F.transform(kept, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    return F.when(F.size(kept) == 0, original).otherwise(F.concat(F.lit("#"), F.array_join(F.when(language == "en", capital).otherwise(kept), "")))


def reassemble(tokens: Column, translated: Column, rebuilt: Column) -> Column:
    """Folds the source's tokens into a translation. rebuilt: map of hashtag to its rebuilt form.

    A hashtag's every occurrence goes and the rebuilt one comes last; mentions,
    URLs and emoji are appended where the text so far doesn't contain them.
    """
    rstrip = lambda x: F.regexp_replace(x, f"(?U){P.AT_END}", "")

    def step(acc: Column, t: Column) -> Column:
        token = t["token"]
        gone = F.when(F.contains(acc, token), rstrip(F.replace(acc, token, F.lit("")))).otherwise(acc)
        tag = F.concat(rstrip(gone), F.lit(" "), F.coalesce(F.try_element_at(rebuilt, token), token))
        return F.when(t["kind"] == "hashtag", tag).when(t["kind"].isin("mention", "url", "emoji") & ~F.contains(acc, token), F.concat(rstrip(acc), F.lit(" "), token)).otherwise(acc)

    return F.aggregate(tokens, translated, step)


def ocr_rules(text: Column) -> Column:
    """The rules after Unicode composition: control characters, danda, spaces, blank lines."""
    for pattern, by in ((P.CONTROL, ""), (P.DANDA, "।"), ("[ \t]+", " "), ("\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, by)
    return strip(text)


def tag_languages(text: Column, source: Column, target: Column) -> Column:
    return F.concat_ws(" ", source, target, text)


def postedit_system(language: Column) -> Column:
    """The rules of post-editing, for the model's system part."""
    return F.concat(F.lit("You correct machine translations of social posts into "), language, F.lit(". You change wording for fluency alone: the meaning stays the same, no information is added and none is left out, and every protected token stays exactly as it is. Answer with the sentence and nothing else: no explanation, no quotation marks, no comment."))


def postedit_prompt(source: Column, candidate: Column, protected: Column, language: Column) -> Column:
    """The user's part of a post-editing prompt."""
    quoted = F.when(F.size(protected) == 0, "(none)").otherwise(F.array_join(F.transform(protected, lambda p: F.concat(F.lit('"'), p, F.lit('"'))), ", "))
    # The wording of the prompt.
    return F.concat(
        F.lit("Original source text:\n"), source, F.lit("\n\nMachine-translated candidate ("), language, F.lit("):\n"), candidate,
        F.lit("\n\nProtected tokens that must appear unchanged in your output, exactly as written (emoji, hashtags, mentions, URLs): "), quoted,
        F.lit("\n\nImprove fluency and naturalness only. Preserve meaning exactly. Do not add or remove information. Do not modify the protected tokens listed above. Return only the corrected sentence."),
    )


def missing_tokens(edited: Column, protected: Column) -> Column:
    """Those of protected that edited doesn't contain, in order."""
    return F.filter(protected, lambda p: ~F.contains(edited, p))


def image_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def ocr_confidence(raw: Column) -> Column:
    """Percent as a share; 0.0 for what is negative or no number."""
    x = raw.cast("string").try_cast("double")
    return F.when(x >= 0, x / 100).otherwise(F.lit(0.0))


def utc_now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
