"""Golden rows of the text operators."""

import random

import pytest
from pyspark.sql import functions as F

from banyan.functions import scores as S
from banyan.functions import text as X
from banyan.operators import ocr


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def on(spark, f, text):
    return one(spark, f(F.col("t")), t=text)


def kinds(spark, text):
    return [(x.token, x.kind) for x in on(spark, X.tokenize, text)]


def test_tokenize(spark):
    got = kinds(spark, "Just watched #EndGame with @marvel fans 😍🔥 https://t.co/xyz amazing!!")
    assert [x for x in got if x[1] not in ("word", "punct")] == [("#EndGame", "hashtag"), ("@marvel", "mention"), ("😍", "emoji"), ("🔥", "emoji"), ("https://t.co/xyz", "url")]
    assert kinds(spark, "hello, world!") == [("hello", "word"), (",", "punct"), ("world", "word"), ("!", "punct")]
    assert kinds(spark, "hhttp://x y") == [("h", "word"), ("http://x", "url"), ("y", "word")]
    assert kinds(spark, "🇧🇩 👩‍💻 👍🏽 #️⃣") == [("🇧🇩", "emoji"), ("👩‍💻", "emoji"), ("👍🏽", "emoji"), ("#️⃣", "emoji")]
    assert kinds(spark, "#ভালোবাসা") == [("#ভালোবাসা", "hashtag")]
    assert kinds(spark, "") == [] and kinds(spark, None) == []


def test_one_pass_equals_two_passes(spark):
    """Special tokens first, gaps between them after, as a plain scan does."""
    import regex

    def plain(t):
        out, at = [], 0
        for m in regex.finditer(r"https?://\S+|www\.\S+|#\w+|@\w+", t):
            out += regex.findall(r"\w+|[^\w\s]", t[at : m.start()]) + [m.group()]
            at = m.end()
        return out + regex.findall(r"\w+|[^\w\s]", t[at:])

    r = random.Random(9)
    texts = ["".join(r.choice(["h", "http://", "www.", "a", " ", "#", "@", ".", "আ", "া", "1", "_"]) for _ in range(r.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.transform(X.tokenize(F.col("t")), lambda x: x["token"]).alias("x"))
    assert all(row.x == plain(row.t) for row in df.collect())


def test_social_fields(spark):
    assert on(spark, X.hashtags, "#ভালোবাসা #A_1") == ["ভ", "A_1"]
    assert on(spark, X.mentions, "mail a@b.c @x") == ["b", "x"]
    assert on(spark, X.emojis, "👩‍💻x") == ["👩", "💻"]
    assert on(spark, X.hashtags, None) == []


@pytest.mark.parametrize(("text", "want"), [("u r gr8, thx!", "you are great, thanks!"), ("Pls help", "Please help"), ("OMG! Lol", "OH MY GOD! Laughing out loud"), ("ki kori", "ki kori"), ("", "")])
def test_slang(spark, text, want):
    assert on(spark, X.normalize_slang, text) == want


def test_slang_extra_and_phrases(spark):
    assert on(spark, lambda t: X.normalize_slang(t, {"yolo": "live once"}), "yolo u") == "live once you"
    assert on(spark, lambda t: X.normalize_slang(t, phrases=True), "thik asi u") == "thik ache you"


def test_transliteration(spark):
    assert on(spark, X.bn_to_latin, "আমি ভালো আছি") == "ami bhalo achhi"
    assert on(spark, X.bn_to_latin, "ড়") == "do়" and on(spark, lambda t: X.bn_to_latin(t, fix_nukta=True), "ড়") == "ro"
    assert on(spark, X.bn_to_latin, "ক্ষ ১২") == "ksho 12"
    got = on(spark, X.latin_to_bn, "ami bhalo achi")
    assert all("ঀ" <= c <= "৿" for c in got if c != " ")
    assert on(spark, X.latin_to_bn, "Qa chh, আ") == "Qা চহ, আ"


def test_sanitize(spark):
    assert on(spark, X.sanitize, "Notok kom koro priyo <unk>") == "Notok kom koro priyo"
    assert on(spark, X.sanitize, "hello   <pad>   world") == "hello world"
    assert on(spark, X.sanitize, "<<s>s>x") == "<s>x"


@pytest.mark.parametrize(("text", "want"), [("আমি ভালো আছি", 1.0), ("hello world", 0.0), ("12345 !!!", 0.0)])
def test_ratio(spark, text, want):
    assert on(spark, X.bengali_ratio, text) == want


@pytest.mark.parametrize(("text", "want"), [("ami bhalo achi", True), ("আমি feeling bhalo", False), ("hello world", True), ("", False), ("123 !!! ...", False)])
def test_romanised(spark, text, want):
    assert on(spark, X.is_romanised, text) is want


def test_validity(spark):
    for t, want in (("  \n", False), ("NaN", False), (None, False), (" x ", True)):
        assert bool(on(spark, X.is_valid, t)) is want


def test_rebuild_and_reassemble(spark):
    arr = lambda *w: F.array(*[F.lit(x) for x in w]) if w else F.array().cast("array<string>")
    build = lambda o, w, lang: one(spark, X.rebuild_hashtag(F.lit(o), w, F.lit(lang)), t="")
    assert build("#test", arr("good", "morning"), "en") == "#GoodMorning"
    assert build("#x", arr("শুভ", "সকাল"), "bn") == "#শুভসকাল"
    assert build("#original", arr(), "en") == "#original"
    join = lambda s, o, m: one(spark, X.reassemble(X.tokenize(F.lit(s)), F.lit(o), X.mapping(m)), t="")
    assert join("eto shundor #ভালোবাসা dekhlam", "saw so beautiful #ভালোবাসা", {"#ভালোবাসা": "#Love"}) == "saw so beautiful #Love"
    assert join("@ab 😍 @abc", "x @abc", {"-": "-"}) == "x @abc 😍"


def test_ocr_rules(spark):
    clean = lambda t: on(spark, ocr.clean_text, t)
    assert clean("আমি ভালো আছি | সে ভালো") == "আমি ভালো আছি।সে ভালো"
    assert clean("hello | world") == "hello | world"
    assert clean("a\x07b  \t c\n\n\n\nd ") == "ab c\n\nd"
    for t in ("আমি 1 টি", "é  x", "a\n\n\nb"):
        assert clean(clean(t)) == clean(t)


def test_ocr_lines(spark):
    df = spark.createDataFrame([([("sure ", 0.9), ("unsure", 0.3), (" ", 0.1)], ["no", "fixed", "no"])], "lines array<struct<text:string,confidence:double>>, fixed array<string>")
    r = df.select(ocr.clean_lines(F.col("lines"), F.col("fixed")).alias("c"), ocr.mean_confidence(F.col("lines")).alias("m")).select("c", "m", ocr.fixed_count(F.col("c")).alias("n")).first()
    assert [x.text for x in r.c] == ["sure", "fixed", ""] and r.n == 1 and r.m == pytest.approx(1.3 / 3)
    assert [on(spark, X.ocr_confidence, t) for t in ("95", "-1", "x")] == [0.95, 0.0, 0.0]


def test_gate(spark):
    def gate(t, p=None, c=0.0):
        df = spark.createDataFrame([(t, p, c)], "t string, p string, c double")
        g = S.gate(F.col("t"), F.col("p"), F.col("c"))
        return df.select(g["language"].alias("l"), g["reason"].alias("r"), g["confidence"].alias("c")).first()

    assert gate("  ", "en", 0.9)[:2] == ("unsupported", "empty input")
    assert gate("ভালো", "hi", 0.9) == ("bn", "bengali_unicode_ratio", 1.0)
    assert gate("hello", "en", 0.6)[:2] == ("en", "fasttext")
    assert gate("hello", "en", 0.4)[0] == gate("hola", "es", 0.9)[0] == gate("12", None, 0.0)[0] == "unsupported"


def test_postedit(spark):
    def edit(e):
        q = S.postedit(F.lit("mt"), F.lit(e).cast("string"), F.array(F.lit("#blessed"), F.lit("@user")))
        return spark.range(1).select(*[q[k].alias(k) for k in ("post_edit", "edit_applied", "fallback", "missing")]).first()

    assert tuple(edit(None)) == ("mt", False, "unavailable", [])
    assert tuple(edit("lost all")) == ("mt", False, "tokens_lost", ["#blessed", "@user"])
    assert tuple(edit("ok #blessed @user")) == ("ok #blessed @user", True, None, [])
    prompt = spark.range(1).select(X.postedit_prompt(F.lit("s"), F.lit("m"), F.array().cast("array<string>"), F.lit("English"))).first()[0]
    assert "(none)" in prompt and "Machine-translated candidate (English):\nm" in prompt


@pytest.mark.parametrize(
    ("n", "winner", "applied", "post_ok", "pre_ok", "want"),
    [(0, None, False, False, False, (None, True)), (2, None, False, False, False, (None, True)), (2, "w", True, True, False, ("post", False)), (2, "w", True, False, True, ("pre", False)), (2, "w", True, False, False, ("post", True)), (2, "w", False, False, True, ("post", True))],
)
def test_quality_table(spark, n, winner, applied, post_ok, pre_ok, want):
    q = S.quality(F.lit(n), F.lit(winner).cast("string"), F.lit("post"), F.lit("pre"), F.lit(applied), F.lit(post_ok), F.lit(pre_ok))
    assert tuple(spark.range(1).select(q["translation"].alias("t"), q["low_confidence"].alias("c")).first()) == want


def test_very_long_texts(spark):
    """Runs that would end the JVM's stack, or take quadratic time, with patterns that repeat a group or try each place of a run."""
    import time

    texts = ["hw" * 100_000, "1" * 200_000, "👩" + "‍💻" * 30_000, "👍" + "🏽" * 50_000, "x" + " " * 200_000 + "y", "#" * 100_000, "ক | " * 20_000, "A" * 100_000, "https://" * 20_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    c = F.col("t")
    began = time.time()
    every = [F.size(X.tokenize(c)), F.size(X.protected_spans(c)), F.length(X.normalize_slang(c)), F.length(X.latin_to_bn(c)), F.length(X.bn_to_latin(c)), F.size(X.camel_split(c)), F.length(X.sanitize(c)), F.length(X.ocr_rules(c)), F.length(X.strip(c))]
    got = df.select("t", *every).collect()
    assert len(got) == len(texts) and time.time() - began < 120
    assert {len(r.t): r[1] for r in got}[200_000] == 1
    assert on(spark, X.strip, " \n a  b 　") == "a  b" and on(spark, X.strip, "  ") == ""
