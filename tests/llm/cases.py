"""Documents that every operator must stand: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ", ".join(f"{c} string" for c in ("bucket", "h", "k", "t", "seg", "fp", "z", "spans", "n_words", "score", "fingerprint", "leaf", "words"))


def rows(seed: int = 0, n: int = 40) -> list[tuple]:
    r = random.Random(seed)
    words = ["the", "and", "Straße", "naïve", "data", "LAKE", "river", "আমি", "ing", "x" * 30, "of", "tion", "a,", "b."]
    text = lambda k: " ".join(r.choice(words) + str(r.randint(0, 9)) * r.randint(0, 1) for _ in range(k))
    passage, out = text(70), []
    for i in range(n):
        body = text(r.randint(0, 120))
        if i % 5 == 0:
            body = f"{body[: len(body) // 2]} {passage} {body[len(body) // 2 :]}"
        out.append((i, body))
    out += [(n, None), (n + 1, ""), (n + 2, " \t\n "), (n + 3, "one"), (n + 4, "one two"), (None, out[7][1]), (n + 5, "ab" * 1500), (n + 6, "😍é" * 300)]
    out += [(n + 7, out[5][1]), (n + 8, out[5][1] + " more"), (3, out[3][1]), (4, "another text of a doc_id that is there"), (n + 9, text(6000))]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in out]


def frame(spark, data=None, clash: bool = True):
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({x.split()[0]: F.lit("clash") for x in CLASHES.split(", ")})
    return df
