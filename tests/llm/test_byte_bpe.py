"""Byte-level BPE against the tiktoken library, and decoding against Python's."""

import base64
import hashlib
import random

import cases
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from banyan.llm import byte_bpe
from banyan.llm.queries import QUERIES


def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@pytest.fixture(scope="module", params=["byte_bpe_50k", "byte_bpe_multi_50k"])
def coder(request):
    encode, decode = byte_bpe.coder(request.param)
    return encode, decode, library(encode.ranks)


def test_merges_of_any_bytes(coder):
    encode, _, lib = coder
    r, tokens = random.Random(1), list(encode.ranks)
    words = [b"".join(r.choice(tokens) for _ in range(r.randint(1, 6))) for _ in range(1500)] + [bytes(r.choice(b"ab \n\t'se.") for _ in range(r.randint(1, 60))) for _ in range(1000)]
    for w in words:
        if w not in encode.ranks:
            assert ids(encode.transducer(w)) == lib._core_bpe.encode_single_piece(w), w


ODD = [
    "", " ", "x ", "  x", "a" * 30_000, "ab" * 20_000, "  " * 9_000 + "x", " \n \n\t x  y", "it's I'll we'VE don''t", "\xa0 foo　bar  \n", "\x1c\x1f y", "日本語テキスト" * 800, "😍é" * 3000, "আমি ভালো", "12½ ²³ ⅷ",
    # letters and numbers of later Unicode versions than tiktoken's
    "a࢏b ౜1 \U00011de0\U00011de1 x", "word. (word) word?! \"word\"", "é. ï, ß;",
]


def test_texts(coder):
    encode, decode, lib = coder
    for x in ODD:
        found = encode(x)
        assert ids(found) == lib.encode_ordinary(x), x[:40]
        assert decode(found) == x


def test_bounded_tables_change_nothing(coder, monkeypatch):
    encode, _, lib = coder
    for name, value in (("STATES", 20), ("PAIRS", 10), ("CACHE", 5), ("BLOCK", 7)):
        monkeypatch.setattr(byte_bpe, name, value)
    own = byte_bpe.Encoder(encode.ranks, public_tokenizers.PATTERN)
    for x in [t for _, t, *_ in cases.rows() if t] + [o[:3000] for o in ODD]:
        assert ids(own(x)) == lib.encode_ordinary(x)
    assert len(own.transducer.states) <= 20 and len(own.words) <= 5


def test_common_words_keep_their_states(monkeypatch):
    """Rare words once pushed them out, so nearly every word made its states anew."""
    ranks = byte_bpe.coder()[0].ranks
    steps, step = [], byte_bpe.Transducer._step
    monkeypatch.setattr(byte_bpe, "STATES", 300)
    monkeypatch.setattr(byte_bpe.Transducer, "_step", lambda *a: steps.append(1) or step(*a))
    t, r, lib = byte_bpe.Transducer(ranks), random.Random(4), library(ranks)
    common = [b" thinning", b" ofonanoush", b" andthlyessh"]
    want = [lib._core_bpe.encode_single_piece(w) if w not in ranks else [ranks[w]] for w in common]
    assert [ids(t(w)) for w in common] == want
    rare = lambda n: [t(bytes(r.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(12))) for _ in range(n)]
    rare(60)
    steps.clear()
    assert [ids(t(w)) for w in common] == want and not steps and len(t.states) == 300
    # where other words become common, they are kept in the end
    other, kept = b" heatiesre", False
    for _ in range(200):
        rare(1)
        t(other)
        steps.clear()
        t(other)
        kept |= not steps
    assert kept and len(t.states) <= 300


def test_lines_and_marks_need_no_pattern(monkeypatch):
    """Words on both sides of a newline were one word before, which hardly came twice."""
    encode = byte_bpe.coder()[0]
    own, lib, asked = byte_bpe.Encoder(encode.ranks, public_tokenizers.PATTERN), library(encode.ranks), []
    whole = own.whole
    monkeypatch.setattr(own, "whole", lambda x: asked.append(x) or whole(x))
    x = "Erst ist.\nUnd ofea### ab, $$$\n Über%%%\nx"
    assert ids(own(x)) == lib.encode_ordinary(x)
    assert list(filter(None, asked)) == [" $$$"]


def test_white_space_beside_newlines(coder):
    encode, _, lib = coder
    r = random.Random(5)
    for _ in range(6000):
        x = "".join(r.choice(["\n", "\n", " ", "\t", "\r", "\xa0", "\x1c", "a", "Bé", "'s", "'", ".", "_", "7", "#*"]) for _ in range(r.randint(1, 9)))
        assert ids(encode(x)) == lib.encode_ordinary(x), x


def test_a_long_word_waits_for_few_tokens(coder, monkeypatch):
    """Lookahead: what isn't emitted is shorter than some longest tokens."""
    encode, _, _ = coder
    monkeypatch.setattr(byte_bpe, "BLOCK", 512)
    t, waiting = encode.transducer, []
    shared = t._shared
    monkeypatch.setattr(t, "_shared", lambda lasts, at: waiting.append(len(lasts) - (n := shared(lasts, at))) or n)
    r = random.Random(2)
    t(bytes(r.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(50_000)))
    t(b"ab" * 20_000)
    assert waiting and max(waiting) <= 2 * max(map(len, encode.ranks))


def test_a_piece_that_merges_never_make_is_still_a_token():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"xbc": 258, b"abc": 300}
    ranks[b"aabcd"] = 400
    encode, lib = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN), library(ranks)
    assert not encode.transducer.merges.made(400)
    for x in ("aabcd", "aabcd aabcd", "xabc", "abc", "xxbcabc", "aabcda"):
        assert ids(encode(x)) == lib.encode_ordinary(x)


def test_streamed_utf8(coder):
    encode, decode, _ = coder
    r = random.Random(3)
    some = [0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xE1, 0xFF, 0xC0]
    for _ in range(6000):
        s, n = bytes(r.choice(some) for _ in range(r.randint(0, 9))), r.randint(1, 4)
        x = np.array([encode.ranks[bytes([c])] for c in s], "<u4")
        assert "".join(decode.stream(x[a : a + n] for a in range(0, len(x), n))) == s.decode(errors="replace")
    text = "é😍 a€" * 50
    x = np.frombuffer(encode(text), "<u4")
    assert all("".join(decode.stream(x[a : a + n] for a in range(0, len(x), n))) == text for n in (1, 2, 3, 100))
    assert decode(np.array([4_000_000_000], "<u4").tobytes()) == "�"


def test_frames(spark):
    docs = cases.frame(spark)
    lib = library(byte_bpe.coder()[0].ranks)
    want = sorted(((i, t or "") for i, t, *_ in cases.rows()), key=str)
    got = byte_bpe.round_trip(docs).collect()
    digests = lambda t: (len(e := lib.encode_ordinary(t)), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), True)
    assert sorted(map(tuple, got), key=str) == sorted(((i, *digests(t)) for i, t in want), key=str)
    back = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    assert sorted(map(tuple, back), key=str) == want
    assert byte_bpe.round_trip(docs.limit(0)).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, cast(x'61ff62' AS string) AS text")
    assert byte_bpe.decode(byte_bpe.encode(broken)).first().text == "a�b"


def test_query_over_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        lib = library({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    got = {r.doc_id: r for r in QUERIES["op12_byte_bpe"](spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        e = lib.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.exact) == (len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), True)
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
