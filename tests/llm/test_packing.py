import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import frame, rows
from tokenizers import Tokenizer

from banyan.llm import packing


def covers(docs, parts):
    """Whether the parts, each once, make up the documents' ids, of which some may be alike."""
    if len(docs) == 1:
        parts = sorted(parts)
        ends = [0, *(a + n for a, n, *_ in parts)]
        return [a for a, *_ in parts] == ends[:-1] and ends[-1] == len(docs[0]) and all(zlib.crc32(docs[0][a : a + n]) == c and m == len(docs[0]) for a, n, c, m in parts)
    left = Counter(parts)

    def fill(k, at):
        if k == len(docs):
            return not any(left.values())
        if at == len(docs[k]):
            return fill(k + 1, 0)
        for p in [p for p, n in left.items() if n and p[0] == at and p[3] == len(docs[k]) and zlib.crc32(docs[k][at : at + p[1]]) == p[2]]:
            left[p] -= 1
            if fill(k, at + p[1]):
                return True
            left[p] += 1
        return False

    return fill(0, 0)


def held(got, data, capacity):
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for i, text, *_ in data:
        want[i].append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4"))
    bins, docs = defaultdict(list), defaultdict(list)
    for r in got:
        assert 0 < r.length <= capacity
        bins[r.sequence_id].append((r.offset, r.length, r.bin_class))
        docs[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    sizes = []
    for parts in bins.values():
        at = 0
        for o, n, _ in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity and at & (at - 1) == 0
        sizes.append(at)
        (k,) = {c for *_, c in parts}
        # a bin holds as many rests as its class says, and parts that fill its gap
        assert k == 0 or at == capacity and sum(capacity // n == k for _, n, _ in parts) >= k
    assert set(docs) == set(want)
    for i, parts in docs.items():
        assert covers(want[i], parts)
    return sizes


def test_pack(spark):
    for capacity in (1024, 64, 1):
        sizes = held(packing.harmonic_pack(frame(spark), capacity).collect(), rows(), capacity)
        assert capacity == 1 or sum(s < capacity for s in sizes) <= 3 * 10
    assert packing.harmonic_pack(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        packing.harmonic_pack(frame(spark), 1000)


def test_pack_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.harmonic_pack(docs).collect()
    held(got, [(x.doc_id, x.text) for x in docs.collect()], 1024)
    # cuts are few: whole sequences, and about one more for each rest
    whole = sum(r.doc_tokens // 1024 for r in got if r.start == 0)
    assert len(got) - whole < 2.2 * docs.count()


def test_classes():
    """Lengths in (capacity / (k + 1), capacity / k] meet k by k; the next rest fills the gap."""
    p = packing.Packer(64, 0)
    doc = lambda i, n: packing.Piece(i, 0, bytes(4 * n), n)
    rows = lambda got: [(r[0], r[1], r[2], r[5], r[6], r[7]) for r in got]
    assert p.add(doc(1, 20)) == p.add(doc(2, 17)) == p.add(doc(3, 21)) == []
    # 17 to 21 are of class 3; the gap of 6 takes the head of the next one, whose rest of 24 is of class 2
    assert rows(p.add(doc(4, 30))) == [(1, 0, 20, 0, 0, 3), (2, 0, 17, 0, 20, 3), (3, 0, 21, 0, 37, 3), (4, 0, 6, 0, 58, 3)]
    assert rows(p.add(doc(5, 64 * 2 + 32))) == [(5, 0, 64, 1, 0, 1), (5, 64, 64, 2, 0, 1)]
    assert rows(p.add(doc(6, 5))) == []
    # 24 + 32 left a gap of 8, of which 5 are filled: 61 ids, split at powers of two
    assert rows(p.finish()) == [(4, 6, 24, 3, 0, 0), (5, 128, 8, 3, 24, 0), (5, 136, 16, 4, 0, 0), (5, 152, 8, 5, 0, 0), (6, 0, 4, 6, 0, 0), (6, 4, 1, 7, 0, 0)]


def test_very_long_texts_without_spaces_or_words():
    import random

    e, r = packing.encoder(), random.Random(6)
    for t in ["a" * 300_000, "".join(r.choice("abcdé") for _ in range(200_000)), " " * 300_000, "x" + "\n" * 300_000 + "y", " \n\t" * 100_000, "\xa0" * 100_000, "\x85 " * 50_000 + "z", "!" * 200_000, "漢" * 100_000, "ab " * 100_000]:
        assert np.frombuffer(e(t), "<u4").tolist() == e.whole.encode(t, add_special_tokens=False).ids
    assert max(map(len, e.words), default=0) <= packing.KEEP


def test_ids_equal_the_librarys():
    import random

    e, r = packing.encoder(), random.Random(5)
    for t in ["a <|endoftext|> b", " \n x  é 中文 আমি", "ሀ 𝕏 ǅ", ""] + ["".join(r.choice("ab  \n\t.,'s1é中আ_\xa0\r😍") for _ in range(r.randint(0, 14))) for _ in range(4000)]:
        assert np.frombuffer(e(t), "<u4").tolist() == e.whole.encode(t, add_special_tokens=False).ids
