import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from cases import frame, rows

from banyan.llm import pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(m, part):
    """Ids by merging symbols one by one, the best score first and from the left."""
    every = m.pieces | {pieces.MARK * n: i for n, i in m.runs.items()}
    score = {p: m.scores[i] for p, i in every.items()}
    symbols = list(part)
    while True:
        pairs = [(-score[x + y], k) for k, (x, y) in enumerate(zip(symbols, symbols[1:], strict=False)) if x + y in score]
        if not pairs:
            return [i for p in symbols for i in ([every[p]] if p in every else [m.bytes[b] for b in p.encode()])]
        _, k = min(pairs)
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]


def ids(m, text):
    return np.frombuffer(m.encode(text), "<u4").tolist()


def test_against_brute_force_merging():
    m = pieces.model()
    texts = {p for _, t, *_ in rows() for p in ("▁" + (t or "").replace(" ", "▁"))[:3000].split("▁")[:40]}
    for part in [*sorted(x for x in texts if x), "▁😍é\n\n", "internationalization", "▁" + "a" * 40]:
        assert m.viterbi(part) == brute(m, part)
    for text in ["▁" * 20, "▁▁▁▁▁hello", "▁▁▁the▁▁▁▁▁▁▁river"]:
        assert [i for p in m.parts(text) for i in np.frombuffer(m.part(p), "<u4").tolist()] == brute(m, text)
    # the pass relaxes a position with every piece that ends there: the one that fits is the only one
    for part in ("▁tokenization", "▁unbelievable"):
        last = [m.viterbi(part[:e])[-1] for e in range(1, len(part) + 1)]
        for e in range(1, len(part) + 1):
            fits = [i for p, i in m.pieces.items() if part[:e].endswith(p) and (len(p) == e or m.side_by_side(last[e - len(p) - 1], i)) and brute(m, p) == [i]]
            assert fits == [last[e - 1]]


def test_ids_are_the_librarys(library, sf):
    m, r = pieces.model(), random.Random(3)
    texts = [x or "" for x in pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()]
    texts += ["".join(r.choice("ab  \n\t.,'s1é中আ_\xa0\r😍АЯтеh inert ") for _ in range(r.randint(0, 40))) for _ in range(5000)]
    names = [x for x in m.names[259:] if x.strip()]
    texts += ["".join(r.choice(names) for _ in range(r.randint(1, 6))) for _ in range(5000)]
    texts += [c * n for c in ("a", "=", "ab", " ", " x", "1") for n in range(60)]
    # an adversary's: no space in a very long text
    texts += ["ab" * 200_000, "".join(r.choice("abcdeé") for _ in range(200_000))]
    for t in texts:
        assert ids(m, t) == library.encode(t)
    for kept in (m.kept, m.words):
        assert len(kept) <= pieces.CACHE and max(map(len, kept)) <= pieces.KEEP


def test_round_trip(spark):
    data = rows() + [(200, " ▁ a▁▁ b ", "en", "s", 1), (201, "\x00\x7f <s></s><unk><0x41>", "en", "s", 1)]
    m = pieces.model()
    got = pieces.round_trip(frame(spark, data)).collect()
    assert all(x.exact for x in got)
    assert Counter((x.doc_id, x.n_pieces, x.ids_crc32) for x in got) == Counter((i, len(m.encode(t or "")) // 4, zlib.crc32(m.encode(t or ""))) for i, t, *_ in data)
    back = pieces.decode(pieces.encode(frame(spark, data)))
    assert Counter(map(tuple, back.collect())) == Counter((i, t or "") for i, t, *_ in data)
    assert pieces.round_trip(frame(spark, [])).collect() == []
