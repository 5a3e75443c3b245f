import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tablecensus.llm import bpe, queries

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(FILE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed=1):
    draw = random.Random(seed)
    alphabet = "ab'strevelmd  \n\t'’.,!12 é中 　\x1c\x85😀ٱ١"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(40))) for _ in range(n)]
    plane = lambda: draw.choice([draw.randrange(0x80), draw.randrange(0xD800), draw.randrange(0xE000, 0x110000)])
    return texts + ["".join(chr(plane()) for _ in range(30)) for _ in range(n)]


EDGES = ["", " ", "  ", "\n", " \n ", "a  ", "'s", "'s's 're're'll", "''s", " 's", "a!'s", "don't we'LL", "x\n\n y", "<|endoftext|>",
         "a" * 5000, " " * 3000 + "x", "!" * 2000, "é" * 700, "ab" * 300, "\x00"]


def ids_of(row):
    return np.frombuffer(row.ids, "<u4").tolist()


def test_same_ids_as_the_library(docs, reference):
    texts = EDGES + random_texts(1500)
    out = bpe.decode(bpe.encode(docs(*texts), FILE), FILE).collect()
    assert len(out) == len(texts)
    for r in out:
        assert ids_of(r) == reference.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded) == texts[r.doc_id].encode()


@pytest.mark.parametrize("block", [1, 2, 3, 128])
def test_blocks_do_not_matter(monkeypatch, block):
    texts = EDGES[:14] + random_texts(100, 2)
    plain = list(bpe.split_texts(texts))
    monkeypatch.setattr(bpe, "BLOCK", block)
    assert list(bpe.split_texts(texts)) == plain
    assert [b"".join(p) for p in plain] == [t.encode() for t in texts]


def test_long_pieces_merge_as_short_ones():
    draw = random.Random(4)
    ranks = bpe.Ranks(FILE)
    for _ in range(200):
        piece = "".join(draw.choice("abcé ") for _ in range(draw.randrange(2, 60))).encode()
        assert [np.array(ranks.merge(piece), "<u4").tobytes()] == list(ranks.merge_short([piece]))


def test_offsets(docs):
    text = "Don't stop, é中😀 now"
    row = bpe.encode(docs(text), FILE).first()
    data = text.encode()
    for low in range(len(data) + 1):
        for high in range(low, len(data) + 1):
            assert bpe.decode_part(row.ids, row.starts, low, high, FILE) == data[low:high]


def test_odd_rows(docs, odd, prose):
    rows = [*enumerate(odd), (None, "x"), (9, "same"), (9, "same"), (10, prose(1, 50_000))]
    out = bpe.decode(bpe.encode(docs(*rows, clash=True), FILE, offsets=False), FILE).collect()
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in out), key=repr) == sorted(((i, (t or "").encode()) for i, t in rows), key=repr)
    assert all(r.starts is None for r in out)
    assert bpe.encode(docs("x").limit(0), FILE).count() == 0


def test_decode_checks_offsets(docs):
    encoded = bpe.encode(docs("Don't stop, é中😀 now", ""), FILE)
    assert sorted(bytes(r.decoded).decode() for r in bpe.decode(encoded, FILE).collect()) == ["", "Don't stop, é中😀 now"]
    with pytest.raises(Exception, match="offsets do not fit"):
        bpe.decode(encoded.selectExpr("doc_id", "ids", "substring(starts, 5) AS starts"), FILE).collect()


def test_query_keeps_offsets(spark, monkeypatch):
    seen = []
    decode = bpe.decode
    monkeypatch.setattr(bpe, "decode", lambda encoded, ranks: seen.append(encoded) or decode(encoded, ranks))
    out = queries.op5_byte_bpe(spark, "/root/testdata/sf0.001")
    tokens = {r.doc_id: r.n_tokens for r in out.collect()}
    assert {r.doc_id: len(r.starts) // 4 for r in seen[0].collect()} == tokens
