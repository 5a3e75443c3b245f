import hashlib
import random
import re

import pytest

from tablecensus.llm import suffixes
from tablecensus.llm.suffixes import difference_cover, repeated_spans, without_repeats


def covered(texts, length):
    """Per text, which bytes lie in a string of this length that begins twice."""
    seen = {}
    for i, t in enumerate(texts):
        for at in range(len(t) - length + 1):
            seen.setdefault(t[at : at + length], []).append((i, at))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, at in places:
                gone[i][at : at + length] = b"\x01" * length
    return gone


def expected(texts, length):
    found = {}
    for i, (t, gone) in enumerate(zip(texts, covered(texts, length))):
        spans, at = [], 0
        while (start := gone.find(1, at)) >= 0:
            at = gone.find(0, start) if gone.find(0, start) >= 0 else len(gone)
            spans.append((start, at))
        if spans:
            found[i] = spans, bytes(b for b, g in zip(t, gone) if not g)
    return found


def result(df):
    return {r.id: ([(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in df.collect()}


@pytest.mark.parametrize("order", [2, 3, 5, 13, 17])
def test_cover(order):
    period, offsets = difference_cover(order)
    assert len(offsets) == order + 1
    assert {(i - j) % period for i in offsets for j in offsets} == set(range(period))


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, docs, monkeypatch, seed):
    """Passages shared at random places and lengths around the limit, repeats within a text, runs of one byte."""
    monkeypatch.setattr(suffixes, "BUCKET_NAMES", 50)
    monkeypatch.setattr(suffixes, "BUCKET_SUFFIXES", 500)
    draw = random.Random(seed)
    noise = lambda n: "".join(draw.choice("abcdefgh é") for _ in range(n))
    shared = [noise(draw.randrange(50, 140)) for _ in range(4)]
    texts = []
    for _ in range(30):
        parts = [noise(draw.randrange(0, 120)) for _ in range(3)]
        parts.insert(draw.randrange(3), draw.choice(shared)[draw.randrange(12) :])
        texts.append("".join(parts))
    texts += [texts[0], texts[0], texts[1][5:], "z" * 90, "ab" * 60, "", noise(59), noise(60), shared[0] * 2]
    found = repeated_spans(docs(*texts), length=60, order=3)
    assert result(found) == expected([t.encode() for t in texts], 60)


def test_production_length(docs, prose):
    one, two = prose(1, 400), prose(2, 300)
    texts = [one, "x " + one[200:900], two, two[:399], two[: len(two) - 1], prose(3, 500), one[:700] + one[300:1200]]
    assert result(repeated_spans(docs(*texts))) == expected([t.encode() for t in texts], 400)


def whole_words(data, start, end):
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t-\r]+", data)]
    return sum(start <= a and b <= end for a, b in found)


@pytest.mark.parametrize("least_words", [1, 12, 13, 30])
def test_runs_of_few_words_stay(docs, prose, least_words):
    passages = [prose(50 + i, n, 4000) for i, n in enumerate([11, 12, 13, 29, 30, 31, 60])]
    texts = [f"{prose(100 + i, 20, 4000)} {p} {prose(200 + i, 9, 4000)}x {passages[i % 3]}" for i, p in enumerate(passages * 2)]
    texts += ["y" * 300, "y" * 200 + " " + "y" * 200, passages[-1] + "tail", "head" + passages[-1]]
    data = [t.encode() for t in texts]
    want = {}
    for i, (spans, _) in expected(data, 40).items():
        spans = [(a, b) for a, b in spans if whole_words(data[i], a, b) >= least_words]
        if spans:
            kept, at = b"", 0
            for a, b in [*spans, (len(data[i]), None)]:
                kept, at = kept + data[i][at:a], b
            want[i] = spans, kept
    assert want and result(repeated_spans(docs(*texts), 40, 3, least_words)) == want


def test_a_common_string_is_spread(docs, prose, monkeypatch):
    """All rows have the same passage, beside repeated rows; nothing but its first place per batch meets."""
    monkeypatch.setattr(suffixes, "BUCKET_NAMES", 100)
    passage = prose(7, 90, 4000)
    texts = [f"{prose(i, 5, 4000)} {passage} {prose(1000 + i, 5, 4000)}" for i in range(120)]
    rows = [*enumerate(texts), *[(500, passage)] * 40]
    found = repeated_spans(docs(*rows).repartition(6))
    want = expected([t.encode() for _, t in rows], 400)
    assert result(found) == {rows[n][0]: spans for n, spans in want.items()}


def test_a_text_longer_than_a_batch(docs, prose, monkeypatch):
    monkeypatch.setattr("tablecensus.llm.words.BATCH_BYTES", 4_000)
    long = prose(1, 3_000, 4000)
    texts = [prose(2, 50, 4000), long + long[1_000:1_700], prose(3, 80, 4000), "x" + long[5_000:9_000], ""]
    assert result(repeated_spans(docs(*texts))) == expected([t.encode() for t in texts], 400)


def test_odd_rows(docs, odd, prose):
    text = prose(1, 200)
    rows = [*enumerate(odd), (None, text), (20, text), (20, text), (None, None)]
    df = docs(*rows, clash=True)
    out = without_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=repr)
    want = [(i, t, len(t or "")) for i, t in enumerate(odd) if t != "a" * 5000]
    want += [(7, "", 0), (None, "", 0), (20, "", 0), (20, "", 0), (None, None, 0)]
    assert got == sorted(want, key=repr)


def test_broken_character_goes(docs):
    base = "".join(chr(0x4E00 + i) for i in range(200))  # three bytes each
    texts = ["é" + base, "ũ" + base]  # last bytes 0xa9 of both are equal
    out = {r.doc_id: r.text for r in without_repeats(docs(*texts)).collect()}
    assert out == {0: "", 1: ""}
    spans = result(repeated_spans(docs(*texts)))
    assert spans[0][1] == b"\xc3" and spans[1][1] == b"\xc5"


def test_empty_table(docs):
    df = docs("x").limit(0)
    assert repeated_spans(df).count() == 0
    assert without_repeats(df).columns == df.columns and without_repeats(df).count() == 0


def test_query_digest(spark, docs, prose, tmp_path):
    from tablecensus.llm.queries import QUERIES

    texts = [prose(1, 300), prose(1, 300) + " tail", "short", None]
    docs(*texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op1_suffix_dedup"](spark, str(tmp_path)).collect()}
    data = [(t or "").encode() for t in texts]
    want = expected(data, 400)
    for i, t in enumerate(data):
        spans, kept = want.get(i, ([], t))
        assert tuple(rows[i]) == (i, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
