import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablecensus.llm import packing
from tablecensus.llm.packing import best_fill, fill_windows, packed_sequences

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(FILE)
    found.encode_special_tokens = True
    return found


def expected(tokenizer, rows, capacity):
    pieces = []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        for start in range(0, len(ids), capacity):
            part = ids[start : start + capacity]
            pieces.append((i, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    return sorted(pieces, key=repr)


def check(out, tokenizer, rows, capacity):
    assert sorted((tuple(r)[:5] for r in out), key=repr) == expected(tokenizer, rows, capacity)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pieces_and_sequences(docs, odd, prose, tokenizer):
    draw = random.Random(1)
    rows = [(i, prose(i, draw.randrange(1, 150))) for i in range(80)]
    rows += [(100 + i, t) for i, t in enumerate(odd)] + [(None, "no id"), (5, "twice"), (5, "twice"), (200, prose(3, 9_000))]
    rows += [(300, "don't WE'LL İstanbul. ΣΑΣ, é Å. <|endoftext|> a.b, 12.5 　x\x85y")]
    out = packed_sequences(docs(*rows, clash=True), FILE, capacity=128, group_pieces=60).collect()
    used = check(out, tokenizer, rows, 128)
    assert used * 128 < 1.05 * sum(r.length for r in out) + 10 * 128


def test_production_capacity_wastes_little(docs, prose, tokenizer):
    rows = [(i, prose(i, 40 * (i % 40) + 10)) for i in range(150)]
    out = packed_sequences(docs(*rows), FILE).collect()
    used = check(out, tokenizer, rows, 4096)
    assert used <= -(-sum(r.length for r in out) // 4096) + 1


def test_word_by_word_is_as_whole(tokenizer):
    draw = random.Random(3)
    alphabet = "ab'strevelmd  \n\t'’.,!12 é中　😀ٱ١İΣσςÅͅé가ㄱ"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(40))) for _ in range(3000)]
    known = packing.WordIds(FILE)
    words = [t.replace("\n", " ").split(" ") for t in texts]
    known.learn(set().union(*words))
    for text, parts in zip(texts, words):
        ids = np.frombuffer(b"".join(map(known.__getitem__, parts)), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(20))
def test_best_fill_is_best(seed):
    draw = random.Random(seed)
    counts = {draw.randrange(1, 40): draw.randrange(1, 4) for _ in range(6)}
    space = draw.randrange(1, 90)
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    used = best_fill(counts, space)
    assert all(0 < k <= counts[n] for n, k in used.items())
    assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= space)


def test_fill_windows_uses_all_once():
    draw = random.Random(2)
    counts = {draw.randrange(1, 100): draw.randrange(1, 30) for _ in range(50)}
    fillings = fill_windows(counts, 300)
    left = dict(counts)
    for filling, times in fillings:
        assert sum(n * k for n, k in filling.items()) <= 300
        for n, k in filling.items():
            left[n] -= k * times
    assert not any(left.values())
    total = sum(n * c for n, c in counts.items())
    assert sum(times for _, times in fillings) <= -(-total // 300) + 1


def test_memory_of_words_is_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 10)
    known = packing.WordIds(FILE)
    for i in range(5):
        words = {f"word{i}x{j}" for j in range(8)}
        known.learn(words)
        assert all(np.frombuffer(known[w], "<u4").tolist() == tokenizer.encode(w).ids for w in words)
    assert len(known) < 30


def test_empty_table(docs):
    assert packed_sequences(docs("x").limit(0), FILE).count() == 0


def test_plain_words_as_the_tokenizer_parts_them():
    known = packing.WordIds(FILE)
    assert known.letters
    draw = random.Random(4)
    letters = [chr(c) for c in range(256) if packing.PLAIN(chr(c))]
    words = {"".join(draw.choice(letters[:26] if i % 3 else letters) for _ in range(draw.randrange(1, 30))) for i in range(3_000)}
    words |= {"The,", "the", "THE.", "é.", "Éa", "a.", ".", "..", ",", "a,.", "1.", "x" * 200, "don't", "naïve,", "İ.", "ﬁx"}
    known.learn(words)
    tokenizer = packing._tokenizer(FILE)
    for word in words:
        assert np.frombuffer(known[word], "<u4").tolist() == tokenizer.encode(word, add_special_tokens=False).ids, word


def test_texts_are_looked_up_whole(docs, odd, prose, tokenizer, monkeypatch):
    draw = random.Random(5)
    texts = [*odd, *[prose(i, draw.randrange(200)) for i in range(40)], "a . , The. the, THE ..", "ÜBER. Über, über é́."]
    known = packing.WordIds(FILE)
    for turn in range(2):  # the second time nothing is new
        ids, totals = known.of_texts(pa.array(texts, pa.string()), 2)
        ends = np.cumsum(totals)
        got = [ids[end - n : end].tolist() for end, n in zip(ends.tolist(), totals.tolist())]
        assert got == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    rows = list(enumerate(texts))
    monkeypatch.setattr(packing, "BYTES_AT_ONCE", 100)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows], schema)
    pieces = []

    class Whole:  # stands for a DataFrame of one task
        def select(self, *columns):
            return self

        def mapInArrow(self, cut, schema):
            pieces.extend(tuple(r.values()) for out in cut(iter([batch, batch.slice(0, 0)])) for r in out.to_pylist())

    packing.token_pieces(Whole(), FILE, 128)
    assert sorted(pieces, key=repr) == expected(tokenizer, rows, 128)


def test_latin_capitals_and_marks_share_the_small_word(monkeypatch):
    known = packing.WordIds(FILE)
    known.learn({"über", "façade", "a", ".", ","})
    asked = []

    class Counting:
        def encode_batch_fast(self, words, **options):
            asked.extend(words)
            return packing._tokenizer(FILE).encode_batch_fast(words, **options)

    known.tokenizer = Counting()
    known.learn({"Über", "ÜBER.", "über,", "Façade", "A."})
    assert not asked and known["ÜBER."] == known["über"] + known["."]
