import random
import re
import zlib
from collections import Counter

import pytest

from tablecensus.llm import spelling
from tablecensus.llm.queries import QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def expected(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            form[w] = best
    rows = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        rows[w] = (form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None)
    return rows


def found(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def edited(draw, word, letters):
    kind, at = draw.randrange(3), draw.randrange(len(word) + 1)
    if kind == 0:
        return word[:at] + draw.choice(letters) + word[at:]
    at = min(at, len(word) - 1)
    return word[:at] + (draw.choice(letters) if kind == 1 else "") + word[at + 1 :]


@pytest.mark.parametrize("letters, lengths", [("ab", range(2, 9)), ("abcé", range(6, 14)), ("xÿ", range(1, 4))])
def test_forms_agree_with_brute_force(spark, letters, lengths):
    draw = random.Random(len(letters))
    words = {"".join(draw.choice(letters) for _ in range(draw.choice(lengths))) for _ in range(150)}
    for w in list(words):
        for _ in range(3):
            words.add(w := edited(draw, w, letters) or "x")
    counts = {w: draw.choice([1, 5, 25, 125, 625, draw.randrange(1, 1000)]) for w in sorted(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert found(spelling.spelling_forms(df)) == expected(counts)


def test_a_long_chain_of_forms(spark):
    counts = {"a" * i + "b" * 20: 5 ** (20 - i) for i in range(20)}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    rows = found(spelling.spelling_forms(df))
    assert rows == expected(counts)
    assert rows["a" * 19 + "b" * 20][1] == "b" * 20


def test_many_words_with_one_half(spark):
    counts = {f"samehalf{i:08d}": 1 + i % 7 for i in range(600)}
    counts |= {f"{i:08d}samehalf": 1 + i % 50 for i in range(600)}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert found(spelling.spelling_forms(df)) == expected(counts)


def test_words_are_counted_as_told(docs, odd, prose, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED_WORDS", 50)
    draw = random.Random(3)
    some = ["Receive", "reCeive", "receive", "Éclair×s", "éclairs", "naïveté", "ÀÿÀÿÀÿ", "abc", "ŁódźMiasto", "a1bcdefgh"]
    texts = [" ".join(draw.choice(some) for _ in range(300)) for _ in range(40)]
    rows = list(enumerate([*odd, *texts, "x" * 100_000 + " receive"])) + [(None, "receive receive"), (7, "receive"), (7, "receive")]
    df = docs(*rows, clash=True)
    got = {r.word: r.n for r in spelling.word_counts(df).collect()}
    assert got == counted(rows)
    plain = {r.word: r.n for r in spelling.word_counts(df, damaged=None).collect()}
    assert len(plain) < len(got)


def test_query_over_a_table(spark, docs, tmp_path):
    draw = random.Random(5)
    stems = ["".join(draw.choice("abcdef") for _ in range(draw.randrange(5, 10))) for _ in range(60)]
    texts = [" ".join(draw.choice(stems[: 5 + i % 55]) for _ in range(200)) for i in range(80)]
    texts += [" ".join(edited(draw, w, "abcdef") for w in stems)] * 6 + [None, ""]
    rows = list(enumerate(texts))
    docs(*rows).write.parquet(f"{tmp_path}/documents.parquet")
    words = {w: n for w, n in counted(rows).items() if n >= 5}
    want = expected(words)
    assert any(form for form, *_ in want.values())
    out = QUERIES["op11_spelling"](spark, str(tmp_path))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert found(out) == want


def test_empty(spark, docs):
    assert spelling.spelling_forms(spelling.word_counts(docs("receive receive").limit(0))).count() == 0
    nulls = spark.createDataFrame([(None, 3), ("abcdef", 2), ("abcdef", 3)], "word string, n bigint")
    assert found(spelling.spelling_forms(nulls)) == {"abcdef": (None, "abcdef", 5, 0, None)}
