import random
import zlib

import pytest
from pyspark.sql import functions as F

from tablecensus.llm.toxicity import Dictionaries, Distance, held_out, learn, score_toxicity, windows

INSULTS = ["blarg", "snudge", "vorpish", "grottle", "krem"]


def corpus(prose, n, seed=0):
    draw = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = prose(1000 * seed + i, draw.randrange(20, 120), 3000).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(draw.randrange(1, 4)):
                words.insert(draw.randrange(len(words)), draw.choice(INSULTS) + draw.choice(["", ".", "s"]))
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    return texts, labels


@pytest.fixture
def labelled(spark):
    return lambda rows: spark.createDataFrame([(i, 1, y) for i, y in rows], "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(docs, labelled, prose):
    texts, labels = corpus(prose, 600)
    df = docs(*texts)
    model = learn(df, labelled(labels))
    out = score_toxicity(df, model).select("doc_id", held_out().alias("held"), "score", "predicted").collect()
    truth = dict(labels)
    for r in out:
        assert r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in out if r.held]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.predicted == 0 for r in held if not truth[r.doc_id])


def test_labels_of_held_out_rows_are_never_learned(docs, labelled, prose):
    texts, labels = corpus(prose, 300, 1)
    df = docs(*texts)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    assert learn(df, labelled(labels)) == learn(df, labelled(flipped))


def test_sample_is_bounded(docs, labelled, prose):
    texts, labels = corpus(prose, 200, 2)
    texts[4] = texts[4] + " giant" * 20_000
    few = learn(docs(*texts), labelled(labels), per_class=20)
    assert b"giant" not in few.ordinary and few.toxic
    assert len(few.ordinary) < 300 << 10 and len(few.toxic) < 70 << 10


def test_one_kind_of_label_only(docs, labelled):
    df = docs("a b", "c d")
    for labels in ([], [(0, 0), (1, 0)], [(77, 1), (0, 0)]):
        model = learn(df, labelled(labels))
        assert model is None
        assert {(r.score, r.predicted) for r in score_toxicity(df, model).collect()} == {(0.0, 0)}


def test_odd_rows(docs, labelled, odd, prose):
    texts, labels = corpus(prose, 120, 3)
    model = learn(docs(*texts), labelled([*labels, (None, 1), (5, None)]))
    rows = [*enumerate(odd), (None, "krem blarg"), (30, "krem blarg"), (30, "krem blarg"), (31, prose(5, 40_000, 10**6) + " krem")]
    out = score_toxicity(docs(*rows, clash=True), model)
    found = out.select("doc_id", "score", "predicted").collect()
    assert len(found) == len(rows) and dict(out.dtypes)["score"] == "double" and dict(out.dtypes)["predicted"] == "int"
    assert all(r.predicted == 0 for r in found if r.doc_id is not None and r.doc_id < 4)  # without words
    assert all(r.predicted == 1 for r in found if r.doc_id is None or r.doc_id >= 30)
    assert score_toxicity(docs("x").limit(0), model).count() == 0


def test_windows_cover_whole_texts():
    assert windows("A b\nC d e", 2) == {b"a b", b"c d", b"e"}
    assert windows("", 1) == windows(" \n", 3) == set()
    distance = Distance(Dictionaries(b"", b"", 0.0, 1.0, 2))
    assert distance.of_text("") == -1.0 and distance.of_text("some words here") == 0.0


def test_held_out_of_null(spark):
    df = spark.createDataFrame([(None,), (7,)], "doc_id bigint")
    assert [r[0] for r in df.select(held_out()).collect()] == [zlib.crc32(b"") % 5 == 0, zlib.crc32(b"7") % 5 == 0]
    assert F is not None
