import random

import pytest

from tablecensus.llm.frames import ship_package

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture
def docs(spark):
    """Documents from texts, or from (doc_id, text) pairs; with columns whose names operators use, too."""

    def make(*rows, clash=False):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for name in ("id", "text_hash", "row", "shard", "score", "kept", "bytes", "cls", "bucket", "group", "n_words", "p"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture
def prose():
    """Random prose: words of a small vocabulary, so that runs of them repeat by chance."""

    def make(seed, words, vocabulary=400):
        draw = random.Random(seed)
        return " ".join(f"w{draw.randrange(vocabulary)}é" if draw.random() < 0.1 else f"w{draw.randrange(vocabulary)}" for _ in range(words))

    return make


ODD_TEXTS = [None, "", " ", "\n\n", "one", "\x00", "é😀 　 x", "a" * 5000]


@pytest.fixture
def odd():
    return list(ODD_TEXTS)
