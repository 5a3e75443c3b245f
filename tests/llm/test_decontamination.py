import hashlib
import random
import re

import duckdb
import pytest

from tablecensus.llm import decontamination
from tablecensus.llm.queries import ORACLES, QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def expected(rows, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    sizes = {len(x) for x in windows}
    out = []
    for doc_id, text in rows:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc_id, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, list(r["items"]), r.contaminated) for r in df.collect()), key=repr)


ITEMS = "item_id bigint, text string, doc_id string, digest string, shingle string, size string, number string"


@pytest.fixture
def items(spark):
    return lambda *rows: spark.createDataFrame([(*r, *["x"] * 5) for r in rows], ITEMS)


@pytest.mark.parametrize("vocabulary, window, shingle", [(2, 10, 3), (4, 10, 3), (30, 10, 3), (3, 4, 3), (3, 3, 3), (2, 2, 3), (3, 12, 5)])
def test_agrees_with_brute_force(docs, items, prose, vocabulary, window, shingle):
    draw = random.Random(vocabulary)
    benchmark = [(i, prose(i, draw.choice([1, 2, 3, 5, 9, 10, 11, 25]), vocabulary)) for i in range(12)]
    benchmark += [(3, prose(99, 14, vocabulary)), (50, benchmark[0][1]), (None, prose(98, 12, vocabulary)), (51, None), (52, "-- !")]
    rows = []
    for i in range(40):
        part = draw.choice(benchmark)[1] or ""
        rows.append((i, draw.choice([prose(200 + i, 60, vocabulary), f"{prose(i, 8, 500)}, {part.upper()}; {prose(i, 20, 500)} {part}"])))
    df = docs(*rows, clash=True)
    got = found(decontamination.contamination(df, items(*benchmark), window, shingle))
    assert got == expected(rows, benchmark, window)
    assert any(r[5] for r in got)


def test_joins_without_broadcast(monkeypatch, spark, docs, items, prose):
    monkeypatch.setattr("tablecensus.llm.frames.BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        benchmark = [(i, prose(i, 15, 40)) for i in range(10)]
        rows = [(i, f"{prose(300 + i, 30, 40)} {benchmark[i % 10][1]} x") for i in range(30)]
        got = found(decontamination.contamination(docs(*rows), items(*benchmark)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == expected(rows, benchmark) and all(r[5] for r in got)


def test_odd_rows(docs, items, odd, prose):
    passage = prose(1, 14, 3000)
    long = " ".join([prose(2, 30_000, 9), passage, "ÉÀ 😀", prose(3, 10_000, 9)])
    rows = [*enumerate(odd), (None, None), (None, passage), (None, passage), (7, passage), (7, passage), (8, long), (9, "é w1 w2"), (10, "É w1 w2")]
    benchmark = [(1, passage), (2, "ÉÀ 😀"), (3, "É\nw1 W2"), (4, ""), (5, prose(2, 12, 9))]
    assert found(decontamination.contamination(docs(*rows, clash=True), items(*benchmark))) == expected(rows, benchmark)


def test_empty_tables(docs, items, prose):
    df, some = docs(prose(1, 20)), items((1, prose(1, 20)))
    assert found(decontamination.contamination(df, some.limit(0))) == [(0, 20, 0, 0, [], False)]
    assert found(decontamination.contamination(df.limit(0), some)) == []
    assert found(decontamination.contamination(df, items((1, None)))) == [(0, 20, 0, 0, [], False)]


def test_query_and_its_sql(spark, docs, items, prose, odd, tmp_path):
    benchmark = [(i, prose(i, 8 + i, 50)) for i in range(12)]
    rows = [(i, f"{prose(500 + i, 40, 50)} {benchmark[i % 12][1]} End.") for i in range(30)]
    rows += [*enumerate(odd), (None, benchmark[3][1])]
    docs(*rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    items(*benchmark).select("item_id", "text").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = QUERIES["op12_decontamination"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    want = [(*r[:4], hashlib.sha256(",".join(r[4]).encode()).hexdigest(), r[5]) for r in expected(rows, benchmark)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(con.execute(ORACLES["op12_decontamination"]).fetchall(), key=repr) == sorted(want, key=repr)
