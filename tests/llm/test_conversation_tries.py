import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tablecensus.llm import list_ranking
from tablecensus.llm.conversation_tries import conversation_trie
from tablecensus.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def expected(rows):
    """``rows`` must not tie in conversation and turn, unless they are equal."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(found)] for c, found in own.items()}
    rebuilt = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - c % 5 if c >= 0 else c + -c % 5
        rebuilt[c] = turns.get(first, [])[:h] + mine[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
        ends[tuple(rebuilt[c])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        own_saving = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own_saving + sum(saved[x] for x in children[node])
    return sorted(
        (
            (m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(children[node]), leaves[node], saved[node],
             hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest())
            for node, m in members.items()
        ),
        key=repr,
    )


def found(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


def some(seed, convs, longest, texts):
    draw = random.Random(seed)
    return [
        (c, t, draw.choice(["user", "assistant", None]), draw.choice(texts))
        for c in convs for t in range(draw.randrange(longest + 1)) if draw.random() < 0.9
    ]


@pytest.mark.parametrize("short", [2, list_ranking.SHORT_LIST])
@pytest.mark.parametrize("convs, longest, texts", [(range(60), 3, "ab"), (range(-20, 150, 3), 14, ["x", "é😀", None, ""])])
def test_agrees_with_brute_force(spark, monkeypatch, short, convs, longest, texts):
    monkeypatch.setattr(list_ranking, "RANGE_ROWS", 20)
    rows = some(len(texts), convs, longest, texts)
    assert found(conversation_trie(spark.createDataFrame(rows, SCHEMA), short)) == expected(rows)


def test_a_long_a_common_and_turnless_conversations(spark):
    rows = [(1_000, t, "user", f"turn {t}") for t in range(600)]  # a third of all
    rows += [(c, t, "user", f"same {t}") for c in range(2_000, 2_300) for t in range(2)]
    rows += [(c, 0, "user", "only") for c in range(3_001, 3_200, 5)]
    want = expected(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in want)
    assert found(conversation_trie(spark.createDataFrame(rows, SCHEMA), 50)) == want


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (1, None, None, None), (1, 0, "user", "a" * 50_000), (1, 5, "user", "é"), (1, 5, "user", "é"),
        (0, None, "user", "x"), (0, 1, "", ""), (2, 3, "us", "erx"), (3, 3, "user", "x"), (-7, 1, "user", "x"), (-5, 1, "user", "y"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", name string, node int")
    assert found(conversation_trie(df)) == expected(rows)
    assert found(conversation_trie(df.limit(0))) == []
    one = conversation_trie(df.where("conv_id = 3"))
    assert found(one) == expected([r for r in rows if r[0] == 3])


def test_ids_are_joined_in_pieces(spark, monkeypatch):
    monkeypatch.setattr("tablecensus.llm.conversation_tries.PIECE", 7)
    rows = [(5 * c, 0, "user", "all the same") for c in range(200)]
    assert found(conversation_trie(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


@pytest.mark.parametrize("near", ["id", "mixed"])
def test_sums_along_a_list(spark, near):
    draw = random.Random(2)
    order = draw.sample(range(10_000), 700)
    weights = [draw.randrange(100) for _ in order]
    rows = [(i, j, w, draw.random()) for i, j, w in zip(order, [*order[1:], None], weights)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "id bigint, next bigint, w bigint, mixed double")
    got = list_ranking.list_sums(df, [near], ["w"], short=40, rows=100)
    want = {i: sum(weights[:n]) for n, i in enumerate(order)}
    assert {r.id: r.before_w for r in got.collect()} == want


def test_query_over_a_table(spark, tmp_path):
    rows = some(9, range(100), 9, ["hello", "world", "x y"])
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(QUERIES["op13_conversation_trie"](spark, str(tmp_path))) == expected(rows)
