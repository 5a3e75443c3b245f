import numpy as np
import pytest

from tablecensus.llm import neighbours
from tablecensus.llm.neighbours import beam_search, best_pairs, build_graph, graph_index, nearest, robust_prune, usable_vectors

VECTORS = "vec_id bigint, embedding array<float>"


def exact(rows, queries, k):
    """query -> nearest ids and scores by comparing with all."""
    ids = np.array([i for i, _ in rows])
    points = np.array([v for _, v in rows], np.float64)
    found = {}
    for i, v in queries:
        v = np.array(v, np.float64)
        scores = points @ v / (np.sqrt((points * points).sum(1)) * np.sqrt(v @ v))
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
        found[i] = [(int(ids[j]), float(scores[j])) for j in order]
    return found


def result(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    return found


def gaussian(n, dim, seed=1):
    draw = np.random.default_rng(seed)
    return [(i, [float(x) for x in v]) for i, v in enumerate(draw.normal(size=(n, dim)).astype(np.float32))]


@pytest.mark.parametrize("shard_vectors", [150, 4096])
def test_recall(spark, shard_vectors):
    rows = gaussian(1200, 24)
    df = spark.createDataFrame(rows, VECTORS)
    got = result(nearest(df, df.where("vec_id % 20 = 0"), 5, shard_vectors, block_queries=25))
    want = exact(rows, rows[::20], 5)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    scores = {q: dict(exact(rows, [(q, rows[q][1])], 1200)[q]) for q in list(want)[:10]}
    assert all(s == pytest.approx(scores[q][i], abs=1e-14) for q in scores for i, s in got[q])


def test_few_vectors_are_exact(spark):
    rows = gaussian(30, 4)
    df = spark.createDataFrame(rows, VECTORS)
    got, want = result(nearest(df, df, 5)), exact(rows, rows, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


@pytest.mark.parametrize("groups", [1, 64])
def test_blocks_meet_shards_without_a_shuffle(spark, monkeypatch, groups):
    monkeypatch.setattr(neighbours, "SHARD_GROUPS", groups)
    rows = gaussian(300, 6)
    df = spark.createDataFrame(rows, VECTORS)
    found = nearest(df, df, 5, shard_vectors=15, block_queries=40)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "SortMergeJoin" not in plan
    got, want = result(found), exact(rows, rows, 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-14)


def test_a_task_ranks_what_all_its_shards_find(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_GROUPS", 1)
    df = spark.createDataFrame(gaussian(300, 6), VECTORS)
    found = nearest(df, df, 5, shard_vectors=15, block_queries=40)
    found.collect()
    plan, rows = found._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        if node.nodeName() == "MapInArrow":
            rows.append(node.metrics().apply("pythonNumRowsReceived").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    assert rows == [300 * 5]  # not as many from each of the 20 shards


def test_single_and_double_precision(spark):
    rows = gaussian(60, 5)
    single = spark.createDataFrame(rows, VECTORS)
    double = single.selectExpr("vec_id", "cast(embedding AS array<double>) AS embedding")
    widths = [graph_index(usable_vectors(df), 6).first()["number_bytes"] for df in (single, double)]
    assert widths == [4, 8]
    want = result(nearest(single, single, 5))
    assert result(nearest(single, double, 5)) == result(nearest(double, single, 5)) == want
    close = [(0, [1.0, 0.0]), (1, [1.0, 1e-5]), (2, [1.0, 2e-5]), (3, [1.0, 3e-5])]  # alike in single precision
    df = spark.createDataFrame(close, "vec_id bigint, embedding array<double>")
    assert [i for i, _ in result(nearest(df, df, 2))[3]] == [2, 1]


def test_copies_tie_to_smaller_ids(spark):
    copied = [1.0, 2.0, 3.0]
    rows = [(i, copied) for i in range(100, 400)] + [(i + 1000, v) for i, v in gaussian(50, 3)]
    df = spark.createDataFrame(rows, VECTORS)
    got = result(nearest(df, df.where("vec_id in (100, 102, 399)"), 5))
    assert [i for i, _ in got[100]] == [101, 102, 103, 104, 105]
    assert [i for i, _ in got[102]] == [100, 101, 103, 104, 105]
    assert [i for i, _ in got[399]] == [100, 101, 102, 103, 104]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [-1.0, 0.0]), (10, [3e38, 0.0]), (11, [1e-38, 0.0])]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' AS dim", "1 AS vec", "2 AS ids", "3 AS shard")
    got = result(nearest(df, df, 5))
    assert set(got) == {0, 1, 9, 10, 11}
    assert [i for i, _ in got[0]] == [10, 11, 1, 9] and got[0][0][1] == pytest.approx(1) and got[0][3][1] == pytest.approx(-1)
    assert [i for i, _ in got[1]] == [0, 10, 11, 9]


def test_empty_tables(spark):
    df = spark.createDataFrame(gaussian(20, 3), VECTORS)
    for vectors, queries in ((df.limit(0), df), (df, df.limit(0)), (df.where("vec_id = 1"), df.where("vec_id = 1"))):
        assert nearest(vectors, queries, 5).count() == 0


def test_pruning_keeps_diverse_edges():
    angles = np.array([0, 0.1, 0.2, -0.5, 3.0])
    unit = np.stack([np.cos(angles), np.sin(angles)], 1).astype(np.float32)
    found = np.array([[1, 2, 3, 4, 0, -1]])
    far = np.sqrt(np.maximum(0, 2 - 2 * unit[found] @ unit[0]))
    far[0, 5] = np.inf
    kept = robust_prune(unit, np.array([0]), found, far, 1.2, 3)[0]
    assert kept.tolist() == [1, 3, 4] or kept.tolist() == [1, 3, -1]
    assert 2 not in kept and 0 not in kept


def test_graph_is_searchable_and_bounded():
    draw = np.random.default_rng(2)
    unit = draw.normal(size=(700, 16))
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
    graph, entry = build_graph(unit, degree=12)
    assert graph.shape == (700, 12) and graph.max() < 700 and (graph != np.arange(700)[:, None]).all()
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in graph)
    nodes, far, _, _ = beam_search(unit, graph.astype(np.int64), entry, unit, 32)
    assert (nodes[:, 0] == np.arange(700)).mean() > 0.98
    assert (np.diff(far, axis=1) >= 0).all()
    for n in (1, 2, 3):
        assert build_graph(unit[:n])[0].shape == (n, neighbours.DEGREE)


def test_beams_hold_no_node_twice():
    draw = np.random.default_rng(3)
    unit = draw.normal(size=(300, 8))
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
    graph, entry = build_graph(unit, degree=12)
    nodes, far, trail, _ = beam_search(unit, graph.astype(np.int64), entry, unit, 40)
    assert all(len(set(r)) == len(r) for r in nodes) and all(len(set(r[r >= 0])) == (r >= 0).sum() for r in trail)
    squares = 2 - 2 * np.take_along_axis(unit.astype(np.float64) @ unit.T, nodes, 1)
    assert far**2 == pytest.approx(np.maximum(0, squares), abs=1e-5)


def test_fewer_nodes_than_places():
    unit = np.eye(3, dtype=np.float32)
    nodes, far, trail, trail_far = beam_search(unit, np.array([[1, -1], [2, -1], [0, -1]]), 0, unit[1:], 8)
    assert nodes[:, :3].tolist() in ([[1, 0, 2], [2, 0, 1]], [[1, 2, 0], [2, 1, 0]]) and (nodes[:, 3:] == -1).all()
    assert np.isinf(far[:, 3:]).all() and sorted(trail[0][trail[0] >= 0]) == [0, 1, 2] and trail.shape == trail_far.shape


def test_best_pairs():
    none = -np.inf
    ids, scores = best_pairs(np.array([[7, 3, 3, 9], [1, 2, 0, 0]]), np.array([[0.5, 0.5, 0.5, 0.4], [0.1, 0.2, none, none]]), 3)
    assert ids[0].tolist() == [3, 7, 9] and scores[0].tolist() == [0.5, 0.5, 0.4]
    assert ids[1, :2].tolist() == [2, 1] and scores[1].tolist() == [0.2, 0.1, none]
