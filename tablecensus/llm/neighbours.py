"""Nearest vectors by cosine: a robust-pruned directed graph for each shard, searched by beam."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tablecensus.llm.frames import parts_for, stored

# Out-neighbours of a node, width of the beam, relaxation of the pruning.
DEGREE, BEAM, ALPHA = 24, 64, 1.2
SHARD_VECTORS, BLOCK_QUERIES = 4_096, 4_096
# Nodes inserted, and queries searched, side by side.
TOGETHER = 256
# Nodes of a beam expanded in one step.
AT_ONCE = 16
# Tasks of a block of queries, at most: so often the nearest of a query are ranked anew.
SHARD_GROUPS = 64
# Squared distances in single precision that differ by less may rank otherwise in double precision.
MARGIN = 1e-4

# A place of a beam: the bits of a squared distance, the node and whether it is expanded, in one number that sorts by
# distance. An empty place is infinitely far.
_EMPTY = np.int64(0x7F800000 << 32 | 1)
_NODE = np.int64(0xFFFFFFFF)


def _distances(unit: np.ndarray, nodes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances on the unit sphere, from each of ``points`` to its row of ``nodes``."""
    near = np.matmul(unit[nodes], points[:, :, None])[:, :, 0]
    return np.sqrt(np.maximum(0, 2 - 2 * near))


def _nodes_and_distances(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes = np.where(places == _EMPTY, -1, (places & _NODE) >> 1)
    return nodes, np.sqrt((places >> 32).astype(np.int32).view(np.float32))


def beam_search(
    unit: np.ndarray, graph: np.ndarray, start: int, points: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy search from ``start`` for all ``points`` side by side.

    Each step expands the nearest nodes of every beam that are not yet expanded.
    Returns the beams, nearest first, with distances, and what was expanded on the
    way, likewise. Places left empty are -1, infinitely far. Distances come from one
    matrix product, which costs less than gathering the vectors of each step.
    """
    count, n = len(points), len(unit)
    squares = np.full((count, n + 1), np.inf, np.float32)  # the last column is for links that there are not
    np.maximum(0, 2 - 2 * (points @ unit.T), out=squares[:, :n])
    links = np.vstack([np.where(graph < 0, n, graph), np.full((1, graph.shape[1]), n)])
    flat, row = squares.ravel(), np.arange(count)[:, None] * (n + 1)
    few = min(AT_ONCE, beam)
    met = np.arange(8, 8 + few * graph.shape[1], dtype=np.float32)  # farther than any node; of nodes met twice at once the last stays
    places = np.full((count, beam), _EMPTY)
    places[:, 0] = squares[:, start].copy().view(np.int32).astype(np.int64) << 32 | start << 1
    squares[:, start] = np.inf
    trail = []
    while True:
        waiting = np.where(places & 1, _EMPTY, places)
        picked = np.partition(waiting, few - 1, 1)[:, :few]
        if (picked == _EMPTY).all():
            break
        trail.append(picked)
        places |= waiting <= picked.max(1)[:, None]
        new = links[np.where(picked == _EMPTY, n, (picked & _NODE) >> 1)].reshape(count, -1)
        far = flat[new + row]
        flat[new + row] = met
        fresh = (far < met[0]) & (flat[new + row] == met)
        squares[:, n] = np.inf
        more = np.where(fresh, far.view(np.int32).astype(np.int64) << 32 | new << 1, _EMPTY)
        places = np.partition(np.hstack([places, more]), beam - 1, 1)[:, :beam]
    return *_nodes_and_distances(np.sort(places, 1)), *_nodes_and_distances(np.hstack(trail))


def robust_prune(
    unit: np.ndarray, nodes: np.ndarray, found: np.ndarray, far: np.ndarray, alpha: float, degree: int
) -> np.ndarray:
    """Up to ``degree`` neighbours for each of ``nodes`` out of its row of ``found``.

    The nearest is kept, and whatever lies ``alpha`` times nearer to it than to
    the node is dropped; and so on with what is left. Edges thus point in
    different directions. Of a node proposed twice the second goes, at distance 0.
    """
    width = min(found.shape[1], 4 * degree)
    order = np.argsort(far, 1, kind="stable")[:, :width]
    found, far = np.take_along_axis(found, order, 1), np.take_along_axis(far, order, 1)
    alive = np.isfinite(far) & (found >= 0) & (found != nodes[:, None])
    vectors = unit[found]
    near = np.matmul(vectors, vectors.transpose(0, 2, 1))
    too_near = 1 - far * far / (2 * alpha * alpha)  # the cosine of what lies alpha times nearer
    rows = np.arange(len(nodes))
    kept = np.full((len(nodes), degree), -1, np.int64)
    for i in range(degree):
        if not alive.any():
            break
        pick = alive.argmax(1)  # candidates are sorted, so the first is the nearest
        some, one = alive[rows, pick], found[rows, pick]
        kept[some, i] = one[some]
        alive &= ~((near[rows, pick] >= too_near) | (found == one[:, None])) | ~some[:, None]
        alive[rows, pick] = False
    return kept


def build_graph(
    unit: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 1
) -> tuple[np.ndarray, int]:
    """The graph (a row of out-neighbours per node, -1 where there are fewer) and its entry.

    From a random graph, two rounds over all nodes, the first without
    relaxation: nodes are searched for, what their searches expanded is pruned to
    their neighbours, and edges back are added, pruned again where too many.
    """
    n = len(unit)
    draw = np.random.default_rng(seed)
    entry = int(np.argmax(unit @ unit.mean(0)))
    graph = np.full((n, degree), -1, np.int64)
    if n > 1:
        random = draw.integers(0, n - 1, (n, min(degree, n - 1)))
        graph[:, : random.shape[1]] = random + (random >= np.arange(n)[:, None])
    for relaxed in (1.0, alpha) if n > 2 else ():
        order = draw.permutation(n)
        for low in range(0, n, TOGETHER):
            nodes = order[low : low + TOGETHER]
            _, _, found, far = beam_search(unit, graph, entry, unit[nodes], beam)
            own = graph[nodes]
            own_far = np.where(own >= 0, _distances(unit, own, unit[nodes]), np.inf)
            kept = robust_prune(unit, nodes, np.hstack([found, own]), np.hstack([far, own_far]), relaxed, degree)
            graph[nodes] = kept
            _add_back(unit, graph, nodes, kept, relaxed)
    return graph.astype(np.int32), entry


def _add_back(unit: np.ndarray, graph: np.ndarray, nodes: np.ndarray, kept: np.ndarray, alpha: float) -> None:
    """Edges from neighbours back to ``nodes``."""
    degree = graph.shape[1]
    come_from, go_to = kept[kept >= 0], np.repeat(nodes, (kept >= 0).sum(1))
    order = np.argsort(come_from, kind="stable")
    come_from, go_to = come_from[order], go_to[order]
    targets, first, counts = np.unique(come_from, return_index=True, return_counts=True)
    width = int(counts.max(initial=0))
    for low in range(0, len(targets), TOGETHER):
        some = slice(low, low + TOGETHER)
        wanted = np.full((len(targets[some]), width), -1, np.int64)
        inside = np.arange(width) < counts[some][:, None]
        wanted[inside] = go_to[(first[some][:, None] + np.arange(width))[inside]]
        wanted[(wanted[:, :, None] == graph[targets[some]][:, None, :]).any(2)] = -1
        every = np.hstack([graph[targets[some]], wanted])
        full = (every >= 0).sum(1) > degree
        simple = every[~full]
        rank = np.argsort(simple < 0, 1, kind="stable")[:, :degree]
        graph[targets[some][~full]] = np.take_along_axis(simple, rank, 1)
        if full.any():
            crowded = targets[some][full]
            far = np.where(every[full] >= 0, _distances(unit, every[full], unit[crowded]), np.inf)
            graph[crowded] = robust_prune(unit, crowded, every[full], far, alpha, degree)


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """Distinct ``vec_id, vec, dim``: vectors of finite numbers that are not all zero.

    Single precision stays so, half the size to shuffle; all else becomes double.
    """
    single = vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull)
    vec = F.col("embedding") if single else F.transform("embedding", lambda x: x.cast("double"))
    return (
        vectors.select("vec_id", vec.alias("vec"))
        .where(
            F.col("vec_id").isNotNull()
            & (F.size("vec") > 0)
            & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("vec", lambda x: x != 0)
        )
        .distinct()
        .withColumn("dim", F.size("vec"))
    )


_INDEX = "dim int, shard bigint, vectors binary, number_bytes int, ids binary, places binary, graph binary, entry int"
_ARRAYS = {"ids": np.int64, "places": np.int64, "graph": np.int32}


def graph_index(vectors: DataFrame, copies: int, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """One row per shard of :func:`usable_vectors`: its vectors, ids and graph.

    Equal vectors are one node, with the ``copies`` smallest ids: no more can be
    among that many nearest, as ties go to smaller ids. Spark cuts the others
    before the shuffle, so a vector with a third of all rows is a few rows per
    task. Nodes are dealt by a hash into shards of about ``shard_vectors``, whose
    number grows with the table; the graph of each is built by one task.
    """
    equal = Window.partitionBy("hash", "dim", "vec").orderBy("vec_id")  # sorts by hash, seldom by whole vectors
    every = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nodes = (
        vectors.withColumn("hash", F.xxhash64("vec"))
        .withColumn("place", F.row_number().over(equal))
        .where(F.col("place") <= copies)
        .withColumn("ids", F.collect_list("vec_id").over(every))
        .where(F.col("place") == 1)
        .select("hash", "dim", "vec", "ids")
    )
    nodes = stored(nodes, "vectors")
    shards = parts_for(nodes.count(), shard_vectors)

    def build(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("first")
        original = np.array(group["vec"].tolist())
        unit = _unit(original.astype(np.float64)).astype(np.float32)
        graph, entry = build_graph(unit)
        ids = [np.asarray(x, np.int64) for x in group["ids"]]
        places = np.cumsum([0, *map(len, ids)])
        row = (
            int(key[0]), int(key[1]), original.tobytes(), original.itemsize, np.concatenate(ids).tobytes(), places.astype(np.int64).tobytes(),
            graph.tobytes(), entry,
        )
        return pd.DataFrame([row], columns=[c.split()[0] for c in _INDEX.split(", ")])

    return (
        nodes.withColumn("shard", F.pmod("hash", F.lit(shards)))
        .withColumn("first", F.col("ids")[0])
        .groupBy("dim", "shard")
        .applyInPandas(build, _INDEX)
    )


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, also where squares of components would overflow or vanish."""
    scaled = vectors / np.abs(vectors).max(-1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(-1, keepdims=True))


def cosines(points: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Cosines in double precision of the original vectors, from each of ``points`` to its row of ``many``."""
    one = points[:, None]
    with np.errstate(over="ignore", invalid="ignore", under="ignore", divide="ignore"):
        plain = (many * one).sum(2) / (np.sqrt((many * many).sum(2)) * np.sqrt((one * one).sum(2)))
    odd = ~np.isfinite(plain).all(1)
    if odd.any():
        plain[odd] = (_unit(many[odd]) * _unit(one[odd])).sum(2)
    return plain


def best_pairs(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of each row, ties to smaller ids; of a pair found twice one. What is -inf is none."""
    order = np.lexsort((ids, -scores), 1)
    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    twice = (ids[:, 1:] == ids[:, :-1]) & (scores[:, 1:] == scores[:, :-1]) & (scores[:, 1:] > -np.inf)
    if twice.any():
        scores[:, 1:][twice] = -np.inf
        order = np.argsort(scores == -np.inf, 1, kind="stable")
        ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    return ids[:, :k], scores[:, :k]


class Shard:
    """One row of :func:`graph_index` to be searched."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, places: np.ndarray, graph: np.ndarray, entry: int):
        self.original, self.graph, self.entry = vectors.astype(np.float64), graph.astype(np.int64), entry
        self.unit = _unit(self.original).astype(np.float32)
        counts = np.diff(places)
        self.inside = np.arange(counts.max()) < counts[:, None]
        self.ids = np.zeros(self.inside.shape, np.int64)
        self.ids[self.inside] = ids

    def nearest(self, points: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores found for each point, without the query's own id; -inf where there are fewer.

        Scores are taken of those nodes alone that may be among the ``k`` best by single precision.
        """
        nodes, far, _, _ = beam_search(self.unit, self.graph, self.entry, _unit(points).astype(np.float32), beam)
        ids = self.ids[nodes]
        fit = (nodes >= 0)[:, :, None] & self.inside[nodes] & (ids != queries[:, None, None])
        enough = fit.sum(2).cumsum(1) >= k
        last = np.where(enough.any(1), enough.argmax(1), beam - 1)
        squares = far * far
        width = int((squares <= squares[np.arange(len(points)), last][:, None] + MARGIN).sum(1).max())
        scores = cosines(points, self.original[nodes[:, :width]])
        scores = np.where(fit[:, :width], scores[:, :, None], -np.inf)
        return ids[:, :width].reshape(len(points), -1), scores.reshape(len(points), -1)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    shard_vectors: int = SHARD_VECTORS,
    block_queries: int = BLOCK_QUERIES,
    beam: int = BEAM,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each query.

    Both tables hold ``vec_id`` and ``embedding``. Every row is indexed (see
    :func:`graph_index`); every query, in blocks, is searched by beam in every shard,
    and the best of all shards are ranked by cosine, ties by smaller id. A query
    is not its own neighbour. Vectors that are null, zero or have null or
    non-finite components, and null ids, take no part; vectors of different
    lengths are never compared. Repeated rows count once. Without queries or
    candidates there are no rows. Other columns are not looked at.

    Shards and blocks meet in a product of their partitions, which is read and never
    written. A task ranks what it finds in all its shards, and a block has a bounded
    number of tasks: what is shuffled grows with the queries, not with queries times shards.
    """
    index = stored(graph_index(usable_vectors(vectors), k + 1, shard_vectors), "graphs")
    asked = usable_vectors(queries).select(F.col("vec_id").alias("query_id"), "vec", "dim")
    blocks = parts_for(asked.count(), block_queries)
    asked = (
        asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        .groupBy("dim", "block")
        .agg(F.collect_list("query_id").alias("query_ids"), F.flatten(F.collect_list("vec")).alias("points"))
    )  # of about block_queries rows
    pairs = index.coalesce(SHARD_GROUPS).hint("shuffle_replicate_nl").join(asked.repartition(blocks), "dim")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(i)[at] for i, name in enumerate(batch.schema.names)}
                dim, kind = row["dim"].as_py(), np.dtype(f"f{row['number_bytes'].as_py()}")
                part = {name: np.frombuffer(row[name].as_buffer(), t) for name, t in _ARRAYS.items()}
                vectors = np.frombuffer(row["vectors"].as_buffer(), kind).reshape(-1, dim)
                graph = part["graph"].reshape(len(vectors), -1)
                shard = Shard(vectors, part["ids"], part["places"], graph, row["entry"].as_py())
                asked_ids = np.asarray(row["query_ids"].values)
                points = np.asarray(row["points"].values).astype(np.float64).reshape(-1, dim)
                key = dim, row["block"].as_py()
                if key not in best:
                    none = np.zeros((len(points), k), np.int64), np.full((len(points), k), -np.inf)
                    best[key] = asked_ids.copy(), *none
                _, ids, scores = best[key]
                for low in range(0, len(points), TOGETHER):
                    some = slice(low, low + TOGETHER)
                    found = shard.nearest(points[some], asked_ids[some], k, beam)
                    ids[some], scores[some] = best_pairs(
                        np.hstack([ids[some], found[0]]), np.hstack([scores[some], found[1]]), k
                    )
        for asked_ids, ids, scores in best.values():
            there = scores > -np.inf
            columns = np.repeat(asked_ids, there.sum(1)), ids[there], scores[there]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    hits = pairs.mapInArrow(search, "query_id bigint, vec_id bigint, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
