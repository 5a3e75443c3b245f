"""Lineage followed from root tables, level by level, and along whole chains where it goes deep.

The steps of the graph are partitioned by their source once and stay where they
are. Only the frontier moves: it is sent to the steps, and what they lead to is sent
to the tables reached so far, which are partitioned by id as well. What a job
reaches is stored as a piece of its own; pieces are never written again.
"""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecensus.functions.ids import fqn, split_fqn
from tablecensus.operators.lineage import DEFAULT_LOCATION, lineage_graph
from tablecensus.operators.skew import fits_broadcast
from tablecensus.session import Stored, checkpoint, fixed_plans

# Levels per job: a level is a small job, and starting one costs more than its work.
HOPS = 4
# Steps of one table that lie together; a table with more is dealt out over salts.
STEPS_TOGETHER = 100_000
# Rows of the graph per partition; a small graph needs few, but one has no known partitioning.
ROWS_PER_PARTITION, FEWEST_PARTITIONS = 50_000, 2
# So many levels are followed one by one; a search that goes deeper follows chains as a whole.
LEVELS_ONE_BY_ONE = 32


@dataclass(frozen=True)
class Steps:
    """The stored graph: steps by source (and salt, if there are hubs), salts of hubs, upstream counts."""

    steps: DataFrame
    hubs: Stored | None
    counts: DataFrame
    partitions: int


def store_graph(graph: DataFrame, steps_together: int = STEPS_TOGETHER) -> Steps:
    """Write a :func:`lineage_graph` in the form a search needs.

    Tables that feed more than ``steps_together`` others are hubs; their number
    of salts follows from what they feed, and their steps are spread by a hash of the target.
    """
    spark = graph.sparkSession
    whole = checkpoint(graph)
    graph, feeds = whole.df, F.col("neighbour").isNotNull()
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(FEWEST_PARTITIONS, min(most, -(-whole.rows // ROWS_PER_PARTITION)))
    steps = graph.where(feeds).select("fqn", "neighbour")
    keys, hubs = ["fqn"], None
    if whole.rows > steps_together:  # else no table can feed so many
        salts = F.ceil(F.col("fed") / steps_together).cast("int").alias("salts")
        hubs = (
            steps.groupBy("fqn").agg(F.count(F.lit(1)).alias("fed"))
            .where(F.col("fed") > steps_together).select("fqn", salts)
        )
        hubs = checkpoint(hubs, ["fqn"])
    if hubs and hubs.rows:
        keys = ["fqn", "salt"]
        salt = F.pmod(F.xxhash64("neighbour"), F.coalesce("salts", F.lit(1))).cast("int")
        steps = steps.join(_hint(hubs), "fqn", "left").select("fqn", salt.alias("salt"), "neighbour")
    else:
        hubs = None
    with fixed_plans(spark):
        steps = checkpoint(steps.repartition(partitions, *keys)).df
    counts = graph.where(~feeds).select("fqn", F.col("link_count").alias("upstream_count"))
    return Steps(steps, hubs, counts, partitions)


def _hint(stored: Stored) -> DataFrame:
    return F.broadcast(stored.df) if fits_broadcast(stored) else stored.df


def _expanded(found: DataFrame, graph: Steps, depth: int) -> DataFrame:
    """``found`` and, for its tables of this depth, what they feed, one level deeper."""
    here = F.col("depth") == depth
    steps = graph.steps.withColumnRenamed("fqn", "source")
    leads = here & (F.col("fqn") == F.col("source"))
    if graph.hubs:
        salts = F.when(here, F.coalesce("salts", F.lit(1))).otherwise(1)
        found = found.join(_hint(graph.hubs), "fqn", "left").select(
            "fqn", "depth", F.explode(F.sequence(F.lit(0), salts - 1)).alias("here_salt")
        )
        leads &= F.col("here_salt") == F.col("salt")
    # each table stays and adds what it leads to; one look at ``found``, so that
    # the plan of several levels does not double with each
    here = F.struct("fqn", "depth")
    there = F.struct(F.col("neighbour").alias("fqn"), F.lit(depth + 1).alias("depth"))
    linked = F.col("neighbour").isNotNull()
    both = F.inline(F.when(linked, F.array(here, there)).otherwise(F.array(here)))
    led_to = found.join(steps, leads, "left").select(both)
    return led_to.groupBy("fqn").agg(F.min("depth").alias("depth"))


def _one_by_one(
    roots: DataFrame, graph: Steps, max_levels: int | None, levels: int
) -> tuple[list[DataFrame], DataFrame | None]:
    """Pieces of what is reached within about so many levels, and the last level if there may be more."""
    start = roots.select(fqn().alias("fqn")).where(F.col("fqn").isNotNull()).distinct()
    start = start.select("fqn", F.lit(0).alias("depth"))
    frontier = checkpoint(start.repartition(graph.partitions, "fqn"))
    pieces, depth = [frontier.df], 0
    while frontier.rows and depth < levels:
        # the pieces lie as the steps do, and so does their union
        reached = reduce(DataFrame.unionByName, pieces).select("fqn")
        found = frontier.df.where(F.col("depth") == depth)
        for hop in range(HOPS):
            found = _expanded(found, graph, depth + hop)
            found = found.join(reached, "fqn", "left_anti")
        frontier = checkpoint(found, deepest=F.max("depth"))
        depth += HOPS
        if not frontier.rows:
            return pieces, None
        if max_levels is not None and frontier.measured["deepest"] > max_levels:
            raise RuntimeError(f"lineage goes deeper than {max_levels} levels")
        pieces.append(frontier.df)
        if frontier.measured["deepest"] < depth:
            return pieces, None
    return pieces, frontier.df.where(F.col("depth") == depth) if frontier.rows else None


@dataclass(frozen=True)
class Chains:
    """Tables that one table feeds and that feed one: ``fqn, head, place`` in their chain; and per ``head`` its ``length`` and the table ``end`` it leads to."""

    members: DataFrame
    ends: DataFrame


def chains_of(steps: DataFrame) -> Chains:
    """The chains of a graph (``fqn, neighbour``), found by doubling.

    Each member first knows the one before it; a round tells it the one known to that one, so a chain of n
    tables takes about log2 n rounds, each a join of the members with themselves. Rings of members, which have no head,
    are no chains.
    """
    feeds_one = steps.groupBy("fqn").agg(F.count(F.lit(1)).alias("n"), F.first("neighbour").alias("next")).where("n = 1")
    fed_by_one = steps.groupBy(F.col("neighbour").alias("fqn")).agg(
        F.count(F.lit(1)).alias("n"), F.first("fqn").alias("before")
    ).where("n = 1")
    inner = checkpoint(feeds_one.drop("n").join(fed_by_one.drop("n"), "fqn").where(F.col("next") != F.col("fqn"))).df
    ids = inner.select(F.col("fqn").alias("before"), F.lit(True).alias("is_inner"))
    first = inner.join(ids, "before", "left")
    known = first.select(
        "fqn", F.when(F.col("is_inner"), F.col("before")).otherwise(F.col("fqn")).alias("head"),
        F.when(F.col("is_inner"), 1).otherwise(0).cast("bigint").alias("place"),
        F.coalesce("is_inner", F.lit(False)).alias("goes_on"),
    )
    state = checkpoint(known, open=F.count_if("goes_on"))
    rounds = 0
    while state.measured["open"] and (1 << rounds) <= state.rows:
        further = state.df.select(
            F.col("fqn").alias("head"), F.col("head").alias("far_head"), F.col("place").alias("more"), F.col("goes_on").alias("far")
        )
        told = state.df.join(further, "head", "left").select(
            "fqn",
            F.when(F.col("goes_on"), F.col("far_head")).otherwise(F.col("head")).alias("head"),
            F.when(F.col("goes_on"), F.col("place") + F.col("more")).otherwise(F.col("place")).alias("place"),
            (F.col("goes_on") & F.col("far")).alias("goes_on"),
        )
        state = checkpoint(told, open=F.count_if("goes_on"))
        rounds += 1
    members = state.df.where(~F.col("goes_on")).select("fqn", "head", "place")
    last = members.join(inner.select("fqn", "next"), "fqn").groupBy("head").agg(
        (F.max("place") + 1).alias("length"), F.max_by("next", "place").alias("end")
    )
    return Chains(members, checkpoint(last).df)


def _along_chains(frontier: DataFrame, reached: list[DataFrame], graph: Steps) -> DataFrame:
    """What is reached beyond ``frontier``: ``fqn, depth``, with tables of ``reached``, too, at no less than their depth.

    A table inside a chain leads straight to the chain's end, at the distance between them; others
    lead to what they feed. As such steps have lengths, a table may be met again at a
    smaller depth and is then followed again. All tables of a chain behind one
    that was met are reached as well; they are told their depths last, all at once.
    """
    steps = graph.steps.select("fqn", "neighbour")
    chains = chains_of(steps)
    inside = checkpoint(chains.members.join(chains.ends, "head")).df
    along = inside.select("fqn", F.col("end").alias("neighbour"), (F.col("length") - F.col("place")).alias("length"))
    others = steps.join(inside.select("fqn"), "fqn", "left_anti").withColumn("length", F.lit(1).cast("bigint"))
    long_steps = checkpoint(along.unionByName(others).repartition(graph.partitions, "fqn")).df
    depth = F.col("depth").cast("bigint").alias("depth")
    pieces = [reduce(DataFrame.unionByName, reached).select("fqn", depth)]
    met = checkpoint(frontier.select("fqn", depth))
    entered = [met.df]
    while met.rows:
        led_to = (
            met.df.join(long_steps, "fqn")
            .groupBy(F.col("neighbour").alias("fqn"))
            .agg(F.min(F.col("depth") + F.col("length")).alias("depth"))
        )
        for piece in [*pieces, *entered]:
            known = piece.select(F.col("fqn").alias("known"), F.col("depth").alias("known_depth"))
            led_to = led_to.join(
                known, (F.col("fqn") == F.col("known")) & (F.col("known_depth") <= F.col("depth")), "left_anti"
            )
        met = checkpoint(led_to)
        if met.rows:
            entered.append(met.df)
        if len(entered) > 2 * HOPS:
            merged = reduce(DataFrame.unionByName, entered[:-1]).groupBy("fqn").agg(F.min("depth").alias("depth"))
            entered = [checkpoint(merged).df, entered[-1]]
    best = reduce(DataFrame.unionByName, entered).groupBy("fqn").agg(F.min("depth").alias("depth"))
    best = checkpoint(best).df
    behind = Window.partitionBy("head").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    touched = best.join(chains.members, "fqn").select("head").distinct()
    told = (
        chains.members.join(touched, "head", "left_semi")
        .join(best, "fqn", "left")
        .withColumn("base", F.min(F.col("depth") - F.col("place")).over(behind))
        .where(F.col("base").isNotNull())
        .select("fqn", (F.col("base") + F.col("place")).alias("depth"))
    )
    return best.unionByName(told)


def follow(
    roots: DataFrame, graph: Steps, max_levels: int | None = None, one_by_one: int = LEVELS_ONE_BY_ONE
) -> DataFrame:
    """Id texts reachable from ``roots`` (``fqn``), each with its least ``depth``.

    A job follows ``HOPS`` levels from the frontier, the
    deepest tables of the job before; at each level what was reached by earlier
    jobs is taken out, and within the job the least depth of a table wins, so a table is
    expanded once and cycles end. Beyond ``one_by_one`` levels the rest is followed by
    :func:`_along_chains`, in a number of jobs that does not grow with the length of chains.
    Roots without a full id lead nowhere and are dropped.
    """
    with fixed_plans(roots.sparkSession, graph.partitions, compiled=graph.partitions > FEWEST_PARTITIONS):
        pieces, frontier = _one_by_one(roots, graph, max_levels, one_by_one)
        reached = reduce(DataFrame.unionByName, pieces)
        if frontier is None:
            return reached
        deeper = _along_chains(frontier, pieces, graph)
        depth = F.min("depth").cast("int").alias("depth")
        found = reached.unionByName(deeper.select("fqn", F.col("depth").cast("int").alias("depth")))
        whole = checkpoint(found.groupBy("fqn").agg(depth), deepest=F.max("depth"))
        if max_levels is not None and whole.measured["deepest"] > max_levels:
            raise RuntimeError(f"lineage goes deeper than {max_levels} levels")
        return whole.df


def _graph(
    roots: DataFrame,
    links: DataFrame,
    allowed_projects: Sequence[str] | None,
    location: str,
    match_sharded: bool,
    steps_together: int,
) -> Steps:
    """The part of the lineage a search can touch, stored.

    Behind a fence only links of the fenced projects and those of the roots can
    matter: a join with these projects, however many, which prunes links
    stored by project.
    """
    if allowed_projects:
        spark = links.sparkSession
        fenced = spark.createDataFrame([(p,) for p in sorted(set(allowed_projects))], "link_project string")
        touched = fenced.union(roots.select("project_id")).distinct()
        links = links.join(touched, "link_project", "left_semi")
    graph = lineage_graph(links, allowed_projects, location, match_sharded)
    return store_graph(graph, steps_together)


def reachable_tables(
    roots: DataFrame,
    links: DataFrame,
    allowed_projects: Sequence[str] | None = None,
    location: str = DEFAULT_LOCATION,
    match_sharded: bool = False,
    max_levels: int | None = None,
    steps_together: int = STEPS_TOGETHER,
) -> DataFrame:
    """The roots and all tables downstream of them, with ``depth`` in links."""
    graph = _graph(roots, links, allowed_projects, location, match_sharded, steps_together)
    reached = follow(roots, graph, max_levels)
    return reached.select(*split_fqn(F.col("fqn")), "depth")


def leaf_tables_from_roots(
    roots: DataFrame,
    links: DataFrame,
    allowed_projects: Sequence[str] | None = None,
    location: str = DEFAULT_LOCATION,
    match_sharded: bool = False,
    max_levels: int | None = None,
    steps_together: int = STEPS_TOGETHER,
) -> DataFrame:
    """Tables reachable from ``roots`` that feed no table inside the fence.

    Roots themselves are not fenced, repeated roots count once, roots with a null
    part are dropped, and the upstream count ignores the fence.
    """
    graph = _graph(roots, links, allowed_projects, location, match_sharded, steps_together)
    reached = follow(roots, graph, max_levels)
    return (
        reached.join(graph.steps.select("fqn"), "fqn", "left_anti")
        .join(graph.counts, "fqn", "left")
        .select(
            *split_fqn(F.col("fqn")),
            "fqn",
            F.coalesce("upstream_count", F.lit(0).cast("bigint")).alias("upstream_count"),
            "depth",
        )
    )
