"""One hop of lineage: what feeds a table, what it feeds, and which tables feed nothing.

A lookup compares the whole URI of the looked-up table, its *own* end of a link,
within the table's own project and one location. The *far* end is parsed. Both
stay id texts (``p.d.t``) through every shuffle and are split into columns last.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecensus.functions.flags import has_downstream, has_upstream, is_leaf
from tablecensus.functions.ids import (
    URI_PREFIX,
    fqn,
    is_own_path,
    linked_fqn,
    names_table,
    project_of,
    split_fqn,
    uri_path,
    uri_reject_reason,
)
from tablecensus.operators.skew import collapse, expand, numbered
from tablecensus.schemas import ID_COLS
from tablecensus.session import checkpoint

DEFAULT_LOCATION = "us"
FAR_COLS = [f"neighbour_{c}" for c in ID_COLS]


def of_projects(links: DataFrame, project_ids: Sequence[str]) -> DataFrame:
    """The links that looking up tables of these projects can find; a filter in the scan.

    Nothing is lost: a table is looked up among the links of its own project.
    """
    return links.where(F.col("link_project").isin(sorted(set(project_ids))))


def _paths(links: DataFrame, location: str, match_sharded: bool) -> DataFrame:
    """Both ends of the links of one location, as own and as far end.

    Links with an end of another system are filtered out in the scan.
    """
    source, target = F.col("source_fqn"), F.col("target_fqn")
    return links.where(
        (F.col("link_location") == location)
        & source.startswith(URI_PREFIX)
        & target.startswith(URI_PREFIX)
    ).select(
        "link_project",
        uri_path(source, match_sharded).alias("own_source"),
        uri_path(target, match_sharded).alias("own_target"),
        uri_path(source).alias("far_source"),
        uri_path(target).alias("far_target"),
    )


def _usable(own: str, far: str, allowed_projects: Sequence[str] | None = None) -> Column:
    """Whether a link leads from its own to its far end, inside the fence.

    No list and an empty list both mean no fence.
    """
    found = is_own_path(F.col(own), F.col("link_project")) & names_table(F.col(far))
    if allowed_projects:
        found &= project_of(F.col(far)).isin(sorted(set(allowed_projects)))
    return found


def edges(
    links: DataFrame,
    allowed_projects: Sequence[str] | None = None,
    location: str = DEFAULT_LOCATION,
    match_sharded: bool = False,
    direction: str = "downstream",
) -> DataFrame:
    """One row per link usable in ``direction``: ``fqn`` and its ``neighbour``.

    Repeated links stay repeated. Only the neighbour is fenced. Own ends written
    in the sharded form are found only with ``match_sharded``.
    """
    own, far = "own_source", "far_target"
    if direction == "upstream":
        own, far = "own_target", "far_source"
    return (
        _paths(links, location, match_sharded)
        .where(_usable(own, far, allowed_projects))
        .select(F.col(own).alias("fqn"), F.col(far).alias("neighbour"))
    )


def link_ends(
    links: DataFrame,
    allowed_projects: Sequence[str] | None = None,
    location: str = DEFAULT_LOCATION,
    match_sharded: bool = False,
) -> DataFrame:
    """The edges of both directions from one scan. The fence holds downstream only."""

    def end(direction, own, far, fence):
        return F.when(
            _usable(own, far, fence),
            F.struct(
                F.lit(direction).alias("direction"),
                F.col(own).alias("fqn"),
                F.col(far).alias("neighbour"),
            ),
        )

    both = F.array(
        end("downstream", "own_source", "far_target", allowed_projects),
        end("upstream", "own_target", "far_source", None),
    )
    return (
        _paths(links, location, match_sharded)
        .select(F.inline(both))
        .where(F.col("fqn").isNotNull())
    )


def link_degrees(
    links: DataFrame,
    allowed_projects: Sequence[str] | None = None,
    location: str = DEFAULT_LOCATION,
    match_sharded: bool = False,
) -> DataFrame:
    """Links out of and into every table, from one scan and one shuffle.

    Links are counted, not tables. The fence holds for ``downstream_count`` only.
    """
    return (
        link_ends(links, allowed_projects, location, match_sharded)
        .groupBy("fqn")
        .agg(
            F.count_if(F.col("direction") == "downstream").alias("downstream_count"),
            F.count_if(F.col("direction") == "upstream").alias("upstream_count"),
        )
    )


def lineage_graph(
    links: DataFrame,
    allowed_projects: Sequence[str] | None = None,
    location: str = DEFAULT_LOCATION,
    match_sharded: bool = False,
) -> DataFrame:
    """All a search needs, from one scan and one shuffle of the links.

    One row per table and table it feeds inside the fence, and per table one row
    without neighbour whose ``link_count`` is its upstream count.
    """
    fed = F.when(F.col("direction") == "downstream", F.col("neighbour"))
    return (
        link_ends(links, allowed_projects, location, match_sharded)
        .groupBy("fqn", fed.alias("neighbour"))
        .agg(F.count(F.lit(1)).alias("link_count"))
    )


def upstream_counts(
    links: DataFrame,
    location: str = DEFAULT_LOCATION,
    match_sharded: bool = False,
) -> DataFrame:
    """Links into every table that is some link's target."""
    return (
        edges(links, None, location, match_sharded, "upstream")
        .groupBy("fqn")
        .agg(F.count(F.lit(1)).alias("upstream_count"))
        .select(*split_fqn(F.col("fqn")), "upstream_count")
    )


def _degree(name: str) -> Column:
    return F.coalesce(name, F.lit(0).cast("bigint")).alias(name)


def table_lineage(
    ids: DataFrame,
    links: DataFrame,
    location: str = DEFAULT_LOCATION,
    match_sharded: bool = False,
) -> DataFrame:
    """Per distinct id: links up and down, and what follows from their numbers.

    The neighbours themselves come from :func:`neighbours`, one per row.
    """
    degrees = link_degrees(links, None, location, match_sharded)
    return (
        ids.select(*ID_COLS, fqn().alias("fqn"))
        .distinct()
        .join(degrees, "fqn", "left")
        .select(*ID_COLS, _degree("upstream_count"), _degree("downstream_count"))
        .select(
            "*",
            is_leaf().alias("is_leaf"),
            has_upstream().alias("has_upstream"),
            has_downstream().alias("has_downstream"),
        )
    )


def neighbours(
    ids: DataFrame,
    links: DataFrame,
    location: str = DEFAULT_LOCATION,
    match_sharded: bool = False,
) -> DataFrame:
    """The upstream and downstream tables of the given ids, one per row.

    ``link_count`` says how often the link is recorded. Links are counted first, so
    repeated ones are one row per task, and then met by the ids in a plain join,
    which Spark broadcasts if the ids are few and splits where a table has a
    large share of the links.
    """
    counted = (
        link_ends(links, None, location, match_sharded)
        .groupBy("direction", "fqn", "neighbour")
        .agg(F.count(F.lit(1)).alias("link_count"))
    )
    wanted = ids.select(fqn().alias("fqn")).distinct()
    return counted.join(wanted, "fqn", "left_semi").select(
        *split_fqn(F.col("fqn")),
        "direction",
        *[c.alias(f) for c, f in zip(split_fqn(F.col("neighbour")), FAR_COLS)],
        "link_count",
    )


def neighbour_pages(
    found: DataFrame, page_size: int = 10_000, ids: DataFrame | None = None
) -> DataFrame:
    """The rows of :func:`neighbours` as sorted arrays, in pages of ``page_size`` entries.

    Pages of a table and direction are numbered from 0; each is full but the last, and
    their entries follow one another in the order of the ids. Neighbours get their
    places by :func:`numbered`, so no task and no array holds all those of a table
    that has very many. With ``ids`` each of these that has no neighbour in a direction
    has an empty page 0 there.
    """
    group = [*ID_COLS, "direction"]
    entry = F.struct(
        *[F.col(f).alias(c) for c, f in zip(ID_COLS, FAR_COLS)], "link_count"
    )
    placed = numbered(found, group, FAR_COLS, "place")
    pages = (
        placed.withColumn("page", F.floor(F.col("place") / page_size).cast("bigint"))
        .groupBy(*group, "page")
        .agg(F.sort_array(F.collect_list(entry)).alias("neighbours"))
    )
    if ids is None:
        return pages
    pages = checkpoint(pages).df
    directions = F.explode(F.array(F.lit("downstream"), F.lit("upstream")))
    empty = (
        ids.select(*ID_COLS).distinct().withColumn("direction", directions)
        .join(pages.where("page = 0").select(*group), group, "left_anti")
        .withColumn("page", F.lit(0).cast("bigint"))
        .withColumn("neighbours", F.array().cast(pages.schema["neighbours"].dataType))
    )
    return pages.unionByName(empty)


def keep_leaves(
    tables: DataFrame,
    links: DataFrame,
    allowed_projects: Sequence[str] | None = None,
    location: str = DEFAULT_LOCATION,
    match_sharded: bool = False,
) -> DataFrame:
    """Rows of ``tables`` that feed no table inside the fence, with ``upstream_count``.

    Rows come out as often as they went in. They are collapsed on the way, so an
    id that fills a third of the list is one row when it meets its links.
    """
    degrees = link_degrees(links, allowed_projects, location, match_sharded)
    leaves = (
        collapse(tables)
        .withColumn("fqn", fqn())
        .join(degrees, "fqn", "left")
        .select(*tables.columns, _degree("downstream_count"), _degree("upstream_count"), "copies")
        .where(is_leaf())
        .drop("downstream_count")
    )
    return expand(leaves)


def leaf_tables(
    ids: DataFrame,
    links: DataFrame,
    allowed_projects: Sequence[str] | None = None,
    location: str = DEFAULT_LOCATION,
    match_sharded: bool = False,
) -> DataFrame:
    """Those of the given ids that are leaves; an id given twice comes out twice."""
    leaves = keep_leaves(
        ids.select(*ID_COLS), links, allowed_projects, location, match_sharded
    )
    return leaves.select(*ID_COLS, fqn().alias("fqn"), "upstream_count")


def judge_links(links: DataFrame) -> DataFrame:
    """Links with their plain ids ``src`` and ``dst``, or the ``reason`` there are none.

    Store this once to keep both kinds; :func:`split_links` tells them apart.
    """
    ends = ("source", "target")
    reasons = [
        F.concat(F.lit(f"{end}_"), uri_reject_reason(F.col(f"{end}_fqn"))) for end in ends
    ]
    return links.select(
        "*",
        F.coalesce(*reasons).alias("reason"),
        *[linked_fqn(F.col(f"{end}_fqn")).alias(name) for end, name in zip(ends, ("src", "dst"))],
    )


def split_links(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between two readable tables as plain ids, and the others with a reason."""
    good = judged.where(F.col("reason").isNull())
    rejected = judged.where(F.col("reason").isNotNull())
    return (
        good.select("link_project", "link_location", "src", "dst"),
        rejected.drop("src", "dst"),
    )
