"""From discovered to checked to deletion candidate, and the reports built on it.

A lifecycle row is ``table`` (struct), ``usage_info`` and ``deletion_info``
(structs, null until they are known).
"""

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecensus.functions.flags import is_candidate, is_checked, is_unused
from tablecensus.operators.lineage import DEFAULT_LOCATION, keep_leaves
from tablecensus.operators.skew import collapse, expand
from tablecensus.schemas import ID_COLS, TABLE_COLS

USAGE_TYPE = "struct<job_count: bigint, unique_user: bigint>"
DELETION_TYPE = "struct<data_owner: string>"
LIFECYCLE_COLS = ["table", "usage_info", "deletion_info"]


def discovered(tables: DataFrame) -> DataFrame:
    """Listed tables of which nothing else is known yet."""
    return tables.select(
        F.struct(*TABLE_COLS).alias("table"),
        F.lit(None).cast(USAGE_TYPE).alias("usage_info"),
        F.lit(None).cast(DELETION_TYPE).alias("deletion_info"),
    )


def _usage_facts(counts: DataFrame) -> DataFrame:
    """One usage per table: of several the one with most jobs, then most users; null is 0."""
    zero = F.lit(0).cast("bigint")
    usage = F.struct(
        F.coalesce("job_count", zero).alias("job_count"),
        F.coalesce("unique_user", zero).alias("unique_user"),
    )
    return counts.groupBy(*ID_COLS).agg(F.max(usage).alias("new_usage_info"))


def _owner_facts(owners: DataFrame) -> DataFrame:
    return owners.groupBy(*ID_COLS).agg(
        F.struct(F.min("data_owner").alias("data_owner")).alias("new_deletion_info")
    )


def with_info(
    lifecycle: DataFrame,
    counts: DataFrame | None = None,
    owners: DataFrame | None = None,
) -> DataFrame:
    """Set usage for the tables in ``counts`` and deletion info for those in ``owners``.

    What a table already has is replaced, and kept where there is nothing new.
    ``counts`` has a row for every checked table, also for those not used (see
    ``usage.counts_of``). A table with several counts gets the largest as it is, one
    with several owners the first by name.
    """
    facts = {}
    if counts is not None:
        facts["usage_info"] = _usage_facts(counts)
    if owners is not None:
        facts["deletion_info"] = _owner_facts(owners)
    merged = collapse(lifecycle.select(*LIFECYCLE_COLS)).select(
        "*", *[F.col(f"table.{c}").alias(c) for c in ID_COLS]
    )
    for column, new in facts.items():
        merged = merged.join(new, ID_COLS, "left").withColumn(
            column, F.coalesce(f"new_{column}", column)
        )
    return expand(merged.select(*LIFECYCLE_COLS, "copies"))


def with_usage_info(lifecycle: DataFrame, counts: DataFrame) -> DataFrame:
    return with_info(lifecycle, counts=counts)


def with_deletion_info(lifecycle: DataFrame, owners: DataFrame) -> DataFrame:
    return with_info(lifecycle, owners=owners)


def flatten_analyzed(lifecycle: DataFrame) -> DataFrame:
    """The six columns of the export; deletion info is not exported."""
    return lifecycle.select("table.*", "usage_info.job_count", "usage_info.unique_user")


def lifecycle_report(lifecycle: DataFrame, threshold: int = 0) -> DataFrame:
    """One flat row per table with its flags and its stage."""
    return lifecycle.select(
        "table.*",
        "usage_info.job_count",
        "usage_info.unique_user",
        "deletion_info.data_owner",
        is_checked().alias("is_checked"),
        is_candidate().alias("is_candidate"),
        is_unused("usage_info.job_count", threshold).alias("is_unused"),
        F.when(is_candidate(), F.lit("candidate"))
        .when(is_checked(), F.lit("checked"))
        .otherwise(F.lit("discovered"))
        .alias("stage"),
    )


def extend_history(
    report: DataFrame,
    as_of: dt.date,
    history: DataFrame | None = None,
    tracked: Sequence[str] = ("stage", "data_owner"),
) -> DataFrame:
    """The history of every table, brought up to the snapshot ``report`` taken on ``as_of``.

    A row of the history holds ids, the ``tracked`` columns and the days ``valid_from``
    (included) to ``valid_to`` (not included, null while it lasts). Where a tracked value
    changed, null being a value like others, the interval ends and another begins; a table no longer
    listed ends, and begins anew once it is back. The snapshot has to be the latest; given again,
    it changes nothing, and a corrected one of the same day replaces what that day had begun.
    Of several rows of a table the one with the largest values counts. Only intervals that
    still last are shuffled, and meet the snapshot in one aggregation.
    """
    values = F.struct(*tracked)
    day = F.lit(as_of)
    unknown = F.lit(None).cast("date")
    now = report.select(*ID_COLS, unknown.alias("valid_from"), values.alias("now"))
    columns = [*ID_COLS, *tracked, "valid_from", "valid_to"]
    if history is None:
        past = now.select(*ID_COLS, "valid_from", F.col("now").alias("before")).limit(0)
    else:
        past = history.where("valid_to IS NULL").select(*ID_COLS, "valid_from", values.alias("before"))
    met = (
        past.unionByName(now, allowMissingColumns=True)
        .groupBy(*ID_COLS)
        .agg(F.max("valid_from").alias("since"), F.max("before").alias("before"), F.max("now").alias("now"))
    )
    was, listed = F.col("before").isNotNull(), F.col("now").isNotNull()
    same = was & listed & F.col("before").eqNullSafe(F.col("now"))

    def interval(state, since, until):
        return F.struct(*[F.col(f"{state}.{c}").alias(c) for c in tracked], since.alias("valid_from"), until.alias("valid_to"))

    intervals = F.array_compact(
        F.array(
            F.when(same, interval("before", F.col("since"), unknown)),
            F.when(was & ~same & (F.col("since") < day), interval("before", F.col("since"), day)),
            F.when(listed & ~same, interval("now", day, unknown)),
        )
    )
    brought_up = met.select(*ID_COLS, F.inline(intervals)).select(*columns)
    if history is None:
        return brought_up
    return brought_up.unionByName(history.where("valid_to IS NOT NULL").select(*columns))


def unused_tables(analyzed: DataFrame, threshold: int = 0) -> DataFrame:
    return analyzed.where(is_unused("job_count", threshold))


def unused_leaves(
    analyzed: DataFrame,
    links: DataFrame,
    allowed_projects: Sequence[str] | None = None,
    threshold: int = 0,
    location: str = DEFAULT_LOCATION,
) -> DataFrame:
    """Tables nobody uses and that feed nothing: the first to look at."""
    unused = unused_tables(analyzed, threshold)
    return keep_leaves(unused, links, allowed_projects, location)


def _overview(threshold: int) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("tables"),
        F.count_if(is_unused("job_count", threshold)).alias("unused_tables"),
        F.sum("job_count").alias("jobs"),
    ]


def usage_summary(
    analyzed: DataFrame,
    by: Sequence[str] = ("project_id", "dataset_id", "table_type"),
    threshold: int = 0,
) -> DataFrame:
    """Overview numbers: tables, unused tables and their share, jobs."""
    return (
        analyzed.groupBy(*by)
        .agg(*_overview(threshold))
        .withColumn("unused_share", F.col("unused_tables") / F.col("tables"))
    )


def usage_summary_levels(
    analyzed: DataFrame,
    by: Sequence[str] = ("project_id", "dataset_id", "table_type"),
    threshold: int = 0,
) -> DataFrame:
    """The numbers of :func:`usage_summary` for every level of ``by``, from one scan and one shuffle.

    ``level`` says how many of the columns a row is for, from 0 (all tables) on; it tells a total, whose
    further columns are null, from a group whose own value is null. Without tables there are no rows.
    """
    grouped = F.bit_count(F.grouping_id())
    return (
        analyzed.rollup(*by)
        .agg((F.lit(len(by)) - grouped).cast("int").alias("level"), *_overview(threshold))
        .withColumn("unused_share", F.col("unused_tables") / F.col("tables"))
    )
