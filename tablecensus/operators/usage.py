"""How often tables are used and by how many users."""

import datetime as dt
from collections.abc import Sequence
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecensus.operators.skew import collapse, expand, numbered
from tablecensus.schemas import ID_COLS

# How far to look back, and the zone in which a day begins.
DEFAULT_DAYS_BACK = 90
REPORT_ZONE = "Asia/Tokyo"


def today(zone: str = REPORT_ZONE) -> dt.date:
    return dt.datetime.now(ZoneInfo(zone)).date()


def in_window(
    df: DataFrame, as_of: dt.date | None = None, days_back: int = DEFAULT_DAYS_BACK
) -> DataFrame:
    """Rows from ``days_back`` days before ``as_of`` on, that day included.

    There is no upper end. The bound is a literal, so days stored as partitions
    are pruned and others are filtered in the scan.
    """
    first_day = (as_of or today()) - dt.timedelta(days=days_back)
    return df.where(F.col("dt") >= F.lit(first_day))


def reference_counts(
    usage: DataFrame,
    as_of: dt.date | None = None,
    days_back: int = DEFAULT_DAYS_BACK,
) -> DataFrame:
    """Jobs and user-days per table from the daily usage.

    ``unique_user`` adds the daily numbers up: someone active on five days
    counts five times. See :func:`unique_users_exact` for people.
    """
    return (
        in_window(usage, as_of, days_back)
        .groupBy(*ID_COLS)
        .agg(
            F.sum("job_count").alias("job_count"),
            F.sum("unique_user").alias("unique_user"),
        )
    )


def attach_usage(tables: DataFrame, counts: DataFrame) -> DataFrame:
    """Every listed table with its counts, zero where there are none.

    Rows of ``tables`` come out as often as they went in; they meet the counts
    collapsed, so a table listed very often does not load one task.
    """
    columns = [c for c in tables.columns if c not in ("job_count", "unique_user")]
    zero = F.lit(0).cast("bigint")
    counted = (
        collapse(tables.select(*columns))
        .join(counts.select(*ID_COLS, "job_count", "unique_user"), ID_COLS, "left")
        .select(
            *columns,
            F.coalesce("job_count", zero).alias("job_count"),
            F.coalesce("unique_user", zero).alias("unique_user"),
            "copies",
        )
    )
    return expand(counted)


def counts_of(tables: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per listed id with its counts, zero where there are none."""
    zero = F.lit(0).cast("bigint")
    return (
        tables.select(*ID_COLS)
        .distinct()
        .join(counts.select(*ID_COLS, "job_count", "unique_user"), ID_COLS, "left")
        .select(
            *ID_COLS,
            F.coalesce("job_count", zero).alias("job_count"),
            F.coalesce("unique_user", zero).alias("unique_user"),
        )
    )


def local_time(df: DataFrame, moment: str = "ts", zone: str = REPORT_ZONE) -> Column:
    """The wall clock in ``zone``; a time without zone is UTC in any session."""
    zoneless = isinstance(df.schema[moment].dataType, T.TimestampNTZType)
    read_in = F.lit("UTC") if zoneless else None
    return F.convert_timezone(read_in, F.lit(zone), F.col(moment))


def with_report_day(
    df: DataFrame, moment: str = "ts", zone: str = REPORT_ZONE
) -> DataFrame:
    """Add ``dt``, the calendar day of ``moment`` in ``zone``."""
    return df.withColumn("dt", F.to_date(local_time(df, moment, zone)))


def daily_usage(
    job_log: DataFrame,
    keys: Sequence[str] = ID_COLS,
    user: str = "user_id",
) -> DataFrame:
    """Jobs and distinct users per table and day from a log with one row per job.

    Spark first groups by key, day and user, so a table with most of the log is
    spread over its users before the users are counted.
    """
    return job_log.groupBy(*keys, "dt").agg(
        F.count(F.lit(1)).alias("job_count"),
        F.count_distinct(user).alias("unique_user"),
    )


def unique_users_exact(
    job_log: DataFrame,
    as_of: dt.date | None = None,
    days_back: int = DEFAULT_DAYS_BACK,
    user: str = "user_id",
) -> DataFrame:
    """People per table over the whole window, each counted once."""
    return (
        in_window(job_log, as_of, days_back)
        .groupBy(*ID_COLS)
        .agg(F.count_distinct(user).alias("unique_user_exact"))
    )


def daily_user_sketches(job_log: DataFrame, user: str = "user_id") -> DataFrame:
    """One mergeable user sketch per table and day, to be stored beside the usage."""
    return job_log.groupBy(*ID_COLS, "dt").agg(
        F.hll_sketch_agg(user).alias("user_sketch")
    )


def unique_users_approx(
    sketches: DataFrame,
    as_of: dt.date | None = None,
    days_back: int = DEFAULT_DAYS_BACK,
) -> DataFrame:
    """People per table from daily sketches: any window without going back to the log."""
    return (
        in_window(sketches, as_of, days_back)
        .groupBy(*ID_COLS)
        .agg(
            F.hll_sketch_estimate(F.hll_union_agg("user_sketch")).alias(
                "unique_user_approx"
            )
        )
    )


def usage_totals(usage: DataFrame) -> DataFrame:
    """Running totals per table over the days with usage, that day included: ``total_jobs, total_users, until``.

    Each row holds until the day before the table's next one (``until``, null for
    the last), so on any day one row per table has all that came before. Stored once
    beside the daily usage, any look-back needs two rows of it per table. Rows without a day are left out.
    """
    days = usage.where(F.col("dt").isNotNull())
    # in order of the days rows of one day tie and get one total, so they need not be added up before
    here = Window.partitionBy(*ID_COLS).orderBy("dt")
    so_far = here.rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c).over(so_far), F.lit(0))

    return (
        days.select(
            *ID_COLS,
            "dt",
            total("job_count").alias("total_jobs"),
            total("unique_user").alias("total_users"),
            F.lead("dt").over(here).alias("next"),
        )
        .where(F.col("next").isNull() | (F.col("next") > F.col("dt")))  # of a day the last row
        .withColumn("until", F.date_sub("next", 1))
        .drop("next")
    )


def reference_counts_from_totals(
    totals: DataFrame,
    as_of: dt.date | None = None,
    days_back: int = DEFAULT_DAYS_BACK,
    last_day: dt.date | None = None,
) -> DataFrame:
    """The counts of :func:`reference_counts` from :func:`usage_totals`, up to ``last_day`` if one is given.

    What was counted until the last day less what was counted before the first: two rows
    per table however long the look-back, told apart by the days they hold for.
    """
    before = (as_of or today()) - dt.timedelta(days=days_back + 1)

    def holds(day: dt.date | None) -> Column:
        if day is None:
            return F.col("until").isNull()
        return (F.col("dt") <= F.lit(day)) & (F.col("until").isNull() | (F.col("until") >= F.lit(day)))

    ends, begins = holds(last_day), holds(before)
    part = lambda c: F.sum(F.when(ends, F.col(c)).otherwise(0) - F.when(begins, F.col(c)).otherwise(0))
    last = F.max(F.when(ends, F.col("dt")))
    return (
        totals.where(ends | begins)
        .groupBy(*ID_COLS)
        .agg(part("total_jobs").alias("job_count"), part("total_users").alias("unique_user"), last.alias("last"))
        .where(F.col("last") > F.lit(before))  # a table without a day in the window has no row
        .drop("last")
    )


def user_dictionary(job_log: DataFrame, user: str = "user_id") -> DataFrame:
    """Every user (column ``user_id``) with a number from 0 on without a gap, to be stored and joined by all days."""
    users = job_log.select(F.col(user).alias("user_id")).where(F.col("user_id").isNotNull()).distinct()
    return numbered(users.withColumn("all", F.lit(0)), ["all"], ["user_id"], "user_number").drop("all")


def daily_user_bitmaps(job_log: DataFrame, dictionary: DataFrame, user: str = "user_id") -> DataFrame:
    """Which users were active per table and day, exactly: bits of their numbers, in blocks of 64.

    A block is one number and only blocks with a user are rows, so there are never more rows than
    users of a table and day, and a table with many users has few per user. Blocks are merged by
    :func:`unique_users_from_bitmaps`. The log is reduced to one row per table, day and user
    before it meets the dictionary.
    """
    active = (
        job_log.select(*ID_COLS, "dt", F.col(user).alias("user_id"))
        .where(F.col("user_id").isNotNull())
        .distinct()
        .join(dictionary, "user_id")
    )
    bit = F.expr("shiftleft(1L, CAST(user_number % 64 AS INT))")
    return active.groupBy(*ID_COLS, "dt", F.expr("user_number div 64").alias("block")).agg(
        F.bit_or(bit).alias("user_bits")
    )


def unique_users_from_bitmaps(
    bitmaps: DataFrame,
    as_of: dt.date | None = None,
    days_back: int = DEFAULT_DAYS_BACK,
    last_day: dt.date | None = None,
) -> DataFrame:
    """People per table over any window of :func:`daily_user_bitmaps`, each counted once, exactly.

    Blocks of one table are joined map-side, so what is shuffled are blocks, not people or days.
    """
    window = in_window(bitmaps, as_of, days_back)
    if last_day is not None:
        window = window.where(F.col("dt") <= F.lit(last_day))
    merged = window.groupBy(*ID_COLS, "block").agg(F.bit_count(F.bit_or("user_bits")).alias("users"))
    return merged.groupBy(*ID_COLS).agg(F.sum("users").alias("unique_user_exact"))
