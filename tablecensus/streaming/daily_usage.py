"""The daily usage rollup over a stream of jobs."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tablecensus.operators.usage import REPORT_ZONE, local_time, with_report_day
from tablecensus.schemas import ID_COLS
from tablecensus.sources.outputs import write_daily_usage


def daily_usage_stream(
    jobs: DataFrame,
    moment: str = "ts",
    zone: str = REPORT_ZONE,
    late: str = "1 day",
    keys: Sequence[str] = ID_COLS,
    user: str = "user_id",
) -> DataFrame:
    """Jobs and distinct users per table and day, each day once it is over.

    Streams have no exact distinct count, so jobs are first counted per user and
    the users then counted in a second aggregation over the same day. The state
    of a busy table is thereby spread over its users. Jobs arriving more than
    ``late`` after newer ones miss their day; the batch rollup of the stored log
    replaces such days.
    """
    # windows of a day begin at midnight UTC, so the wall clock is taken for UTC
    wall_clock = F.convert_timezone(
        F.lit("UTC"), F.current_timezone(), local_time(jobs, moment, zone)
    ).cast("timestamp")
    per_user = (
        jobs.withColumn("wall_clock", wall_clock)
        .withWatermark("wall_clock", late)
        .groupBy(F.window("wall_clock", "1 day"), *keys, user)
        .agg(F.count(F.lit(1)).alias("jobs"))
    )
    return (
        per_user.groupBy(F.window(F.window_time("window"), "1 day").alias("day"), *keys)
        .agg(F.sum("jobs").alias("job_count"), F.count(user).alias("unique_user"))
        .select(
            *keys,
            F.to_date(F.convert_timezone(None, F.lit("UTC"), "day.start")).alias("dt"),
            "job_count",
            "unique_user",
        )
    )


def write_daily_usage_stream(
    daily: DataFrame, path: str, checkpoint_path: str
) -> DataStreamWriter:
    """A writer that adds finished days to the folder of daily usage; start it.

    Each batch goes through the batch writer, which replaces whole days: a day
    comes out of the stream at once, so a batch run again writes the same, and a batch
    rollup may repair or add days in the same folder at any time. Both paths must be on
    storage shared by all executors.
    """

    def write(batch: DataFrame, _: int) -> None:
        write_daily_usage(batch, path)

    return daily.writeStream.outputMode("append").foreachBatch(write).option(
        "checkpointLocation", checkpoint_path
    )


def write_exact_daily_usage_stream(
    jobs: DataFrame,
    path: str,
    users_path: str,
    checkpoint_path: str,
    moment: str = "ts",
    zone: str = REPORT_ZONE,
    keys: Sequence[str] = ID_COLS,
    user: str = "user_id",
) -> DataStreamWriter:
    """A writer that keeps daily usage equal to the batch rollup, however late jobs come; start it.

    The state is stored, not held by executors: each batch adds its jobs per table, day and user to
    ``users_path``, in one folder per day and batch, and the days it touched, late ones too, are counted
    again from all that is stored of them and replaced at ``path``. A batch that is run again
    replaces its own folders, so it counts once. A batch costs as much as the days it
    touches hold; other days are not read. The days alone come to the driver, to prune
    folders. Jobs without a time belong to no day and are left out; jobs without a user count, but as
    nobody's. All paths must be on storage shared by all executors, and only this
    writer may write to them.
    """

    def write(batch: DataFrame, number: int) -> None:
        per_user = with_report_day(batch, moment, zone).where("dt IS NOT NULL").groupBy(*keys, "dt", user)
        added = per_user.agg(F.count(F.lit(1)).alias("jobs")).withColumn("batch", F.lit(number).cast("bigint"))
        (
            added.hint("rebalance", F.col("dt"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("dt", "batch")
            .parquet(users_path)
        )
        stored = batch.sparkSession.read.schema(added.schema).parquet(users_path)
        days = [r.dt for r in stored.where(F.col("batch") == number).select("dt").distinct().collect()]
        if not days:
            return
        touched = stored.where(F.col("dt").isin(days)).groupBy(*keys, "dt", user).agg(F.sum("jobs").alias("jobs"))
        daily = touched.groupBy(*keys, "dt").agg(F.sum("jobs").alias("job_count"), F.count(user).alias("unique_user"))
        write_daily_usage(daily, path)

    return jobs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_path)
