import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablecensus.operators.usage import daily_usage, with_report_day
from tablecensus.sources.inputs import read_usage
from tablecensus.sources.outputs import write_daily_usage
from tablecensus.streaming.daily_usage import (
    daily_usage_stream,
    write_daily_usage_stream,
    write_exact_daily_usage_stream,
)

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(params=["UTC", "America/New_York"])
def session_zone(request, spark):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_stream_agrees_with_the_batch_rollup(spark, session_zone, tmp_path, rows):
    source, out = str(tmp_path / "events"), str(tmp_path / "usage")
    events = spark.read.parquet(EVENTS).select("ts", "event_type", "user_id")
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    daily = daily_usage_stream(stream, keys=["event_type"], late="2 days")
    query = (
        write_daily_usage_stream(daily, out, str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(240)
    columns = ["event_type", "dt", "job_count", "unique_user"]
    batch = daily_usage(with_report_day(events), ["event_type"])
    last = batch.agg(F.max("dt")).first()[0]
    closed = batch.where(F.col("dt") < F.date_sub(F.lit(last), 2))
    streamed = rows(spark.read.parquet(out).select(*columns))
    assert set(rows(closed.select(*columns))) <= set(streamed) <= set(rows(batch.select(*columns)))
    assert len(streamed) > 100


def test_stream_and_batch_share_one_store(spark, tmp_path, rows):
    """Stream days, repair one by batch, add another by batch: all are read."""
    out = str(tmp_path / "usage")
    schema = "ts timestamp, project_id string, dataset_id string, table_id string, user_id bigint"
    job = lambda day, user: (dt.datetime(2024, 1, day, 12), "p", "d", "t", user)
    early = spark.createDataFrame([job(1, 1), job(1, 2), job(2, 1), job(9, 1)], schema)
    early.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(early.schema).parquet(str(tmp_path / "log"))
    for _ in range(2):  # the second run finds nothing new
        query = write_daily_usage_stream(
            daily_usage_stream(stream), out, str(tmp_path / "checkpoint")
        ).trigger(availableNow=True).start()
        assert query.awaitTermination(240)
    every = early.unionByName(spark.createDataFrame([job(2, 7), job(3, 4)], schema))
    batch = daily_usage(with_report_day(every)).where("dt < '2024-01-05'")
    stored = lambda: rows(read_usage(spark, out).select(*batch.columns))
    assert [r[3:] for r in stored()] == [(dt.date(2024, 1, 1), 2, 2), (dt.date(2024, 1, 2), 1, 1)]
    write_daily_usage(batch.where("dt = '2024-01-02'"), out)
    write_daily_usage(batch.where("dt = '2024-01-03'"), out)
    assert stored() == rows(batch)


def test_late_jobs_change_their_day(spark, tmp_path, rows):
    """Batches in any order, a month late too; null times and users; after each the batch rollup."""
    schema = "ts timestamp, project_id string, dataset_id string, table_id string, user_id bigint"
    job = lambda month, day, user, table="t": (dt.datetime(2024, month, day, 12), "p", "d", table, user)
    batches = [
        [job(2, 1, 1), job(2, 1, 1), job(2, 2, 1), (None, "p", "d", "t", 1)],
        [job(1, 1, 1), job(2, 1, 2), job(2, 1, None), job(2, 2, 5, None)],
        [job(1, 1, 1), job(1, 1, 3), job(2, 1, 2), job(2, 1, None)],
        [(None, "p", "d", "t", 1)],
    ]
    source, out, users, state = (str(tmp_path / n) for n in ("log", "usage", "users", "state"))
    seen = []

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        query = write_exact_daily_usage_stream(stream, out, users, state).trigger(availableNow=True).start()
        assert query.awaitTermination(240)

    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        seen += [job for job in batch if job[0]]
        run()
        want = daily_usage(with_report_day(spark.createDataFrame(seen, schema)))
        assert rows(read_usage(spark, out).select(*want.columns)) == rows(want)
    run()  # nothing new
    assert rows(read_usage(spark, out).select(*want.columns)) == rows(want)


def test_a_batch_run_again_counts_once(spark, tmp_path, rows):
    schema = "ts timestamp, project_id string, dataset_id string, table_id string, user_id bigint"
    source, out, users = (str(tmp_path / n) for n in ("log", "usage", "users"))
    jobs = spark.createDataFrame([(dt.datetime(2024, 1, 1, 12), "p", "d", "t", u) for u in (1, 1, 2)], schema)
    jobs.write.parquet(source)
    for state in ("first", "again"):  # without its checkpoint, batch 0 is run once more
        stream = spark.readStream.schema(schema).parquet(source)
        writer = write_exact_daily_usage_stream(stream, out, users, str(tmp_path / state))
        assert writer.trigger(availableNow=True).start().awaitTermination(240)
    want = daily_usage(with_report_day(jobs))
    assert rows(read_usage(spark, out).select(*want.columns)) == rows(want)
