import datetime as dt
import random

import pytest

from tablecensus.operators import usage
from tablecensus.session import bounded_tasks

DAY = dt.date(2024, 3, 1)
LOG = "project_id string, dataset_id string, table_id string, user_id long, dt date"


@pytest.fixture(scope="module")
def log(spark):
    """A table with most of the log, quiet ones, users and days that are null."""
    draw = random.Random(1)
    rows = []
    for _ in range(3_000):
        table = "hot" if draw.random() < 0.6 else draw.choice(["a", "b", "c"])
        user = draw.choice([None, 1 << 40, *range(70_000, 70_090), *range(40)])
        day = None if draw.random() < 0.02 else DAY + dt.timedelta(days=draw.randrange(-100, 20))
        rows.append(("p", "d", table, user, day))
    rows += [("p", "d", "old", 5, DAY - dt.timedelta(days=500)), *[("p", None, "n", 5, DAY - dt.timedelta(days=i)) for i in (0, 9, 40)]]
    return rows, spark.createDataFrame(rows, LOG)


WINDOWS = [(0, None), (1, None), (7, None), (30, DAY - dt.timedelta(days=10)), (90, DAY), (1_000, None), (5, DAY - dt.timedelta(days=50))]


@pytest.mark.parametrize("days_back, last_day", WINDOWS)
def test_counts_from_totals(spark, log, days_back, last_day):
    daily = usage.daily_usage(log[1])
    want = daily if last_day is None else daily.where(f"dt <= DATE '{last_day}'")
    want = usage.reference_counts(want, DAY, days_back)
    totals = usage.usage_totals(daily)
    got = usage.reference_counts_from_totals(totals, DAY, days_back, last_day)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("days_back, last_day", WINDOWS)
def test_users_from_bitmaps(spark, log, days_back, last_day):
    rows, df = log
    bitmaps = usage.daily_user_bitmaps(df, usage.user_dictionary(df))
    got = {tuple(r)[:3]: r.unique_user_exact for r in usage.unique_users_from_bitmaps(bitmaps, DAY, days_back, last_day).collect()}
    first = DAY - dt.timedelta(days=days_back)
    people = {}
    for p, d, t, user, day in rows:
        if user is not None and day is not None and first <= day and (last_day is None or day <= last_day):
            people.setdefault((p, d, t), set()).add(user)
    assert got == {k: len(v) for k, v in people.items()}


def test_dictionary_is_dense(spark):
    df = spark.range(0, 100_000, 7).selectExpr("id AS user_id")
    found = usage.user_dictionary(df.union(df))
    first, last, n = found.selectExpr("min(user_number)", "max(user_number)", "count(distinct user_number)").first()
    assert (first, last, n) == (0, 14_285, 14_286) and found.count() == n


def test_no_usage(spark, log):
    none = log[1].limit(0)
    assert usage.reference_counts_from_totals(usage.usage_totals(usage.daily_usage(none)), DAY).count() == 0
    bitmaps = usage.daily_user_bitmaps(none, usage.user_dictionary(none))
    assert usage.unique_users_from_bitmaps(bitmaps, DAY).count() == 0


def test_two_rows_per_table(spark, log):
    totals = usage.usage_totals(usage.daily_usage(log[1]))
    day = DAY - dt.timedelta(days=30)
    held = totals.where(f"dt <= DATE '{day}' AND (until IS NULL OR until >= DATE '{day}')")
    assert held.groupBy("project_id", "dataset_id", "table_id").count().where("count > 1").count() == 0


def test_bitmaps_are_no_wider_than_their_users(spark):
    """Scattered users, and all bits of a block, also the sign's."""
    few = [("p", "d", "few", n * 997, DAY) for n in range(128)]
    many = [("p", "d", "many", n, DAY) for n in range(130)] * 2
    df = spark.createDataFrame(few + many, LOG)
    dictionary = spark.createDataFrame([(n, n) for n in {r[3] for r in few + many}], "user_id long, user_number long")
    bitmaps = usage.daily_user_bitmaps(df, dictionary)
    assert {f.name: f.dataType.simpleString() for f in bitmaps.schema}["user_bits"] == "bigint"
    assert {r.table_id: r["count"] for r in bitmaps.groupBy("table_id").count().collect()} == {"few": 128, "many": 3}
    found = usage.unique_users_from_bitmaps(bitmaps, DAY)
    assert {r.table_id: r.unique_user_exact for r in found.collect()} == {"few": 128, "many": 130}
    assert found.schema["unique_user_exact"].dataType.simpleString() == "bigint"


def test_totals_of_repeated_days_need_no_aggregation(spark):
    """Rows of one day count together, null counts as none, and nothing is grouped before the window."""
    rows = [("a", 0, 1, None), ("a", 0, 2, 5), ("a", 3, None, 1), ("b", 1, None, None), ("a", None, 9, 9)]
    rows = [("p", None, t, None if d is None else DAY + dt.timedelta(days=d), jobs, users) for t, d, jobs, users in rows]
    daily = spark.createDataFrame(rows, "project_id string, dataset_id string, table_id string, dt date, job_count long, unique_user long")
    totals = usage.usage_totals(daily)
    assert sorted(tuple(r)[2:] for r in totals.collect()) == [
        ("a", DAY, 3, 5, DAY + dt.timedelta(days=2)), ("a", DAY + dt.timedelta(days=3), 3, 6, None),
        ("b", DAY + dt.timedelta(days=1), 0, 0, None),
    ]
    assert "Aggregate" not in totals._jdf.queryExecution().executedPlan().toString()


def test_tasks_stay_bounded(spark):
    name, size = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name), spark.conf.get(size)
    with bounded_tasks(spark, 10_000_001):
        assert int(spark.conf.get(name)) == 21 and int(spark.conf.get(size)) == 16 << 20
    with bounded_tasks(spark, 10):
        assert spark.conf.get(name) == before[0]
    assert (spark.conf.get(name), spark.conf.get(size)) == before
