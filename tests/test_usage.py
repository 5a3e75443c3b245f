import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablecensus.operators import usage
from tablecensus.schemas import USAGE_SCHEMA

AS_OF = dt.date(2024, 4, 30)


def day(back):
    return AS_OF - dt.timedelta(days=back)


@pytest.fixture
def daily(spark):
    def make(*rows):
        return spark.createDataFrame([(*t.split("."), *rest) for t, *rest in rows], USAGE_SCHEMA)

    return make


@pytest.fixture
def log(spark):
    def make(*rows):
        return spark.createDataFrame(
            [(*t.split("."), user, d) for t, user, d in rows],
            "project_id string, dataset_id string, table_id string, user_id string, dt date",
        )

    return make


def test_window_is_inclusive_and_open(daily, rows):
    given = daily(
        ("a.d.edge", day(90), 1, 1),
        ("a.d.before", day(91), 1, 1),
        ("a.d.future", day(-30), 1, 1),
        ("a.d.undated", None, 1, 1),
    )
    counted = usage.reference_counts(given, AS_OF)
    assert [r[2] for r in rows(counted)] == ["edge", "future"]
    assert [r[2] for r in rows(usage.reference_counts(given, AS_OF, 0))] == ["future"]


def test_counts_are_sums_of_days(daily, rows):
    given = daily(*[("a.d.t", day(i), 2, 1) for i in range(5)], ("a.d.u", day(0), None, None))
    counted = usage.reference_counts(given, AS_OF)
    assert rows(counted) == [("a", "d", "t", 10, 5), ("a", "d", "u", None, None)]
    assert dict(counted.dtypes)["job_count"] == "bigint"


def test_default_day_is_today_in_tokyo(daily):
    given = daily(("a.d.t", usage.today() - dt.timedelta(days=90), 1, 1))
    assert usage.reference_counts(given).count() == 1
    assert usage.reference_counts(given, days_back=89).count() == 0


def test_attach_keeps_every_listed_row(daily, tables, rows):
    listed = tables(("a.d.t", "VIEW"), ("a.d.t", "VIEW"), ("a.d.u", "CLONE"), ("a.d.n", "VIEW"))
    counts = usage.reference_counts(
        daily(("a.d.t", day(1), 3, 2), ("a.d.x", day(1), 9, 9), ("a.d.n", day(1), None, None)),
        AS_OF,
    )
    assert rows(usage.attach_usage(listed, counts)) == [
        ("a", "d", "n", "VIEW", 0, 0),
        ("a", "d", "t", "VIEW", 3, 2),
        ("a", "d", "t", "VIEW", 3, 2),
        ("a", "d", "u", "CLONE", 0, 0),
    ]


def test_attach_with_a_hot_table(spark, daily, tables):
    listed = spark.range(25_001).selectExpr(
        "'a' AS project_id", "'d' AS dataset_id", "'t' AS table_id", "'VIEW' AS table_type"
    )
    listed = listed.unionByName(tables(("a.d.u", "VIEW")))
    counts = usage.reference_counts(daily(("a.d.t", day(1), 3, 2)), AS_OF)
    attached = usage.attach_usage(listed, counts)
    assert attached.groupBy("table_id", "job_count").count().orderBy("table_id").collect() == [
        ("t", 3, 25_001), ("u", 0, 1),
    ]


def test_daily_usage_and_distinct_users(log, rows):
    given = log(
        *[("a.d.t", "ann", day(i)) for i in range(5)],
        ("a.d.t", "bob", day(0)),
        ("a.d.t", "bob", day(0)),
        ("a.d.t", None, day(0)),
        ("a.d.u", "ann", day(200)),
    )
    daily_rows = usage.daily_usage(given)
    assert rows(daily_rows.where(F.col("dt") == day(0))) == [("a", "d", "t", day(0), 4, 2)]
    summed = usage.reference_counts(daily_rows, AS_OF)
    assert rows(summed) == [("a", "d", "t", 8, 6)]
    assert rows(usage.unique_users_exact(given, AS_OF)) == [("a", "d", "t", 2)]
    approx = usage.unique_users_approx(usage.daily_user_sketches(given), AS_OF)
    assert rows(approx) == [("a", "d", "t", 2)]


def test_report_day_in_tokyo(spark):
    given = spark.sql(
        "SELECT TIMESTAMP_NTZ'2024-01-01 14:59:59' ts UNION ALL SELECT TIMESTAMP_NTZ'2024-01-01 15:00:00'"
    )
    days = lambda df: sorted(r.dt.day for r in usage.with_report_day(df).collect())
    assert days(given) == [1, 2]
    with_zone = spark.sql(
        "SELECT TIMESTAMP'2024-01-01 14:59:59Z' ts UNION ALL SELECT TIMESTAMP'2024-01-01 15:00:00Z'"
    )
    assert days(with_zone) == [1, 2]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert days(given) == [1, 2]
        assert days(with_zone) == [1, 2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
