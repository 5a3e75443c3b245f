import datetime as dt

import pytest

from tablecensus.functions.flags import is_unused
from tablecensus.operators import lifecycle
from tablecensus.operators.lifecycle import extend_history
from tablecensus.schemas import ANALYZED_SCHEMA, OWNERS_SCHEMA


@pytest.fixture
def analyzed(spark):
    def make(*rows):
        return spark.createDataFrame(
            [(*t.split("."), table_type, jobs, users) for t, table_type, jobs, users in rows],
            ANALYZED_SCHEMA,
        )

    return make


@pytest.fixture
def owners(spark):
    return lambda *rows: spark.createDataFrame([(*t.split("."), o) for t, o in rows], OWNERS_SCHEMA)


def by_table(df, *columns):
    return {r.table_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_unused_is_inclusive_and_ignores_users(analyzed):
    given = analyzed(("a.d.t", "VIEW", 3, 1), ("a.d.u", "VIEW", 0, 9))
    names = lambda df: sorted(r.table_id for r in df.collect())
    assert names(lifecycle.unused_tables(given)) == ["u"]
    assert names(lifecycle.unused_tables(given, 2)) == ["u"]
    assert names(lifecycle.unused_tables(given, 3)) == ["t", "u"]
    assert names(lifecycle.unused_tables(given, 5)) == ["t", "u"]


def test_unused_of_unchecked(spark, analyzed):
    given = analyzed(("a.d.t", "VIEW", None, None))
    assert given.select(is_unused()).first()[0] is None
    with pytest.raises(Exception, match="usage was not checked"):
        given.select(is_unused(strict=True)).collect()
    checked = analyzed(("a.d.t", "VIEW", 0, 0))
    assert checked.select(is_unused(strict=True)).first()[0] is True


def test_stages(tables, analyzed, owners):
    start = lifecycle.discovered(tables(*[(f"a.d.{n}", "VIEW") for n in "nco"], ("a.d.b", "CLONE")))
    report = lambda df: by_table(
        lifecycle.lifecycle_report(df), "stage", "is_checked", "is_candidate", "is_unused"
    )
    assert set(report(start).values()) == {("discovered", False, False, None)}
    checked = lifecycle.with_usage_info(
        start, analyzed(("a.d.c", "VIEW", 0, 0), ("a.d.b", "CLONE", 4, 2))
    )
    owned = lifecycle.with_deletion_info(checked, owners(("a.d.o", "zoe"), ("a.d.b", "zoe"), ("a.d.b", "amy")))
    assert report(owned) == {
        "n": ("discovered", False, False, None),
        "c": ("checked", True, False, True),
        "o": ("candidate", False, True, None),
        "b": ("candidate", True, True, False),
    }
    assert by_table(lifecycle.lifecycle_report(owned), "data_owner")["b"] == ("amy",)


def test_new_info_replaces_its_kind_only(tables, analyzed, owners):
    start = lifecycle.discovered(tables(("a.d.t", "VIEW"), ("a.d.t", "VIEW"), ("a.d.u", "VIEW")))
    known = lifecycle.with_info(
        start,
        analyzed(("a.d.t", "VIEW", 1, 1), ("a.d.u", "VIEW", 2, 2)),
        owners(("a.d.t", "amy"), ("a.d.u", "bob")),
    )
    assert known.count() == 3
    newer = lifecycle.with_usage_info(known, analyzed(("a.d.t", "VIEW", 7, 5)))
    columns = ("job_count", "unique_user", "data_owner")
    assert by_table(lifecycle.lifecycle_report(newer), *columns) == {"t": (7, 5, "amy"), "u": (2, 2, "bob")}
    moved = lifecycle.with_deletion_info(newer, owners(("a.d.t", "cat")))
    assert by_table(lifecycle.lifecycle_report(moved), *columns) == {"t": (7, 5, "cat"), "u": (2, 2, "bob")}
    flat = lifecycle.flatten_analyzed(moved)
    assert flat.columns == ANALYZED_SCHEMA.names
    assert flat.count() == 3


def test_unused_leaves(analyzed, links):
    given = analyzed(("a.d.s", "VIEW", 0, 0), ("a.d.t", "CLONE", 0, 0), ("a.d.u", "VIEW", 4, 1))
    found = lifecycle.unused_leaves(given, links(("a.d.s", "a.d.t"), ("a.d.s", "a.d.u")))
    assert by_table(found, "table_type", "job_count", "upstream_count") == {"t": ("CLONE", 0, 1)}


def test_usage_summary(analyzed, rows):
    given = analyzed(("a.d.s", "VIEW", 0, 0), ("a.d.t", "VIEW", 6, 1), ("a.e.u", "VIEW", 4, 1))
    summary = lifecycle.usage_summary(given, ["project_id", "dataset_id"])
    assert rows(summary) == [("a", "d", 2, 1, 6, 0.5), ("a", "e", 1, 0, 4, 0.0)]


def test_usage_is_one_value_and_null_is_zero(tables, analyzed):
    start = lifecycle.discovered(tables(("a.d.t", "VIEW"), ("a.d.n", "VIEW")))
    counts = analyzed(("a.d.t", "VIEW", 100, 5), ("a.d.t", "VIEW", 50, 30), ("a.d.n", "VIEW", None, None))
    report = lifecycle.lifecycle_report(lifecycle.with_usage_info(start, counts))
    assert by_table(report, "job_count", "unique_user", "is_unused") == {"t": (100, 5, False), "n": (0, 0, True)}


def test_summary_of_all_levels(spark):
    rows = [("a", "d", "t1", "VIEW", 0), ("a", "d", "t2", None, 3), ("a", None, "t3", "VIEW", 1), ("b", "d", "t4", "VIEW", 0)]
    df = spark.createDataFrame(rows, "project_id string, dataset_id string, table_id string, table_type string, job_count long")
    out = lifecycle.usage_summary_levels(df)
    got = {(r.level, r.project_id, r.dataset_id, r.table_type): (r.tables, r.unused_tables, r.jobs) for r in out.collect()}
    assert got == {
        (0, None, None, None): (4, 2, 4),
        (1, "a", None, None): (3, 1, 4), (1, "b", None, None): (1, 1, 0),
        (2, "a", "d", None): (2, 1, 3), (2, "a", None, None): (1, 0, 1), (2, "b", "d", None): (1, 1, 0),
        (3, "a", "d", "VIEW"): (1, 1, 0), (3, "a", "d", None): (1, 0, 3), (3, "a", None, "VIEW"): (1, 0, 1), (3, "b", "d", "VIEW"): (1, 1, 0),
    }
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    assert lifecycle.usage_summary_levels(df.limit(0)).count() == 0


def test_history_of_changes(spark):
    """Changed, unchanged, gone, back, repeated rows, null values; a snapshot given again."""
    schema = "project_id string, dataset_id string, table_id string, stage string, data_owner string, other int"

    def snapshot(*rows):
        return spark.createDataFrame([("p", "d", *r, 1) for r in rows], schema)

    day = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    first = snapshot(("a", "discovered", None), ("b", "checked", None), ("c", "checked", "x"), (None, "checked", None))
    second = snapshot(("a", "checked", None), ("b", "checked", None), (None, "checked", None), (None, "checked", None))
    third = snapshot(("a", "checked", "y"), ("c", "checked", "x"), ("b", "checked", None), (None, "checked", None))

    def held(history):
        return sorted(((r.table_id or "-", r.stage, r.data_owner, r.valid_from, r.valid_to) for r in history.collect()), key=str)

    history = extend_history(first, day[0])
    assert held(history) == sorted([
        ("a", "discovered", None, day[0], None), ("b", "checked", None, day[0], None),
        ("c", "checked", "x", day[0], None), ("-", "checked", None, day[0], None),
    ], key=str)
    history = extend_history(second, day[1], history)
    assert held(extend_history(second, day[1], history)) == held(history)
    history = extend_history(third, day[2], history)
    want = [
        ("a", "discovered", None, day[0], day[1]), ("a", "checked", None, day[1], day[2]), ("a", "checked", "y", day[2], None),
        ("b", "checked", None, day[0], None), ("-", "checked", None, day[0], None),
        ("c", "checked", "x", day[0], day[1]), ("c", "checked", "x", day[2], None),
    ]
    assert held(history) == sorted(want, key=str)
    corrected = extend_history(third.where("table_id <> 'a'"), day[2], history)
    assert ("a", "checked", "y") not in [r[:3] for r in held(corrected)]
    assert held(extend_history(third.limit(0), day[2], spark.createDataFrame([], history.schema))) == []
