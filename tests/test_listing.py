import random

import pytest

from tablecensus.functions.flags import type_flags
from tablecensus.operators import listing
from tablecensus.schemas import CATALOG_SCHEMA, TABLE_TYPES


@pytest.fixture
def catalog(spark):
    return lambda *rows: spark.createDataFrame(list(rows), CATALOG_SCHEMA)


def datasets(df):
    return sorted(r.dataset_id for r in df.collect())


def test_projects_are_selected_once(catalog, rows):
    given = catalog(
        ("a", "d", "t", "VIEW"), ("b", "d", "t", "CLONE"), ("c", "d", "t", "VIEW")
    )
    listed = listing.list_tables(given, ["a", "b", "a"])
    assert rows(listed) == [("a", "d", "t", "VIEW"), ("b", "d", "t", "CLONE")]
    assert listed.columns == ["project_id", "dataset_id", "table_id", "table_type"]


def test_no_projects_no_scan(catalog):
    listed = listing.list_tables(catalog(("a", "d", "t", "VIEW")), [])
    assert listed.count() == 0
    assert listed.columns == ["project_id", "dataset_id", "table_id", "table_type"]


def test_dataset_filters(catalog):
    names = ["test", "testing", "tests", "test_x", "Test_a", "atest_x", "audit_log", "audit_log2", None]
    given = catalog(*[("a", name, "t", "VIEW") for name in names])
    listed = listing.list_tables(given, ["a"], ["audit_log"])
    assert datasets(listed) == ["Test_a", "atest_x", "audit_log2", "test"]


def test_unknown_type_fails_even_if_unused(catalog):
    given = catalog(("a", "d", "t", "VIEW"), ("a", "d", "u", "view"))
    with pytest.raises(Exception, match="Unknown table type: view"):
        listing.list_tables(given, ["a"]).select("table_id").collect()
    missing = catalog(("a", "d", "t", None))
    with pytest.raises(Exception, match="Unknown table type: NULL"):
        listing.list_tables(missing, ["a"]).collect()


def test_unknown_type_elsewhere_does_not_matter(catalog):
    given = catalog(("a", "d", "t", "VIEW"), ("a", "audit_log", "u", "x"), ("b", "d", "u", "x"))
    assert listing.list_tables(given, ["a"], ["audit_log"]).count() == 1


def test_unknown_type_kept_and_split(catalog, rows):
    given = catalog(("a", "d", "t", "VIEW"), ("a", "d", "u", "view"), ("a", "d", "v", None))
    valid, rejected = listing.split_by_type(
        listing.list_tables(given, ["a"], on_invalid="keep")
    )
    assert [r[2] for r in rows(valid)] == ["t"]
    assert [r[2] for r in rows(rejected)] == ["u", "v"]
    with pytest.raises(ValueError):
        listing.list_tables(given, ["a"], on_invalid="ignore")


def test_type_flags(tables):
    given = tables(*[(f"a.d.t{i}", t) for i, t in enumerate([*TABLE_TYPES, "view"])])
    flags = [tuple(r) for r in given.select(*type_flags()).collect()]
    assert flags == [tuple(i == j for j in range(6)) for i in range(7)]


def test_merge_listings_is_the_full_outer_join(spark, tables, rows):
    a = tables(("a.d.t", "VIEW"), ("a.d.u", "VIEW")).unionByName(
        spark.createDataFrame([("a", "d", None, "VIEW")], tables(("a.d.t", "VIEW")).schema)
    )
    b = tables(("b.d.t", "VIEW"))
    by_join = a
    for other in (b, a):
        by_join = by_join.join(other, a.columns, "full")
    merged = listing.merge_listings([a, b, a])
    assert rows(merged) == rows(by_join)
    assert merged.count() == 5


@pytest.mark.parametrize("seed", range(3))
def test_merge_listings_with_repeats_and_nulls(spark, tables, rows, seed):
    draw = random.Random(seed)
    schema = tables(("a.d.t", "VIEW")).schema
    row = lambda: ("a", "d", draw.choice(["t", "u", "v", None]), draw.choice(["VIEW", "CLONE"]))
    given = [spark.createDataFrame([row() for _ in range(draw.randrange(1, 7))], schema) for _ in range(3)]
    by_join = given[0]
    for other in given[1:]:
        by_join = by_join.join(other, by_join.columns, "full")
    assert rows(listing.merge_listings(given)) == rows(by_join)
    assert rows(listing.merge_listings(given[:1])) == rows(given[0])


def test_dedup_hashes_before_the_exchange(tables):
    plan = listing.dedup_tables(tables(("a.d.t", "VIEW")))._jdf.queryExecution().executedPlan().toString()
    lines = [line.strip(" :+-*()0123456789") for line in plan.splitlines()]
    first = max(i for i, line in enumerate(lines) if line.startswith("Exchange"))
    assert lines[first + 1].startswith("HashAggregate") and not any(line.startswith("Sort") for line in lines[first:])


def test_dedup_keeps_the_first_in_order(tables, rows):
    given = tables(("a.d.t", "VIEW"), ("a.d.t", "CLONE"), ("a.d.u", "VIEW"), ("a.d.t", "VIEW"))
    assert rows(listing.dedup_tables(given)) == [
        ("a", "d", "t", "CLONE"), ("a", "d", "u", "VIEW"),
    ]
    seen = given.withColumn("seen", given.table_type == "CLONE")
    assert rows(listing.dedup_tables(seen, ["seen"])) == [
        ("a", "d", "t", "VIEW", False), ("a", "d", "u", "VIEW", False),
    ]


def test_table_ids(spark, rows):
    assert rows(listing.table_ids(spark, [("a", "d", "t")])) == [("a", "d", "t")]
    assert listing.table_ids(spark, []).count() == 0
