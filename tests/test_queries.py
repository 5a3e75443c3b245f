import pytest
from check_oracles import connect, spark_rows, sql_rows

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_registered():
    own = {n for n in entry.queries() if n not in entry.LLM_QUERIES}
    assert own == {n for n in entry.oracle_sql() if n not in entry.LLM_ORACLES}
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - set(entry.LLM_ORACLES)))
def test_query_equals_its_sql(spark, con, name):
    assert spark_rows(entry.queries()[name](spark, FOLDER)) == sql_rows(con, entry.oracle_sql()[name])


@pytest.mark.parametrize(
    "name", ["table_neighbour_pages", "table_neighbour_pages_small", "table_neighbour_pages_dense", "leaf_from_roots_hub"]
)
def test_query_equals_its_sql_on_more_rows(spark, name):
    """Cases that the smallest tables do not have."""
    folder = "/root/testdata/sf0.01"
    assert spark_rows(entry.queries()[name](spark, folder)) == sql_rows(connect(folder), entry.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 82


def test_invariants(spark):
    q = entry.queries()
    exact = {tuple(r)[:3]: r.unique_user_exact for r in q["unique_users_exact"](spark, FOLDER).collect()}
    days = {tuple(r)[:3]: r.unique_user for r in q["reference_counts"](spark, FOLDER).collect()}
    assert exact.keys() == days.keys()
    assert all(exact[k] <= days[k] for k in exact)
    assert q["analyzed_tables"](spark, FOLDER).count() == q["list_tables"](spark, FOLDER).count()


def test_window_reads_only_its_days(spark):
    plan = entry.queries()["reference_counts_stored"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
