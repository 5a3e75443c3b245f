import pytest
from pyspark.sql import functions as F

from tablecensus.operators import lineage
from tablecensus.operators.skew import collapse, expand


def leaves(df):
    return sorted((r.fqn, r.upstream_count) for r in df.collect())


def degrees(df):
    return {r.fqn: (r.upstream_count, r.downstream_count) for r in df.collect()}


def test_degrees_count_links_in_their_own_scope(raw_links):
    given = raw_links(
        ("a", "us", "bigquery:a.d.s", "bigquery:a.d.t"),
        ("a", "us", "bigquery:a.d.s", "bigquery:a.d.t"),
        ("a", "eu", "bigquery:a.d.s", "bigquery:a.d.t"),
        ("a", "us", "bigquery:a.d.s", "bigquery:b.d.t"),  # not under b: b.d.t has no upstream
        ("b", "us", "bigquery:a.d.x", "bigquery:b.d.u"),  # not under a: a.d.x has no downstream
        ("a", "us", "bigquery:a.d.s", "spanner:i.d.t"),
        ("a", "us", "spanner:i.d.t", "bigquery:a.d.t"),
        ("a", "us", "bigquery:a.d.t.col", "bigquery:a.d.t"),
        (None, "us", "bigquery:a.d.s", "bigquery:a.d.t"),
        ("a", "us", None, "bigquery:a.d.t"),
    )
    assert degrees(lineage.link_degrees(given)) == {
        "a.d.s": (0, 3), "a.d.t": (2, 0), "b.d.u": (1, 0),
    }
    assert degrees(lineage.link_degrees(given, location="eu")) == {
        "a.d.s": (0, 1), "a.d.t": (1, 0),
    }
    counts = lineage.upstream_counts(given)
    assert sorted((r.table_id, r.upstream_count) for r in counts.collect()) == [("t", 2), ("u", 1)]


def test_sharded_ends(raw_links, ids):
    given = raw_links(
        ("a", "us", "bigquery:sharded:a.d.s", "bigquery:a.d.t"),
        ("a", "us", "bigquery:a.d.s2", "bigquery:sharded:a.d.t"),
    )
    looked_up = ids("a.d.s", "a.d.s2", "a.d.t")
    assert leaves(lineage.leaf_tables(looked_up, given)) == [("a.d.s", 0), ("a.d.t", 1)]
    assert leaves(lineage.leaf_tables(looked_up, given, match_sharded=True)) == [("a.d.t", 2)]


def test_domain_scoped_project_is_found_as_looked_up_table_only(spark, raw_links):
    given = raw_links(
        ("x.com:p", "us", "bigquery:x.com:p.d.s", "bigquery:a.d.t"),
        ("a", "us", "bigquery:a.d.s", "bigquery:x.com:p.d.t"),
    )
    looked_up = spark.createDataFrame(
        [("x.com:p", "d", "s"), ("a", "d", "s")], "project_id string, dataset_id string, table_id string"
    )
    assert leaves(lineage.leaf_tables(looked_up, given)) == [("a.d.s", 0)]


def test_fence(links, ids):
    given = links(("a.d.s", "b.d.t"), ("b.d.t", "c.d.u"), ("z.d.x", "a.d.s"))
    looked_up = ids("a.d.s", "b.d.t", "c.d.u")
    for no_fence in (None, []):
        assert leaves(lineage.leaf_tables(looked_up, given, no_fence)) == [("c.d.u", 1)]
    # listed tables are not fenced, nor is the upstream count
    assert leaves(lineage.leaf_tables(looked_up, given, ["a", "b"])) == [
        ("b.d.t", 1), ("c.d.u", 1),
    ]
    assert leaves(lineage.leaf_tables(looked_up, given, ["nowhere"])) == [
        ("a.d.s", 1), ("b.d.t", 1), ("c.d.u", 1),
    ]


def test_leaves_of_a_list_with_repeats(links, ids):
    given = links(("a.d.s", "a.d.t"), ("a.d.self", "a.d.self"))
    looked_up = ids("a.d.t", "a.d.s", "a.d.t", "a.d.self", "a.d.alone")
    found = lineage.leaf_tables(looked_up, given)
    assert leaves(found) == [("a.d.alone", 0), ("a.d.t", 1), ("a.d.t", 1)]
    assert found.columns == ["project_id", "dataset_id", "table_id", "fqn", "upstream_count"]
    assert lineage.leaf_tables(looked_up.limit(0), given).count() == 0
    assert leaves(lineage.leaf_tables(looked_up, given.limit(0)))[0] == ("a.d.alone", 0)


def test_table_lineage(links, ids, rows):
    given = links(("a.d.up", "a.d.t"), ("a.d.t", "a.d.down"), ("a.d.t", "a.d.down"))
    found = lineage.table_lineage(ids("a.d.t", "a.d.t", "a.d.down", "a.d.alone"), given)
    assert rows(found) == [
        ("a", "d", "alone", 0, 0, True, False, False),
        ("a", "d", "down", 2, 0, True, True, False),
        ("a", "d", "t", 1, 2, False, True, True),
    ]


def test_neighbours(join_mode, links, ids):
    given = links(
        ("a.d.up", "a.d.t"), ("a.d.t", "b.d.down"), ("a.d.t", "b.d.down"),
        ("a.d.t", "a.d.t"), ("a.d.other", "a.d.down2"),
    )
    found = lineage.neighbours(ids("a.d.t", "a.d.t", "a.d.alone"), given)
    short = sorted(
        (r.table_id, r.direction, r.neighbour_project_id, r.neighbour_table_id, r.link_count)
        for r in found.collect()
    )
    assert short == [
        ("t", "downstream", "a", "t", 1),
        ("t", "downstream", "b", "down", 2),
        ("t", "upstream", "a", "t", 1),
        ("t", "upstream", "a", "up", 1),
    ]


@pytest.mark.parametrize("page_size", [3, 10_000])
def test_neighbour_pages_are_bounded_and_whole(join_mode, spark, links, ids, page_size):
    given = links(*[("a.d.hub", f"a.d.t{i:03}") for i in range(100)], ("a.d.x", "a.d.y"))
    found = lineage.neighbours(ids("a.d.hub", "a.d.x"), given)
    pages = lineage.neighbour_pages(found, page_size).collect()
    hub = [p for p in pages if p.table_id == "hub"]
    names = [n.table_id for p in hub for n in p.neighbours]
    assert sorted(names) == [f"t{i:03}" for i in range(100)]
    assert [p.page for p in pages if p.table_id == "x"] == [0]
    assert all([n.table_id for n in p.neighbours] == sorted(n.table_id for n in p.neighbours) for p in hub)
    if page_size == 3:
        assert len(hub) > 20 and max(len(p.neighbours) for p in hub) < 15
    else:
        assert len(hub) == 1


@pytest.mark.parametrize("page_size", [1, 3, 7])
def test_pages_are_dense_and_full(join_mode, links, ids, page_size):
    sizes = {"none": 0, "one": 1, "three": 3, "seven": 7, "hub": 150}
    pairs = [(f"a.d.{name}", f"{p}.d.t{i:03}") for name, n in sizes.items() for i in range(n) for p in ["ab"[i % 2]]]
    looked_up = ids(*[f"a.d.{name}" for name in sizes], "a.d.three")
    found = lineage.neighbours(looked_up, links(*pairs))
    pages = lineage.neighbour_pages(found, page_size, looked_up).collect()
    for name, n in sizes.items():
        mine = sorted(p for p in pages if p.table_id == name and p.direction == "downstream")
        count = max(1, -(-n // page_size))
        assert [p.page for p in mine] == list(range(count))
        assert [len(p.neighbours) for p in mine[:-1]] == [page_size] * (count - 1)
        entries = [(e.project_id, e.table_id) for p in mine for e in p.neighbours]
        assert entries == sorted(("ab"[i % 2], f"t{i:03}") for i in range(n))
        assert [(p.page, p.neighbours) for p in pages if p.table_id == name and p.direction == "upstream"] == [(0, [])]


def test_judge_links(raw_links, rows):
    judged = lineage.judge_links(
        raw_links(
            ("a", "us", "bigquery:a.d.s", "bigquery:sharded:a.d.t"),
            ("a", "us", "spanner:i.d.s", "bigquery:a.d"),
            ("a", "us", "bigquery:a.d.s", "bigquery:a.d"),
            ("a", "us", "bigquery:a.d.s", None),
        )
    )
    good, bad = lineage.split_links(judged)
    assert rows(good) == [("a", "us", "a.d.s", "a.d.t")]
    assert sorted(r.reason for r in bad.collect()) == [
        "source_other_system", "target_missing", "target_not_three_parts",
    ]


def test_collapse_and_expand_give_the_rows_back(spark):
    given = spark.range(60_000).select(
        F.when(F.col("id") < 35_001, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("x"),
        F.lit(None).cast("string").alias("y"),
    )
    back = expand(collapse(given))
    assert back.columns == given.columns
    assert back.exceptAll(given).count() == 0 and given.exceptAll(back).count() == 0
    largest = max(back.rdd.glom().map(len).collect())
    assert largest < 35_001


def test_links_are_read_once(spark, links, ids):
    given = links(("a.d.s", "a.d.t"), ("a.d.t", "a.d.u"))
    many = spark.range(20_001).selectExpr(
        "'a' AS project_id", "'d' AS dataset_id", "'u' AS table_id"
    )
    found = lineage.leaf_tables(many.unionByName(ids("a.d.s", "a.d.t")), given)
    assert found.groupBy("fqn", "upstream_count").count().collect() == [("a.d.u", 1, 20_001)]
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("StartsWith(source_fqn") > 0
    assert plan.count("ReusedExchange") >= 2
    assert plan.count("Generate inline") == 1


def test_pages_of_tables_without_neighbours(links, ids):
    looked_up = ids("a.d.t", "a.d.alone", "a.d.alone")
    found = lineage.neighbours(looked_up, links(("a.d.t", "a.d.u")))
    pages = lineage.neighbour_pages(found, ids=looked_up).collect()
    got = sorted((r.table_id, r.direction, r.page, [n.table_id for n in r.neighbours]) for r in pages)
    assert got == [
        ("alone", "downstream", 0, []), ("alone", "upstream", 0, []), ("t", "downstream", 0, ["u"]), ("t", "upstream", 0, []),
    ]
