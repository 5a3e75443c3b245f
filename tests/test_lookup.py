import re

import pytest

from tablecensus.operators import lineage
from tablecensus.operators.lookup import looked_up_neighbours, read_link_index, write_link_index


@pytest.fixture
def stored(spark, tmp_path):
    def make(links, **options):
        write_link_index(links, str(tmp_path / "index"), **options)
        return read_link_index(spark, str(tmp_path / "index"))

    return make


def test_equals_neighbours(links, ids, rows, stored):
    pairs = [(f"a.d.t{i}", f"a.d.t{(7 * i + k) % 60}") for i in range(60) for k in range(i % 4)]
    given = links(*pairs, *[("a.d.hub", f"b.d.t{i}") for i in range(80)], ("a.d.hub", "b.d.t1"))
    index = stored(given, parts=8)
    for chosen in (["a.d.t3"], ["a.d.hub", "a.d.hub", "b.d.t1"], [f"a.d.t{i}" for i in range(60)], ["x.y.z"]):
        assert rows(looked_up_neighbours(ids(*chosen), index)) == rows(lineage.neighbours(ids(*chosen), given))


def test_reads_only_the_folders_of_its_ids(links, ids, stored):
    index = stored(links(*[(f"a.d.s{i}", f"a.d.t{i}") for i in range(400)]), parts=32)
    found = looked_up_neighbours(ids("a.d.s5"), index)
    assert len(found.collect()) == 1
    plan = found._jdf.queryExecution().executedPlan()
    scan = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan.toString())
    assert "part" in scan[1] and "GreaterThanOrEqual(fqn,a.d.s5)" in scan[2]
    assert index.count() == 800
    read = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            read.append(node.metrics().apply("numOutputRows").value())
        if "Adaptive" in name:
            walk(node.executedPlan())
        elif "QueryStage" in name:
            walk(node.plan())
        else:
            for i in range(node.children().size()):
                walk(node.children().apply(i))

    walk(plan)
    assert len(read) == 1 and 0 < read[0] < 100  # of 800


def test_nothing_there(links, ids, raw_links, stored, spark):
    none = ids("a.d.t").limit(0)
    assert looked_up_neighbours(none, stored(links(("a.d.s", "a.d.t")))).count() == 0
    assert looked_up_neighbours(ids("a.d.t"), stored(raw_links())).count() == 0
    null = spark.createDataFrame([("a", None, "t")], ids("a.d.t").schema)
    assert looked_up_neighbours(null, stored(links(("a.d.s", "a.d.t")))).count() == 0
