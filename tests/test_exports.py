import datetime as dt

import pytest

from tablecensus.plans import exports
from tablecensus.schemas import ANALYZED_SCHEMA, CATALOG_SCHEMA, LEAVES_SCHEMA, USAGE_SCHEMA
from tablecensus.sources.outputs import read_export

AS_OF = dt.date(2024, 4, 30)


@pytest.fixture
def catalog(spark):
    return spark.createDataFrame(
        [
            ("a", "d", "s", "BASE TABLE"),
            ("a", "d", "t", "VIEW"),
            ("a", "test_d", "x", "VIEW"),
            ("b", "d", "t", "VIEW"),
        ],
        CATALOG_SCHEMA,
    )


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_leaves_of_projects(spark, tmp_path, catalog, links, rows, fmt):
    path = str(tmp_path / "out")
    given = links(("a.d.s", "a.d.t"), ("a.d.t", "b.d.t"))
    done = exports.export_leaf_tables(given, path, catalog, ["a"], fmt=fmt)
    assert (done.total_tables, done.exported_tables) == (2, 0)
    done = exports.export_leaf_tables(given, path, catalog, ["a"], allowed_projects=["a"], fmt=fmt)
    assert done == exports.ExportResult(2, 1, path)
    assert rows(read_export(spark, path, LEAVES_SCHEMA, fmt)) == [("a", "d", "t", "a.d.t", 1)]


def test_leaves_from_roots(spark, tmp_path, links, ids, rows):
    path = str(tmp_path / "out")
    given = links(("a.d.s", "a.d.t"), ("a.d.t", "b.d.t"))
    done = exports.export_leaf_tables(given, path, roots=ids("a.d.s", "a.d.s"))
    assert done == exports.ExportResult(2, 1, path)
    assert rows(read_export(spark, path, LEAVES_SCHEMA)) == [("b", "d", "t", "b.d.t", 1)]
    done = exports.export_leaf_tables(given, path, roots=ids("a.d.s").limit(0))
    assert done == exports.ExportResult(0, 0, path)


def test_arguments(tmp_path, catalog, links, ids):
    given, path = links(("a.d.s", "a.d.t")), str(tmp_path / "out")
    with pytest.raises(ValueError):
        exports.export_leaf_tables(given, path, catalog)
    with pytest.raises(ValueError):
        exports.export_leaf_tables(given, path, catalog, ["a"], ids("a.d.s"))
    with pytest.raises(ValueError):
        exports.export_leaf_tables(given, path, project_ids=["a"])
    with pytest.raises(ValueError, match="Unsupported format"):
        exports.export_leaf_tables(given, path, catalog, ["a"], fmt="xml")
    assert exports.export_leaf_tables(given, path, catalog, []) == exports.ExportResult(0, 0, path)


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_reference_counts(spark, tmp_path, catalog, rows, fmt):
    path = str(tmp_path / "out")
    usage = spark.createDataFrame(
        [("a", "d", "s", AS_OF, 3, 2), ("a", "d", "s", AS_OF - dt.timedelta(days=91), 5, 5)],
        USAGE_SCHEMA,
    )
    run = lambda projects, **more: exports.export_reference_counts(
        catalog, usage, projects, path, AS_OF, fmt=fmt, **more
    )
    assert run(["a", "b"]) == exports.ExportResult(3, 3, path)
    assert rows(read_export(spark, path, ANALYZED_SCHEMA, fmt)) == [
        ("a", "d", "s", "BASE TABLE", 3, 2),
        ("a", "d", "t", "VIEW", 0, 0),
        ("b", "d", "t", "VIEW", 0, 0),
    ]
    run(["a"], days_back=91)
    assert ("a", "d", "s", "BASE TABLE", 8, 7) in rows(read_export(spark, path, ANALYZED_SCHEMA, fmt))
    assert run([]) == exports.ExportResult(0, 0, path)
