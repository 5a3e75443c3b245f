import pytest
from pyspark.sql import functions as F

from tablecensus.functions import ids as I
from tablecensus.schemas import ID_COLS


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "text string")


def parsed(df, column):
    return [r[0] and tuple(r[0]) for r in df.select(column).collect()]


def test_fqn_and_uri(ids):
    row = ids("p.d.t").select(I.fqn().alias("fqn"), I.table_uri().alias("uri")).first()
    assert (row.fqn, row.uri) == ("p.d.t", "bigquery:p.d.t")


def test_fqn_of_incomplete_id_is_null(spark):
    df = spark.createDataFrame([("p", None, "t")], ", ".join(f"{c} string" for c in ID_COLS))
    assert df.select(I.fqn()).first()[0] is None


def test_parse_fqn(spark):
    df = texts(spark, "p.d.t", "p.d", "p.d.t.c", "", "a..b", "bigquery:p.d.t", None)
    assert parsed(df, I.parse_fqn(F.col("text"))) == [
        ("p", "d", "t"), None, None, None, ("a", "", "b"), ("bigquery:p", "d", "t"), None,
    ]


def test_parse_fqn_strict(spark):
    strict = I.parse_fqn_strict(F.col("text"))
    assert parsed(texts(spark, "p.d.t"), strict) == [("p", "d", "t")]
    with pytest.raises(Exception, match="Invalid table id 'p.d'"):
        texts(spark, "p.d.t", "p.d").select(strict).collect()


def test_parse_uri(spark):
    cases = {
        "bigquery:project-a.dataset.table": ("project-a", "dataset", "table"),
        "bigquery:sharded:project-a.dataset.table": ("project-a", "dataset", "table"),
        "bigquery:sharded:sharded:p.d.t": ("sharded:p", "d", "t"),
        "bigquery:a..b": ("a", "", "b"),
        "bigquery:..": ("", "", ""),
        "spanner:project.instance.database": None,
        "BIGQUERY:p.d.t": None,
        "bigquery:project.dataset": None,
        "bigquery:x.com:p.d.t": None,
        "bigquery:p.d.t.c": None,
        "bigquery:": None,
        "": None,
        None: None,
    }
    df = texts(spark, *cases)
    assert parsed(df, I.parse_uri(F.col("text"))) == list(cases.values())


def test_own_path_allows_dots_in_the_project(spark):
    df = spark.createDataFrame(
        [
            ("p.d.t", "p"),
            ("x.com:p.d.t", "x.com:p"),
            ("p.d.t", "q"),
            ("pp.d.t", "p"),
            ("p.d", "p"),
            ("p.d.t.c", "p"),
            ("sharded:p.d.t", "p"),
            ("p.d.t", None),
        ],
        "path string, project string",
    )
    path = F.col("path")
    kept = df.where(I.is_own_path(path, F.col("project"))).select(*I.split_fqn(path))
    assert [tuple(r) for r in kept.collect()] == [("p", "d", "t"), ("x.com:p", "d", "t")]


def test_split_fqn(spark):
    df = texts(spark, "p.d.t", "x.com:p.d.t", "a..b", "..")
    assert [tuple(r) for r in df.select(*I.split_fqn(F.col("text"))).collect()] == [
        ("p", "d", "t"), ("x.com:p", "d", "t"), ("a", "", "b"), ("", "", ""),
    ]


def test_uri_path(spark):
    df = texts(spark, "bigquery:p.d.t", "bigquery:sharded:p.d.t", "bigquery:")
    uri = F.col("text")
    assert [r[0] for r in df.select(I.uri_path(uri)).collect()] == ["p.d.t", "p.d.t", ""]
    assert [r[0] for r in df.select(I.uri_path(uri, drop_sharded=False)).collect()] == [
        "p.d.t", "sharded:p.d.t", "",
    ]


def test_reject_reason(spark):
    df = texts(spark, "bigquery:p.d.t", "bigquery:p.d", "spanner:a.b.c", None)
    reasons = [r[0] for r in df.select(I.uri_reject_reason(F.col("text"))).collect()]
    assert reasons == [None, "not_three_parts", "other_system", "missing"]
