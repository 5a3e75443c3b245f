"""Catalog, job log, usage, links and owners derived from the TPC-H-like tables.

``part`` plays the catalog, ``lineitem`` the job log, and a binary tree over the
part keys the lineage, with repeated links, self-links, cycles, ends that name
no table, sharded ends, a second location and links recorded twice.
"""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecensus.operators.usage import daily_usage
from tablecensus.schemas import CATALOG_SCHEMA, ID_COLS

AS_OF = dt.date(2001, 8, 1)
EVENTS_AS_OF = dt.date(2024, 1, 30)
EXCLUDED = ["audit_log"]
PROJECTS = ["project-a", "project-b", "project-c", "project-d", "project-e"]

# Columns read of each given table; stating them saves a look into the files.
COLUMNS = {
    "part": "p_partkey bigint, p_type string, p_size int",
    "lineitem": "l_partkey bigint, l_suppkey bigint, l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string",
    "events": "ts timestamp_ntz, user_id bigint, event_type string",
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{folder}/{name}.parquet")


def keyed_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog and the part key ``k`` behind each table."""
    return read(spark, folder, "part").selectExpr(
        "p_partkey AS k",
        "concat('project-', substr('abcde', CAST(p_partkey % 5 AS INT) + 1, 1)) AS table_catalog",
        "CASE p_type WHEN 'PROMO' THEN 'test_promo' WHEN 'SMALL' THEN 'testing'"
        " WHEN 'LARGE' THEN 'audit_log' WHEN 'MEDIUM' THEN 'test'"
        " ELSE lower(p_type) END AS table_schema",
        "concat('part_', CAST(p_partkey AS STRING)) AS table_name",
        "CASE p_size % 6 WHEN 0 THEN 'BASE TABLE' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'EXTERNAL'"
        " WHEN 3 THEN 'CLONE' WHEN 4 THEN 'SNAPSHOT' ELSE 'MATERIALIZED VIEW' END AS table_type",
    )


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    return keyed_catalog(spark, folder).drop("k")


def keyed_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Part key and table id."""
    return keyed_catalog(spark, folder).selectExpr(
        "k", *[f"{c} AS {i}" for c, i in zip(CATALOG_SCHEMA.names, ID_COLS)]
    )


def ids_of(spark: SparkSession, folder: str, *keys: int) -> DataFrame:
    """The ids of the tables with the given part keys, of all without keys."""
    tables = keyed_ids(spark, folder)
    if keys:
        tables = tables.where(F.col("k").isin(list(keys)))
    return tables.select(*ID_COLS)


def job_log(spark: SparkSession, folder: str) -> DataFrame:
    jobs = read(spark, folder, "lineitem").selectExpr(
        "l_partkey AS k", "l_suppkey AS user_id", "to_date(l_shipdate) AS dt"
    )
    return jobs.join(keyed_ids(spark, folder), "k").select(*ID_COLS, "user_id", "dt")


def usage(spark: SparkSession, folder: str) -> DataFrame:
    return daily_usage(job_log(spark, folder))


def owners(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = read(spark, folder, "supplier").selectExpr(
        "s_suppkey AS k", "s_name AS data_owner"
    )
    tables = keyed_ids(spark, folder).where("k % 3 = 0")
    return tables.join(suppliers, "k").select(*ID_COLS, "data_owner")


def links(spark: SparkSession, folder: str) -> DataFrame:
    """Each table with its parent, and from that pair all links of the table.

    One end of every link is the table itself, so one join finds both ends.
    """
    me = keyed_ids(spark, folder).selectExpr(
        "k",
        "project_id AS p",
        "concat(project_id, '.', dataset_id, '.', table_id) AS f",
        "IF(k >= 1, (k - 1) div 2, NULL) AS parent_k",
    )
    parents = me.selectExpr("k AS parent_k", "p AS parent_p", "f AS parent_f")
    own, parent = "k, p, f", "parent_k, parent_p, parent_f"
    kinds = [
        # kind, source, target, condition on the table
        ("tree", parent, own, "parent_f IS NOT NULL"),
        ("tree", parent, own, "parent_f IS NOT NULL AND k % 7 = 0"),
        ("self", own, own, "k % 97 = 5"),
        ("back", own, parent, "parent_f IS NOT NULL AND k % 101 = 50"),
        ("ext", own, own, "k % 13 = 1"),
        ("extsrc", own, own, "k % 19 = 2"),
    ]
    ends = "kind string, sk bigint, sp string, sf string, tk bigint, tp string, tf string"
    struct_type = "struct<" + ends.replace(" ", ": ").replace(",:", ",") + ">"
    each_kind = ", ".join(
        f"IF({when}, CAST(struct('{kind}', {source}, {target}) AS {struct_type}), NULL)"
        for kind, source, target, when in kinds
    )
    return (
        me.join(parents, "parent_k", "left")
        .selectExpr(f"inline(array_compact(array({each_kind})))")
        .selectExpr(
            "sp",
            "tp",
            "tk",
            "CASE WHEN kind = 'extsrc' THEN 'spanner:inst.db.s'"
            " WHEN sk % 17 = 16 THEN concat('bigquery:sharded:', sf)"
            " ELSE concat('bigquery:', sf) END AS source_fqn",
            "CASE WHEN kind = 'ext' AND tk % 3 = 0 THEN 'spanner:inst.db.t'"
            " WHEN kind = 'ext' AND tk % 3 = 1 THEN 'bigquery:p.d'"
            " WHEN kind = 'ext' THEN 'bigquery:x.com:p.d.t.c'"
            " WHEN tk % 11 = 0 THEN concat('bigquery:sharded:', tf)"
            " ELSE concat('bigquery:', tf) END AS target_fqn",
            "IF(tk % 29 = 28, 'eu', 'us') AS link_location",
        )
        .selectExpr(
            "inline(array_compact(array("
            "struct(sp AS link_project, link_location, source_fqn, target_fqn),"
            "IF(tp <> sp AND tk % 10 <> 0,"
            " struct(tp AS link_project, link_location, source_fqn, target_fqn), NULL))))"
        )
    )
