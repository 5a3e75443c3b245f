"""Column names and schemas shared by the whole package."""

from pyspark.sql import types as T

ID_COLS = ["project_id", "dataset_id", "table_id"]
TABLE_COLS = [*ID_COLS, "table_type"]

# The table types a catalog may hold.
TABLE_TYPES = [
    "BASE TABLE",
    "VIEW",
    "EXTERNAL",
    "CLONE",
    "SNAPSHOT",
    "MATERIALIZED VIEW",
]


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


ID_SCHEMA = T.StructType(_strings(*ID_COLS))

CATALOG_SCHEMA = T.StructType(
    _strings("table_catalog", "table_schema", "table_name", "table_type")
)

TABLES_SCHEMA = T.StructType(_strings(*TABLE_COLS))

USAGE_SCHEMA = T.StructType(
    [
        *_strings(*ID_COLS),
        T.StructField("dt", T.DateType()),
        T.StructField("job_count", T.LongType()),
        T.StructField("unique_user", T.LongType()),
    ]
)

SKETCHES_SCHEMA = T.StructType(
    [*_strings(*ID_COLS), T.StructField("dt", T.DateType()), T.StructField("user_sketch", T.BinaryType())]
)

LINKS_SCHEMA = T.StructType(
    _strings("link_project", "link_location", "source_fqn", "target_fqn")
)

OWNERS_SCHEMA = T.StructType(_strings(*ID_COLS, "data_owner"))

ANALYZED_SCHEMA = T.StructType(
    [
        *_strings(*TABLE_COLS),
        T.StructField("job_count", T.LongType()),
        T.StructField("unique_user", T.LongType()),
    ]
)

LEAVES_SCHEMA = T.StructType(
    [*_strings(*ID_COLS, "fqn"), T.StructField("upstream_count", T.LongType())]
)
