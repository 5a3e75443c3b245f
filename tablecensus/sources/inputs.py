"""The input tables, read with their schema so that nothing is inferred."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecensus.schemas import (
    CATALOG_SCHEMA,
    LINKS_SCHEMA,
    OWNERS_SCHEMA,
    SKETCHES_SCHEMA,
    USAGE_SCHEMA,
)

FORMATS = ("parquet", "orc", "csv", "json", "table")


def read_input(
    spark: SparkSession, name: str, schema: T.StructType, fmt: str = "parquet"
) -> DataFrame:
    """A folder in one of ``FORMATS``, or a table of the session's catalog.

    Stored tables bring their own types; only the columns needed are read.
    """
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported format: {fmt}")
    if fmt == "table":
        return spark.table(name).select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]
        )
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    return reader.format(fmt).load(name)


def read_catalog(spark: SparkSession, name: str, fmt: str = "parquet") -> DataFrame:
    return read_input(spark, name, CATALOG_SCHEMA, fmt)


def read_usage(spark: SparkSession, name: str, fmt: str = "parquet") -> DataFrame:
    """Daily usage, best stored in one folder per ``dt`` (see ``write_daily_usage``)."""
    return read_input(spark, name, USAGE_SCHEMA, fmt)


def read_user_sketches(spark: SparkSession, name: str, fmt: str = "parquet") -> DataFrame:
    """Daily user sketches, stored like daily usage."""
    return read_input(spark, name, SKETCHES_SCHEMA, fmt)


def read_links(spark: SparkSession, name: str, fmt: str = "parquet") -> DataFrame:
    return read_input(spark, name, LINKS_SCHEMA, fmt)


def read_owners(spark: SparkSession, name: str, fmt: str = "parquet") -> DataFrame:
    return read_input(spark, name, OWNERS_SCHEMA, fmt)
