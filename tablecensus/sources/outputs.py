"""Results as folders of part files, written by the tasks that computed them."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecensus.schemas import ANALYZED_SCHEMA, LEAVES_SCHEMA

# The formats a result can be exported in.
EXPORT_FORMATS = ("csv", "json")


def check_format(fmt: str) -> None:
    if fmt not in EXPORT_FORMATS:
        raise ValueError(f"Unsupported format: {fmt}")


def export(df: DataFrame, path: str, fmt: str = "csv") -> int:
    """Write ``df`` over whatever is at ``path``; returns the number of rows written.

    CSV has a header and keeps spaces; JSON has one record per line and keeps
    nulls. An empty result is written too. The rows are counted by the write
    itself, in its last stage, where a retried task counts once.
    """
    check_format(fmt)
    written = Observation()
    writer = df.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    if fmt == "csv":
        writer.options(
            header=True,
            escape='"',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        ).csv(path)
    else:
        writer.option("ignoreNullFields", False).json(path)
    return written.get["rows"] or 0


def read_export(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv"
) -> DataFrame:
    """What :func:`export` wrote."""
    check_format(fmt)
    if fmt == "csv":
        return (
            spark.read.schema(schema)
            .options(
                header=True,
                escape='"',
                ignoreLeadingWhiteSpace=False,
                ignoreTrailingWhiteSpace=False,
            )
            .csv(path)
        )
    return spark.read.schema(schema).json(path)


def write_analyzed_tables(df: DataFrame, path: str, fmt: str = "csv") -> int:
    return export(df.select(*ANALYZED_SCHEMA.names), path, fmt)


def write_leaf_tables(df: DataFrame, path: str, fmt: str = "csv") -> int:
    return export(df.select(*LEAVES_SCHEMA.names), path, fmt)


def write_daily_usage(daily: DataFrame, path: str) -> None:
    """Store daily usage (or sketches) in one folder per day.

    Only the days present in ``daily`` are replaced, so a run over yesterday's
    log leaves the history alone. Rows are gathered by day to keep the number
    of files low; AQE splits days too large for one task.
    """
    (
        daily.hint("rebalance", F.col("dt"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dt")
        .parquet(path)
    )
