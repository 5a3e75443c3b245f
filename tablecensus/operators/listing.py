"""Which tables exist: the catalog scan and what makes its rows unique and valid."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecensus.functions.flags import has_known_type
from tablecensus.operators.skew import collapse, expand
from tablecensus.schemas import ID_COLS, TABLE_COLS, TABLES_SCHEMA

# Fixed value: datasets for tests. `_` is the LIKE wildcard, so `testing` matches too.
TEST_DATASETS = "test_%"


def as_tables(catalog: DataFrame) -> DataFrame:
    """The catalog under the column names used everywhere else."""
    return catalog.select(
        F.col("table_catalog").alias("project_id"),
        F.col("table_schema").alias("dataset_id"),
        F.col("table_name").alias("table_id"),
        "table_type",
    )


def list_tables(
    catalog: DataFrame,
    project_ids: Sequence[str],
    excluded_datasets: Sequence[str] = (),
    on_invalid: str = "fail",
) -> DataFrame:
    """Tables of the given projects without excluded and test datasets.

    One scan whatever the number of projects; a project named twice is listed
    once. ``on_invalid`` says what an unknown table type does: ``fail`` stops
    the job as soon as such a row is read, ``keep`` passes it on (see
    :func:`split_by_type`).
    """
    if on_invalid not in ("fail", "keep"):
        raise ValueError(f"on_invalid must be 'fail' or 'keep', not {on_invalid!r}")
    if not project_ids:
        return catalog.sparkSession.createDataFrame([], TABLES_SCHEMA)
    listed = catalog.where(F.col("table_catalog").isin(sorted(set(project_ids))))
    if excluded_datasets:
        listed = listed.where(~F.col("table_schema").isin(list(excluded_datasets)))
    listed = listed.where(~F.col("table_schema").like(TEST_DATASETS))
    if on_invalid == "fail":
        # a filter, because an unused column would be pruned together with its check
        message = F.concat(
            F.lit("Unknown table type: "), F.coalesce("table_type", F.lit("NULL"))
        )
        listed = listed.where(
            has_known_type() | F.raise_error(message).cast("boolean")
        )
    return as_tables(listed)


def split_by_type(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a known table type, and the others."""
    return tables.where(has_known_type()), tables.where(~has_known_type())


def merge_listings(listings: Sequence[DataFrame]) -> DataFrame:
    """The full outer join of listings over all four columns, as two aggregations.

    A row comes out as often as the join pairs its occurrences: the product of
    how often it is in each listing that has it. Rows with a null never match, not even
    themselves, and stay as often as they came.
    """
    together = reduce(
        DataFrame.unionByName,
        [listing.select(*TABLE_COLS, F.lit(i).alias("listing")) for i, listing in enumerate(listings)],
    )
    each = collapse(together).groupBy(*TABLE_COLS).agg(F.collect_list("copies").alias("copies"))
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in TABLE_COLS])
    one, none = (F.lit(n).cast("bigint") for n in (1, 0))
    counted = each.withColumn(
        "copies",  # a number per listing
        F.when(complete, F.aggregate("copies", one, lambda n, c: n * c)).otherwise(
            F.aggregate("copies", none, lambda n, c: n + c)
        ),
    )
    return expand(counted)


def dedup_tables(tables: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """One row per table id: the first by ``order_by``, then by the other columns.

    Equal rows go first, by hashing, also before the shuffle; only distinct rows are
    sorted to find the least. (The exchange keeps Spark from dropping the distinct,
    after which every input row would be sorted.)
    """
    others = [c for c in tables.columns if c not in ID_COLS]
    ranked = [*order_by, *[c for c in others if c not in order_by]]
    return (
        tables.distinct()
        .repartition(*ID_COLS)
        .groupBy(*ID_COLS)
        .agg(F.min(F.struct(*ranked)).alias("first"))
        .select(*ID_COLS, *[F.col(f"first.{c}").alias(c) for c in others])
    )


def table_ids(
    spark: SparkSession, ids: Sequence[tuple[str, str, str]]
) -> DataFrame:
    """Table ids given by hand, such as the roots of a search."""
    schema = "struct<" + ", ".join(f"{c}: string" for c in ID_COLS) + ">"
    return spark.createDataFrame(list(ids), schema)
