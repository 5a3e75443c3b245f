"""Yes/no columns about a table, its usage and its place in the lineage."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablecensus.schemas import TABLE_TYPES


def has_known_type(table_type: str = "table_type") -> Column:
    """True or false, also for a missing type."""
    return F.coalesce(F.col(table_type).isin(TABLE_TYPES), F.lit(False))


def type_flags(table_type: str = "table_type") -> list[Column]:
    """One column per table type: ``is_base_table``, ``is_view`` and so on."""
    return [
        (F.col(table_type) == name).alias("is_" + name.lower().replace(" ", "_"))
        for name in TABLE_TYPES
    ]


def is_unused(
    job_count: str = "job_count", threshold: int = 0, strict: bool = False
) -> Column:
    """``job_count <= threshold``; only the number of jobs counts, not the users.

    A table that was not checked has no answer: null, or with ``strict`` a failure.
    """
    unused = F.col(job_count) <= threshold
    if strict:
        unused = F.coalesce(unused, F.raise_error("usage was not checked").cast("boolean"))
    return unused


def is_checked(usage_info: str = "usage_info") -> Column:
    """Usage was looked up; zero usage counts as checked."""
    return F.col(usage_info).isNotNull()


def is_candidate(deletion_info: str = "deletion_info") -> Column:
    return F.col(deletion_info).isNotNull()


def is_leaf(downstream_count: str = "downstream_count") -> Column:
    return F.col(downstream_count) == 0


def has_downstream(downstream_count: str = "downstream_count") -> Column:
    return F.col(downstream_count) > 0


def has_upstream(upstream_count: str = "upstream_count") -> Column:
    """Also the test whether a leaf depends on other tables."""
    return F.col(upstream_count) > 0
