"""The three exports: leaves of projects, leaves from roots, reference counts."""

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tablecensus.operators.lineage import DEFAULT_LOCATION, leaf_tables, of_projects
from tablecensus.operators.listing import list_tables
from tablecensus.operators.reach import leaf_tables_from_roots
from tablecensus.operators.usage import (
    DEFAULT_DAYS_BACK,
    attach_usage,
    reference_counts,
)
from tablecensus.schemas import ID_COLS
from tablecensus.session import checkpoint
from tablecensus.sources.outputs import (
    check_format,
    write_analyzed_tables,
    write_leaf_tables,
)


@dataclass(frozen=True)
class ExportResult:
    """Tables looked at, rows written, and where."""

    total_tables: int
    exported_tables: int
    path: str


def export_leaf_tables(
    links: DataFrame,
    path: str,
    catalog: DataFrame | None = None,
    project_ids: Sequence[str] | None = None,
    roots: DataFrame | None = None,
    allowed_projects: Sequence[str] | None = None,
    fmt: str = "csv",
    excluded_datasets: Sequence[str] = (),
    location: str = DEFAULT_LOCATION,
    match_sharded: bool = False,
) -> ExportResult:
    """Write the leaves among all tables of projects, or those reached from roots.

    Exactly one of ``project_ids`` and ``roots`` must be given; an empty list of
    projects counts as given. The total is the number of listed tables or of
    roots, repeated ones included.
    """
    if (project_ids is None) == (roots is None):
        raise ValueError("give either project_ids or roots, not both")
    if project_ids is not None and catalog is None:
        raise ValueError("project_ids needs a catalog")
    check_format(fmt)
    # stored once: what is counted is what is searched, also if the inputs change meanwhile
    if roots is not None:
        looked_at = checkpoint(roots.select(*ID_COLS))
        leaves = leaf_tables_from_roots(
            looked_at.df, links, allowed_projects, location, match_sharded
        )
    else:
        looked_at = checkpoint(list_tables(catalog, project_ids, excluded_datasets))
        links = of_projects(links, project_ids)
        leaves = leaf_tables(looked_at.df, links, allowed_projects, location, match_sharded)
    return ExportResult(looked_at.df.count(), write_leaf_tables(leaves, path, fmt), path)


def analyzed_tables(
    catalog: DataFrame,
    usage: DataFrame,
    project_ids: Sequence[str],
    as_of: dt.date | None = None,
    days_back: int = DEFAULT_DAYS_BACK,
    excluded_datasets: Sequence[str] = (),
) -> DataFrame:
    """Tables of the given projects with their counts over the look-back window."""
    tables = list_tables(catalog, project_ids, excluded_datasets)
    return attach_usage(tables, reference_counts(usage, as_of, days_back))


def export_reference_counts(
    catalog: DataFrame,
    usage: DataFrame,
    project_ids: Sequence[str],
    path: str,
    as_of: dt.date | None = None,
    days_back: int = DEFAULT_DAYS_BACK,
    fmt: str = "csv",
    excluded_datasets: Sequence[str] = (),
) -> ExportResult:
    """Write every listed table with its counts."""
    check_format(fmt)
    analyzed = analyzed_tables(
        catalog, usage, project_ids, as_of, days_back, excluded_datasets
    )
    rows = write_analyzed_tables(analyzed, path, fmt)
    return ExportResult(rows, rows, path)
