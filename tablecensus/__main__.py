"""The exports as a job: ``spark-submit --py-files tablecensus.zip tablecensus/__main__.py leaves ...``.

Inputs are folders, or tables with ``--format table``. On a cluster set
``spark.checkpoint.dir`` to a folder all executors share.
"""

import argparse
import datetime as dt
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from tablecensus.operators.lineage import DEFAULT_LOCATION
from tablecensus.operators.listing import table_ids
from tablecensus.operators.usage import DEFAULT_DAYS_BACK
from tablecensus.plans.exports import (
    ExportResult,
    export_leaf_tables,
    export_reference_counts,
)
from tablecensus.sources.inputs import FORMATS, read_catalog, read_links, read_usage
from tablecensus.sources.outputs import EXPORT_FORMATS


def _root(text: str) -> tuple[str, str, str]:
    parts = tuple(text.rsplit(".", 2))
    if len(parts) != 3 or not all(parts):
        raise argparse.ArgumentTypeError(f"not project.dataset.table: {text}")
    return parts


def arguments(given: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tablecensus", description="Exports of table usage and lineage")
    jobs = parser.add_subparsers(dest="job", required=True)
    leaves = jobs.add_parser("leaves", help="leaf tables of projects, or reached from roots")
    counts = jobs.add_parser("counts", help="tables with their reference counts")
    for job in (leaves, counts):
        job.add_argument("--out", required=True, help="folder of the result, overwritten")
        job.add_argument("--out-format", default="csv", choices=EXPORT_FORMATS)
        job.add_argument("--format", default="parquet", choices=FORMATS, help="of the inputs")
        job.add_argument("--exclude", nargs="*", default=[], metavar="DATASET")
    leaves.add_argument("--links", required=True)
    leaves.add_argument("--catalog", help="needed with --projects")
    which = leaves.add_mutually_exclusive_group(required=True)
    which.add_argument("--projects", nargs="+")
    which.add_argument("--roots", nargs="+", type=_root, metavar="PROJECT.DATASET.TABLE")
    leaves.add_argument("--allowed-projects", nargs="*", help="fence of the search")
    leaves.add_argument("--location", default=DEFAULT_LOCATION)
    leaves.add_argument("--match-sharded", action="store_true")
    counts.add_argument("--catalog", required=True)
    counts.add_argument("--usage", required=True)
    counts.add_argument("--projects", nargs="+", required=True)
    counts.add_argument("--days-back", type=int, default=DEFAULT_DAYS_BACK)
    counts.add_argument("--as-of", type=dt.date.fromisoformat, help="default: today in the reporting zone")
    found = parser.parse_args(given)
    if found.job == "leaves" and found.projects and not found.catalog:
        parser.error("--projects needs --catalog")
    return found


def run(spark: SparkSession, given: Sequence[str] | None = None) -> ExportResult:
    """Do what the arguments say; prints and returns the totals."""
    args = arguments(given)
    if args.job == "counts":
        done = export_reference_counts(
            read_catalog(spark, args.catalog, args.format), read_usage(spark, args.usage, args.format),
            args.projects, args.out, args.as_of, args.days_back, args.out_format, args.exclude,
        )
    else:
        done = export_leaf_tables(
            read_links(spark, args.links, args.format),
            args.out,
            catalog=read_catalog(spark, args.catalog, args.format) if args.projects else None,
            project_ids=args.projects,
            roots=table_ids(spark, args.roots) if args.roots else None,
            allowed_projects=args.allowed_projects,
            fmt=args.out_format,
            excluded_datasets=args.exclude,
            location=args.location,
            match_sharded=args.match_sharded,
        )
    print(f"{done.total_tables} tables, {done.exported_tables} written to {done.path}")
    return done


if __name__ == "__main__":
    session = SparkSession.builder.appName("tablecensus").getOrCreate()
    run(session, sys.argv[1:])
    session.stop()
