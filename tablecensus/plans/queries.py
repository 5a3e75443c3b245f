"""The registered queries: every operator over the whole derived tables."""

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecensus.functions.flags import has_upstream, type_flags
from tablecensus.functions.ids import fqn, parse_fqn, table_uri
from tablecensus.operators import lifecycle, lineage, listing, lookup, reach, upkeep, usage
from tablecensus.plans import exports
from tablecensus.schemas import (
    ANALYZED_SCHEMA,
    ID_COLS,
    LEAVES_SCHEMA,
    TABLE_COLS,
    TABLE_TYPES,
)
from tablecensus.session import bounded_tasks, new_folder
from tablecensus.sources import derived
from tablecensus.sources.inputs import read_catalog, read_links, read_usage, read_user_sketches
from tablecensus.sources.outputs import read_export, write_daily_usage
from tablecensus.streaming.daily_usage import write_exact_daily_usage_stream

CHECKED_PROJECTS = ["project-a", "project-b"]
FENCE = ["project-a", "project-b", "project-c"]


def _tables(spark, folder, projects=derived.PROJECTS) -> DataFrame:
    return listing.list_tables(
        derived.catalog(spark, folder), projects, derived.EXCLUDED
    )


def list_tables(spark: SparkSession, folder: str) -> DataFrame:
    return _tables(spark, folder, CHECKED_PROJECTS)


def list_tables_full_outer(spark: SparkSession, folder: str) -> DataFrame:
    projects = ["project-a", "project-b", "project-a"]
    return listing.merge_listings([_tables(spark, folder, [p]) for p in projects])


def list_tables_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """Listings in which rows repeat, within one and across."""
    key = F.element_at(F.split("table_id", "_"), -1).cast("bigint")
    a, both = _tables(spark, folder, ["project-a"]), _tables(spark, folder, CHECKED_PROJECTS)
    return listing.merge_listings(
        [a.unionByName(a.where(key % 3 == 0)), both.unionByName(both.where(key % 5 == 0))]
    )


def table_type_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _tables(spark, folder).select(*ID_COLS, *type_flags())


def table_type_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("k")
    doubtful = derived.keyed_catalog(spark, folder).withColumn(
        "table_type",
        F.when(k % 17 == 3, F.lower("table_type"))
        .when(k % 23 == 4, F.lit(None))
        .otherwise(F.col("table_type")),
    )
    listed = listing.list_tables(doubtful, derived.PROJECTS, on_invalid="keep")
    valid, rejected = listing.split_by_type(listed)
    return valid.withColumn("valid", F.lit(True)).unionByName(
        rejected.withColumn("valid", F.lit(False))
    )


def dedup_tables(spark: SparkSession, folder: str) -> DataFrame:
    lines = derived.read(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("k"),
        F.element_at(
            F.array(*map(F.lit, TABLE_TYPES)), (F.col("l_suppkey") % 6 + 1).cast("int")
        ).alias("table_type"),
    )
    sightings = lines.join(derived.keyed_ids(spark, folder), "k")
    return listing.dedup_tables(sightings.select(*TABLE_COLS))


def parse_table_ids(spark: SparkSession, folder: str) -> DataFrame:
    return (
        derived.links(spark, folder)
        .select(F.col("target_fqn").alias("text"), parse_fqn(F.col("target_fqn")).alias("id"))
        .select("text", "id.*")
        .select("*", fqn().alias("fqn"), table_uri().alias("uri"))
    )


def normalize_links(spark: SparkSession, folder: str) -> DataFrame:
    return lineage.split_links(lineage.judge_links(derived.links(spark, folder)))[0]


def rejected_links(spark: SparkSession, folder: str) -> DataFrame:
    return lineage.split_links(lineage.judge_links(derived.links(spark, folder)))[1]


def daily_usage_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return derived.usage(spark, folder)


def daily_usage_rollup_tokyo(spark: SparkSession, folder: str) -> DataFrame:
    events = derived.read(spark, folder, "events").select("ts", "event_type", "user_id")
    return usage.daily_usage(usage.with_report_day(events), ["event_type"])


def reference_counts(spark: SparkSession, folder: str) -> DataFrame:
    return usage.reference_counts(derived.usage(spark, folder), derived.AS_OF)


def _analyzed(spark, folder, projects=CHECKED_PROJECTS) -> DataFrame:
    return exports.analyzed_tables(
        derived.catalog(spark, folder),
        derived.usage(spark, folder),
        projects,
        derived.AS_OF,
        excluded_datasets=derived.EXCLUDED,
    )


def analyzed_tables(spark: SparkSession, folder: str) -> DataFrame:
    return _analyzed(spark, folder)


def unused_tables(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.unused_tables(_analyzed(spark, folder))


def unused_tables_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.unused_tables(_analyzed(spark, folder), threshold=5)


def unique_users_exact(spark: SparkSession, folder: str) -> DataFrame:
    return usage.unique_users_exact(derived.job_log(spark, folder), derived.AS_OF)


def unique_users_approx(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each estimate is within 5 % (three standard errors) of the exact number."""
    log = derived.job_log(spark, folder)
    approx = usage.unique_users_approx(usage.daily_user_sketches(log), derived.AS_OF)
    exact = usage.unique_users_exact(log, derived.AS_OF)
    return _compared(exact, approx)


def _compared(exact: DataFrame, approx: DataFrame) -> DataFrame:
    off = F.abs(F.col("unique_user_approx") - F.col("unique_user_exact"))
    close = off <= 0.05 * F.col("unique_user_exact") + 0.5
    return exact.join(approx, ID_COLS, "full").select(*ID_COLS, "unique_user_exact", close.alias("close"))


def _event_log(spark, folder) -> DataFrame:
    events = derived.read(spark, folder, "events").select(
        F.lit("app").alias("project_id"), F.lit("events").alias("dataset_id"), F.col("event_type").alias("table_id"), "ts", "user_id"
    )
    return usage.with_report_day(events).drop("ts")


def reference_counts_stored(spark: SparkSession, folder: str) -> DataFrame:
    """From daily usage of the events stored by day: the window reads only its days."""
    path = new_folder(spark, "usage")
    write_daily_usage(usage.daily_usage(_event_log(spark, folder)), path)
    return usage.reference_counts(read_usage(spark, path), derived.EVENTS_AS_OF, days_back=7)


def unique_users_stored(spark: SparkSession, folder: str) -> DataFrame:
    """From daily sketches of the events stored by day, beside the exact number."""
    log, path = _event_log(spark, folder), new_folder(spark, "sketches")
    write_daily_usage(usage.daily_user_sketches(log), path)
    approx = usage.unique_users_approx(read_user_sketches(spark, path), derived.EVENTS_AS_OF, 7)
    return _compared(usage.unique_users_exact(log, derived.EVENTS_AS_OF, 7), approx)


def _windows(counts: Callable) -> DataFrame:
    """What ``counts`` finds for look-backs of several lengths, also ones with a last day."""
    parts = []
    for days_back, last_day in ((90, None), (7, None), (400, None), (60, derived.AS_OF - dt.timedelta(days=30))):
        found = counts(derived.AS_OF, days_back, last_day)
        parts.append(found.withColumn("days_back", F.lit(days_back)))
    return reduce(DataFrame.unionByName, parts)


def reference_counts_any_window(spark: SparkSession, folder: str) -> DataFrame:
    """Several look-backs from running totals that are stored once: two rows per table each."""
    path = new_folder(spark, "usage-totals")
    with bounded_tasks(spark, derived.read(spark, folder, "lineitem").count()):
        usage.usage_totals(derived.usage(spark, folder)).write.parquet(path)
    totals = spark.read.parquet(path)
    return _windows(lambda *window: usage.reference_counts_from_totals(totals, *window))


def unique_users_any_window(spark: SparkSession, folder: str) -> DataFrame:
    """Several look-backs from daily bitmaps of users that are stored once in order of the days, exact."""
    log = derived.job_log(spark, folder)
    paths = [new_folder(spark, label) for label in ("users", "user-bitmaps")]
    usage.user_dictionary(log).write.parquet(paths[0])
    bitmaps = usage.daily_user_bitmaps(log, spark.read.parquet(paths[0]))
    bitmaps.repartitionByRange("dt").sortWithinPartitions("dt").write.parquet(paths[1])
    stored = spark.read.parquet(paths[1])
    return _windows(lambda *window: usage.unique_users_from_bitmaps(stored, *window))


def downstream_edges(spark: SparkSession, folder: str) -> DataFrame:
    return lineage.edges(derived.links(spark, folder), FENCE)


def upstream_edges(spark: SparkSession, folder: str) -> DataFrame:
    return lineage.edges(derived.links(spark, folder), direction="upstream")


def upstream_counts(spark: SparkSession, folder: str) -> DataFrame:
    return lineage.upstream_counts(derived.links(spark, folder))


def table_lineage(spark: SparkSession, folder: str) -> DataFrame:
    return lineage.table_lineage(
        derived.ids_of(spark, folder), derived.links(spark, folder)
    )


def table_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return lineage.neighbours(
        derived.ids_of(spark, folder), derived.links(spark, folder)
    )


def table_neighbours_looked_up(spark: SparkSession, folder: str) -> DataFrame:
    """The neighbours of all tables from links stored by their own end."""
    path = new_folder(spark, "link-index")
    lookup.write_link_index(derived.links(spark, folder), path)
    return lookup.looked_up_neighbours(derived.ids_of(spark, folder), lookup.read_link_index(spark, path))


def table_neighbour_pages(spark: SparkSession, folder: str) -> DataFrame:
    entry = lambda n: F.concat(
        n["project_id"], F.lit("."), n["dataset_id"], F.lit("."), n["table_id"],
        F.lit(" x"), n["link_count"].cast("string"),
    )
    return lineage.neighbour_pages(table_neighbours(spark, folder)).select(
        *ID_COLS,
        "direction",
        "page",
        F.concat_ws(", ", F.transform("neighbours", entry)).alias("neighbours"),
    )


def table_neighbour_pages_small(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of few entries taken apart again; an id without neighbours has an empty page."""
    ids = derived.ids_of(spark, folder)
    pages = lineage.neighbour_pages(table_neighbours(spark, folder), page_size=2, ids=ids)
    entry = F.explode_outer("neighbours").alias("entry")
    return pages.select(*ID_COLS, "direction", "page", entry).select(
        *ID_COLS,
        "direction",
        *[F.col(f"entry.{c}").alias(f"neighbour_{c}") for c in ID_COLS],
        "entry.link_count",
    ).distinct()


def table_neighbour_pages_dense(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of two entries as they are: numbered from 0, full but the last, empty where there is no neighbour."""
    ids = derived.ids_of(spark, folder)
    pages = lineage.neighbour_pages(table_neighbours(spark, folder), page_size=2, ids=ids)
    names = F.transform("neighbours", lambda n: F.concat_ws(".", *[n[c] for c in ID_COLS]))
    return pages.select(*ID_COLS, "direction", "page", F.concat_ws(", ", names).alias("neighbours"))


def leaf_tables(spark: SparkSession, folder: str) -> DataFrame:
    return lineage.leaf_tables(
        _tables(spark, folder), derived.links(spark, folder)
    )


def leaf_tables_fenced(spark: SparkSession, folder: str) -> DataFrame:
    return lineage.leaf_tables(
        _tables(spark, folder), derived.links(spark, folder), FENCE
    )


def leaf_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    return leaf_tables(spark, folder).select(
        *ID_COLS, has_upstream().alias("has_dependencies")
    )


def leaf_tables_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return lineage.leaf_tables(
        derived.job_log(spark, folder), derived.links(spark, folder)
    )


def _from_roots(spark, folder, keys, fence=None, match_sharded=False) -> DataFrame:
    found = reach.leaf_tables_from_roots(
        derived.ids_of(spark, folder, *keys),
        derived.links(spark, folder),
        fence,
        match_sharded=match_sharded,
    )
    return found.drop("depth")


def leaf_from_roots(spark: SparkSession, folder: str) -> DataFrame:
    return _from_roots(spark, folder, [0])


def leaf_from_roots_fenced(spark: SparkSession, folder: str) -> DataFrame:
    return _from_roots(spark, folder, [1, 2], FENCE)


def leaf_from_roots_normalized(spark: SparkSession, folder: str) -> DataFrame:
    return _from_roots(spark, folder, [0], match_sharded=True)


def leaf_from_roots_hub(spark: SparkSession, folder: str) -> DataFrame:
    """A graph in which one table feeds a third of all others, split over several tasks."""
    hub = derived.ids_of(spark, folder, 0).select(*[F.col(c).alias(f"hub_{c}") for c in ID_COLS])
    fed = derived.keyed_ids(spark, folder).where("k % 3 = 1").join(F.broadcast(hub))  # one row
    uri = lambda prefix: F.concat_ws(".", *[f"{prefix}{c}" for c in ID_COLS])
    more = fed.select(
        F.col("hub_project_id").alias("link_project"),
        F.lit("us").alias("link_location"),
        F.concat(F.lit("bigquery:"), uri("hub_")).alias("source_fqn"),
        F.concat(F.lit("bigquery:"), uri("")).alias("target_fqn"),
    )
    links = derived.links(spark, folder).unionByName(more)
    roots = derived.ids_of(spark, folder, 0)
    return reach.leaf_tables_from_roots(roots, links, steps_together=50).drop("depth")


def reachable_tables(spark: SparkSession, folder: str) -> DataFrame:
    return reach.reachable_tables(
        derived.ids_of(spark, folder, 0), derived.links(spark, folder)
    )


def reachable_after_change(spark: SparkSession, folder: str) -> DataFrame:
    """What the first table reaches once steps into every 40th table are gone and it feeds half of these itself."""
    root = derived.ids_of(spark, folder, 0)
    before = upkeep.steps_of(derived.links(spark, folder))
    number = F.element_at(F.split("neighbour", "_"), -1).cast("bigint")
    fed = derived.ids_of(spark, folder).select(fqn().alias("neighbour")).where(number % 80 == 3)
    source = root.select(fqn().alias("fqn"))
    now = before.where(number % 40 != 3).unionByName(fed.join(F.broadcast(source)))  # one row
    reached = reach.reachable_tables(root, derived.links(spark, folder))
    return upkeep.reached_after_change(reached, root, now, *upkeep.steps_changed(before, now))


def _checked(spark, folder) -> DataFrame:
    listed = _tables(spark, folder, CHECKED_PROJECTS)
    counts = usage.reference_counts(derived.usage(spark, folder), derived.AS_OF)
    return usage.counts_of(listed, counts)


def daily_usage_streamed(spark: SparkSession, folder: str) -> DataFrame:
    """All events, dealt by user over up to four batches, so that each batch corrects days of those before."""
    source, out, users, checkpoint = [new_folder(spark, f"stream-{part}") for part in ("in", "out", "users", "state")]
    events = derived.read(spark, folder, "events")
    events.repartition(4, "user_id").write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = write_exact_daily_usage_stream(stream, out, users, checkpoint, keys=["event_type"])
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("dt", "event_type", "job_count", "unique_user")


def lifecycle_report(spark: SparkSession, folder: str) -> DataFrame:
    known = lifecycle.with_info(
        lifecycle.discovered(_tables(spark, folder)),
        counts=_checked(spark, folder),
        owners=derived.owners(spark, folder),
    )
    return lifecycle.lifecycle_report(known)


def lifecycle_history(spark: SparkSession, folder: str) -> DataFrame:
    """Three snapshots: found, checked, with owners; clones are away in the second, views in the third."""
    found = lifecycle.discovered(_tables(spark, folder))
    checked = lifecycle.with_usage_info(found.where("table.table_type <> 'CLONE'"), _checked(spark, folder))
    owned = lifecycle.with_info(
        found.where("table.table_type <> 'VIEW'"),
        counts=_checked(spark, folder),
        owners=derived.owners(spark, folder),
    )
    history = None
    for month, known in ((6, found), (7, checked), (8, owned)):
        report = lifecycle.lifecycle_report(known)
        path = new_folder(spark, "history")
        lifecycle.extend_history(report, dt.date(2001, month, 1), history).write.parquet(path)
        history = spark.read.parquet(path)
    return history


def flattened_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    checked = lifecycle.with_usage_info(
        lifecycle.discovered(_tables(spark, folder)), _checked(spark, folder)
    )
    return lifecycle.flatten_analyzed(checked)


def unused_leaf_tables(spark: SparkSession, folder: str) -> DataFrame:
    links = lineage.of_projects(derived.links(spark, folder), CHECKED_PROJECTS)
    return lifecycle.unused_leaves(_analyzed(spark, folder), links)


def usage_summary(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.usage_summary(_analyzed(spark, folder, derived.PROJECTS))


def usage_summary_levels(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.usage_summary_levels(_analyzed(spark, folder, derived.PROJECTS))


def _export_counts(spark, folder, fmt) -> exports.ExportResult:
    return exports.export_reference_counts(
        derived.catalog(spark, folder),
        derived.usage(spark, folder),
        CHECKED_PROJECTS,
        new_folder(spark, "reference-counts"),
        derived.AS_OF,
        fmt=fmt,
        excluded_datasets=derived.EXCLUDED,
    )


def _export_project_leaves(spark, folder, fmt) -> exports.ExportResult:
    return exports.export_leaf_tables(
        derived.links(spark, folder),
        new_folder(spark, "leaves"),
        catalog=derived.catalog(spark, folder),
        project_ids=CHECKED_PROJECTS,
        allowed_projects=FENCE,
        fmt=fmt,
        excluded_datasets=derived.EXCLUDED,
    )


def _export_root_leaves(spark, folder, fmt) -> exports.ExportResult:
    return exports.export_leaf_tables(
        derived.links(spark, folder),
        new_folder(spark, "leaves"),
        roots=derived.ids_of(spark, folder, 1, 2),
        allowed_projects=FENCE,
        fmt=fmt,
    )


def export_roundtrip_csv(spark: SparkSession, folder: str) -> DataFrame:
    done = _export_counts(spark, folder, "csv")
    return read_export(spark, done.path, ANALYZED_SCHEMA, "csv")


def export_roundtrip_json(spark: SparkSession, folder: str) -> DataFrame:
    done = _export_counts(spark, folder, "json")
    return read_export(spark, done.path, ANALYZED_SCHEMA, "json")


def export_project_leaves_csv(spark: SparkSession, folder: str) -> DataFrame:
    done = _export_project_leaves(spark, folder, "csv")
    return read_export(spark, done.path, LEAVES_SCHEMA, "csv")


def export_root_leaves_json(spark: SparkSession, folder: str) -> DataFrame:
    done = _export_root_leaves(spark, folder, "json")
    return read_export(spark, done.path, LEAVES_SCHEMA, "json")


def export_totals(spark: SparkSession, folder: str) -> DataFrame:
    done = {
        "reference_counts": _export_counts(spark, folder, "csv"),
        "project_leaves": _export_project_leaves(spark, folder, "csv"),
        "root_leaves": _export_root_leaves(spark, folder, "csv"),
    }
    return spark.createDataFrame(
        [(name, r.total_tables, r.exported_tables) for name, r in done.items()],
        "export string, total_tables bigint, exported_tables bigint",
    )


def export_stored_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """The three exports from inputs written and read again, the links by project."""
    path = new_folder(spark, "inputs")
    derived.catalog(spark, folder).write.parquet(f"{path}/catalog")
    derived.links(spark, folder).write.partitionBy("link_project").parquet(f"{path}/links")
    derived.usage(spark, folder).write.parquet(f"{path}/usage")
    catalog, links = read_catalog(spark, f"{path}/catalog"), read_links(spark, f"{path}/links")
    counts = exports.export_reference_counts(
        catalog, read_usage(spark, f"{path}/usage"), CHECKED_PROJECTS, f"{path}/counts",
        derived.AS_OF, excluded_datasets=derived.EXCLUDED,
    )
    project = exports.export_leaf_tables(
        links, f"{path}/leaves", catalog=catalog, project_ids=CHECKED_PROJECTS,
        allowed_projects=FENCE, excluded_datasets=derived.EXCLUDED, fmt="json",
    )
    root = exports.export_leaf_tables(
        links, f"{path}/root-leaves", roots=derived.ids_of(spark, folder, 1, 2), allowed_projects=FENCE
    )
    analyzed = read_export(spark, counts.path, ANALYZED_SCHEMA)
    parts = [analyzed.select(F.lit("counts").alias("export"), *ID_COLS, F.col("job_count").alias("number"))]
    for name, done, fmt in (("project", project, "json"), ("root", root, "csv")):
        leaves = read_export(spark, done.path, LEAVES_SCHEMA, fmt)
        parts.append(leaves.select(F.lit(name).alias("export"), *ID_COLS, F.col("upstream_count").alias("number")))
    return reduce(DataFrame.unionByName, parts)


def export_overwritten(spark: SparkSession, folder: str) -> DataFrame:
    """A smaller result over a larger one, and an empty result that leaves no rows behind."""
    path, empty = new_folder(spark, "leaves"), new_folder(spark, "leaves")
    catalog, links = derived.catalog(spark, folder), derived.links(spark, folder)
    for projects, to in ((derived.PROJECTS, path), (CHECKED_PROJECTS, path), (CHECKED_PROJECTS, empty), ([], empty)):
        exports.export_leaf_tables(
            links, to, catalog=catalog, project_ids=projects, excluded_datasets=derived.EXCLUDED
        )
    both = [read_export(spark, p, LEAVES_SCHEMA) for p in (path, empty)]
    return both[0].unionByName(both[1])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        list_tables,
        list_tables_full_outer,
        list_tables_repeated,
        table_type_flags,
        table_type_quarantine,
        dedup_tables,
        parse_table_ids,
        normalize_links,
        rejected_links,
        daily_usage_rollup,
        daily_usage_rollup_tokyo,
        daily_usage_streamed,
        reference_counts,
        reference_counts_stored,
        unique_users_stored,
        reference_counts_any_window,
        unique_users_any_window,
        analyzed_tables,
        unused_tables,
        unused_tables_threshold,
        unique_users_exact,
        unique_users_approx,
        downstream_edges,
        upstream_edges,
        upstream_counts,
        table_lineage,
        table_neighbours,
        table_neighbours_looked_up,
        table_neighbour_pages,
        table_neighbour_pages_small,
        table_neighbour_pages_dense,
        leaf_tables,
        leaf_tables_fenced,
        leaf_dependencies,
        leaf_tables_duplicates,
        leaf_from_roots,
        leaf_from_roots_fenced,
        leaf_from_roots_normalized,
        leaf_from_roots_hub,
        reachable_tables,
        reachable_after_change,
        lifecycle_report,
        lifecycle_history,
        flattened_lifecycle,
        unused_leaf_tables,
        usage_summary,
        usage_summary_levels,
        export_roundtrip_csv,
        export_roundtrip_json,
        export_project_leaves_csv,
        export_root_leaves_json,
        export_totals,
        export_stored_inputs,
        export_overwritten,
    )
}
