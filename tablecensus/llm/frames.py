"""Reading the given tables, and writing what is needed more than once."""

import ctypes
import shutil
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecensus.llm.words import forget_powers
from tablecensus.operators.skew import BROADCAST_BYTES, ROW_OVERHEAD_BYTES
from tablecensus.session import new_folder


# Spark's setting to remove the shuffle files of a query at its end.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Spark's bound on the bytes that go to Python at once.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
# What whole texts go in where an executor is short of memory.
TEXT_BATCH_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str, batch_bytes: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, lineage cut.

    The shuffle files of the job go when it is done, as no plan can use them again. Rows of
    megabytes go to Python in batches of about ``batch_bytes``, by default Spark's 64 MB, which a
    task holds several times over.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    settings = {FREE_SHUFFLES: "true"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {name: spark.conf.get(name, "false") if name == FREE_SHUFFLES else spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return to the system what this process holds and does not use."""
    forget_powers()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def lean(rows: Callable) -> Callable:
    """A function of a task's batches that gives memory back at its end.

    A Python worker waits for the next task with all that Arrow and malloc have kept, and an executor has
    as many workers as its cores times the most such functions that one stage has run.
    """

    @wraps(rows)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from rows(batches)
        finally:
            give_back()

    return run


def small(written: DataFrame, size: Column) -> DataFrame:
    """``written`` marked to be broadcast if its rows, of ``size`` bytes each, measure few enough bytes."""
    found = written.agg(F.count(F.lit(1)).alias("rows"), F.sum(size.cast("bigint")).alias("bytes")).first()
    fits = (found.bytes or 0) + found.rows * ROW_OVERHEAD_BYTES <= BROADCAST_BYTES
    return F.broadcast(written) if fits else written


def parts_for(rows: int, rows_per_part: int) -> int:
    """How many parts of about ``rows_per_part`` rows; at least one."""
    return max(1, -(-rows // rows_per_part))


def utf8(column: str = "text"):
    """A text as UTF-8 bytes, a null one as none."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python of all executors, once per session.

    What ``--py-files`` does on submission. The archive is made in a folder of the
    driver only, from where Spark hands it out.
    """
    context = spark.sparkContext
    if getattr(context, "has_tablecensus", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp(prefix="tablecensus-")) / package.name), "zip", package.parent, package.name
    )
    context.addPyFile(archive)
    context.has_tablecensus = True


def shipped(query: Callable) -> Callable:
    """A query that ships the package first."""

    @wraps(query)
    def run(spark, *rest):
        ship_package(spark)
        return query(spark, *rest)

    return run
