"""Session settings and the shared folder for checkpoints and written results."""

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


# About how many rows a task of bounded_tasks holds, and the bytes they take in shuffles and in files.
TASK_ROWS = 500_000
TASK_BYTES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20, "spark.sql.files.maxPartitionBytes": 8 << 20}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablecensus")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would not survive the loss of an executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tablecensus-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Stored:
    """A checkpointed DataFrame and what the checkpoint's own job measured."""

    df: DataFrame
    rows: int
    key_bytes: int
    measured: dict


def checkpoint(df: DataFrame, key_columns: Sequence[str] = (), **measures: Column) -> Stored:
    """Cut the lineage of ``df``; measure its rows, key text and ``measures`` on the way.

    Sizes are exact or, should a task be run twice, too high, so a limit checked
    against them always holds.
    """
    shared_folder(df.sparkSession)
    key_bytes = sum(
        (F.coalesce(F.octet_length(c), F.lit(0)) for c in key_columns), F.lit(0)
    )
    seen = Observation()
    done = df.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.sum(key_bytes.cast("bigint")).alias("key_bytes"),
        *[measure.alias(name) for name, measure in measures.items()],
    ).checkpoint()
    found = seen.get
    return Stored(done, found["rows"], found["key_bytes"] or 0, found)


@contextmanager
def fixed_plans(
    spark: SparkSession, partitions: int | None = None, compiled: bool = True
) -> Iterator[None]:
    """Run jobs as planned, without replanning between stages, and with this number of shuffle partitions.

    What a checkpoint writes under adaptive execution has no known partitioning
    afterwards, so every join with it would shuffle it again. For jobs on few rows, whose
    plans take longer to compile than to run, ``compiled`` can be false.
    """
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": str(compiled).lower()}
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    with _set(spark, settings):
        yield


@contextmanager
def bounded_tasks(spark: SparkSession, rows: int) -> Iterator[None]:
    """Run jobs that shuffle about ``rows`` rows in tasks that hold about as many of them however many there are.

    Shuffle partitions grow with the rows, and neither they are put together
    nor files are read in larger pieces than some 500,000 narrow rows take.
    """
    fewest = int(spark.conf.get("spark.sql.shuffle.partitions"))
    settings = {"spark.sql.shuffle.partitions": str(max(fewest, -(-rows // TASK_ROWS)))}
    for name, most in TASK_BYTES.items():
        settings[name] = str(min(_bytes(spark, spark.conf.get(name)), most))
    with _set(spark, settings):
        yield


def _bytes(spark: SparkSession, size: str) -> int:
    """A size in Spark's notation, such as 64MB."""
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
