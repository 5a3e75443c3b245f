"""Helpers for keys that hold a large share of all rows.

Aggregates need none of this: their map-side half already turns a hot key into
one row per task. Joins on whole rows do.
"""

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecensus.session import Stored, checkpoint

# Key text up to this size may be sent to every executor.
BROADCAST_BYTES = 32 * 1024 * 1024
ROW_OVERHEAD_BYTES = 64


def fits_broadcast(stored: Stored) -> bool:
    """Whether the measured keys of ``stored`` are few enough to broadcast."""
    return stored.key_bytes + stored.rows * ROW_OVERHEAD_BYTES <= BROADCAST_BYTES


def collapse(df: DataFrame) -> DataFrame:
    """Equal rows become one row with their number in ``copies``."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))


def expand(df: DataFrame, block: int = 10_000) -> DataFrame:
    """Undo :func:`collapse`: every row as often as ``copies`` says.

    A row with more than ``block`` copies is cut into blocks that are dealt out
    over the shuffle partitions, so no task and no array has to hold them all.
    Usually that branch is empty and AQE drops it.
    """
    rows = [c for c in df.columns if c != "copies"]
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    light = df.where(F.col("copies") <= block).select(*rows, "copies")
    last = F.expr(f"(copies - 1) div {block}")
    heavy = (
        df.where(F.col("copies") > block)
        .select("*", last.alias("last_block"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), "last_block")).alias("block"))
        .repartition(partitions, *rows, "block")
        .select(
            *rows,
            F.when(F.col("block") < F.col("last_block"), F.lit(block).cast("bigint"))
            .otherwise(F.col("copies") - F.col("block") * block)
            .alias("copies"),
        )
    )
    each = F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))
    return light.unionByName(heavy).select(*rows, each.alias("copy")).drop("copy")


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], **totals: Column
) -> DataFrame:
    """Add running totals over the rows of each key in ``order``, the row itself included.

    A key may hold any share of the rows: they are sorted over all keys into ranges, one
    per shuffle partition, and added up within each range; what the ranges before
    hold of a key that goes on in the next is then added. Of these numbers there are at most two
    per range, which is what is broadcast. Rows that tie in ``order`` come in any
    order, but each once. ``df`` is computed twice, to find the ranges and to sort.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = {name: f"own_{name}" for name in totals}
    valued = df.select("*", *[column.alias(values[name]) for name, column in totals.items()])
    ranged = valued.repartitionByRange(parts, *keys, *order)
    ranged = checkpoint(ranged.withColumn("range", F.spark_partition_id())).df
    # a key goes on in a range only as its first one
    firsts = ranged.groupBy("range").agg(F.min(F.struct(*keys)).alias("key"))
    named = [F.col(f"key.{k}").alias(f"first_{i}") for i, k in enumerate(keys)]
    firsts = F.broadcast(firsts.select(*named).distinct())  # at most one per range

    def same(prefix: str) -> Column:
        each = [F.col(k).eqNullSafe(F.col(f"{prefix}_{i}")) for i, k in enumerate(keys)]
        return reduce(Column.__and__, each)

    sums = [F.sum(value).alias(value) for value in values.values()]
    parted = ranged.join(firsts, same("first"), "left_semi").groupBy("range", *keys).agg(*sums)
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = parted.select(
        F.col("range").alias("carried_range"),
        *[F.col(k).alias(f"carried_{i}") for i, k in enumerate(keys)],
        *[F.sum(value).over(before).alias(f"carried_{value}") for value in values.values()],
    )
    here = Window.partitionBy("range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = ranged.select(
        *df.columns,
        "range",
        *[F.sum(value).over(here).alias(value) for value in values.values()],
    )
    met = within.join(
        F.broadcast(carried), (F.col("range") == F.col("carried_range")) & same("carried"), "left"
    )
    return met.select(
        *df.columns,
        *[
            (F.col(value) + F.coalesce(f"carried_{value}", F.lit(0))).alias(name)
            for name, value in values.items()
        ],
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "number") -> DataFrame:
    """Add ``name``: the rows of each key in ``order`` numbered from 0 without a gap; see :func:`running`."""
    counted = running(df, keys, order, **{name: F.lit(1).cast("bigint")})
    return counted.withColumn(name, F.col(name) - 1)
