"""Shards that all have the mixture of the whole: proportional stratified interleaving."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecensus.llm.frames import parts_for

# Rows that are sorted together; the number of such buckets grows with the table.
BUCKET_ROWS = 2_000


def _unit(*columns: Column) -> Column:
    """A hash of the columns as a number from 0 to below 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _bucket(position: Column, buckets: int) -> Column:
    return F.least(F.floor(position * buckets), F.lit(buckets - 1)).cast("bigint")


def interleaved_shards(
    docs: DataFrame,
    shards: int = 8,
    stratum: str = "source",
    key: str = "doc_id",
    seed: int = 17,
    carry: Sequence[str] = (),
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``key``, ``stratum`` and the columns in ``carry``, with ``shard`` and ``slot``.

    Rows of a stratum are shuffled by a seeded hash and ranked; rank and size of
    the stratum give a fraction, with an offset of its own for each stratum. The
    rows of all strata sorted by fraction are cut into ``shards`` runs whose
    lengths differ by one at most, so each run has every stratum in proportion.
    ``slot`` counts from 0 in each shard.

    No stratum is ranked in one task: a row's place is its rank in a bucket of
    hash values plus the number of rows in the buckets before, and buckets hold
    about ``bucket_rows`` rows whatever the size of table or stratum. The same
    way gives the place among all rows.

    A null stratum is one of its own. Null or repeated keys are rows like
    others; wholly equal rows get different places, in no defined order. An
    empty table gives no rows. Other columns of ``docs`` are not looked at.
    """
    rows = docs.count()
    buckets = parts_for(rows, bucket_rows)
    kept = F.struct(*[F.col(c) for c in dict.fromkeys([key, stratum, *carry])])
    row = docs.select(
        kept.alias("kept"), F.struct(F.col(stratum).isNull(), F.coalesce(F.col(stratum).cast("string"), F.lit(""))).alias("stratum"),
    )
    tie = F.hash(F.to_json("kept"))
    row = row.withColumn("draw", _unit(F.lit(seed), F.col(f"kept.{key}"), tie)).withColumn(
        "bucket", _bucket(F.col("draw"), buckets)
    )
    # rank in the stratum
    strata = row.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("stratum").orderBy("bucket")
    strata = strata.select(
        "stratum",
        "bucket",
        (F.sum("n").over(before) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy("stratum")).alias("size"),
    )
    here = Window.partitionBy("stratum", "bucket").orderBy("draw", f"kept.{key}", F.to_json("kept"))
    ranked = (
        row.withColumn("rank", F.row_number().over(here) - 1)
        .join(strata, ["stratum", "bucket"])
        .select(
            "kept",
            "draw",
            (
                (F.col("before") + F.col("rank") + _unit(F.lit(seed), F.col("stratum"), F.lit("offset")))
                / F.col("size")
            ).alias("fraction"),
        )
        .withColumn("bucket", _bucket(F.col("fraction"), buckets))
    )
    # place among all rows
    counts = ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(
        "bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before")
    )
    there = Window.partitionBy("bucket").orderBy("fraction", "draw", f"kept.{key}", F.to_json("kept"))
    placed = (
        ranked.withColumn("rank", F.row_number().over(there) - 1)
        .join(counts, "bucket")
        .select("kept.*", (F.col("before") + F.col("rank")).alias("place"))
    )
    # the first ``longer`` shards have one row more than the others
    each, longer = divmod(rows, shards)
    in_longer = F.col("place") < longer * (each + 1)
    rest = F.col("place") - longer * (each + 1)
    shard = F.when(in_longer, F.expr(f"place div {each + 1}")).otherwise(
        F.lit(longer) + F.floor(rest / F.lit(max(each, 1)))
    )
    placed = placed.withColumn("shard", shard.cast("int"))
    start = F.col("shard") * each + F.least(F.col("shard"), F.lit(longer))
    return placed.withColumn("slot", (F.col("place") - start).cast("bigint")).drop("place")
