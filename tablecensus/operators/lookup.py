"""Links stored by their own end, so that few looked-up tables read few of them."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecensus.functions.ids import fqn, split_fqn
from tablecensus.operators.lineage import DEFAULT_LOCATION, FAR_COLS, link_ends
from tablecensus.schemas import ID_COLS


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("fqn"), F.lit(parts)).cast("int")


def write_link_index(
    links: DataFrame,
    path: str,
    parts: int = 256,
    location: str = DEFAULT_LOCATION,
    match_sharded: bool = False,
) -> None:
    """Store how often each table is linked with each neighbour, in ``parts`` folders by a hash of the table.

    Rows are sorted into ranges of folder, table and neighbour, so a table with a large share of
    the links is written by several tasks, and within a folder files and row groups hold few
    tables each. ``parts`` is stored as a folder, too, so readers need not know it. No links give no rows.
    """
    counted = (
        link_ends(links, None, location, match_sharded)
        .groupBy("direction", "fqn", "neighbour")
        .agg(F.count(F.lit(1)).alias("link_count"))
        .withColumn("parts", F.lit(parts))
        .withColumn("part", _part(parts))
    )
    order = ["part", "fqn", "direction", "neighbour"]
    (
        counted.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.partitionBy("parts", "part")
        .mode("overwrite")
        .parquet(path)
    )


def read_link_index(spark: SparkSession, path: str) -> DataFrame:
    schema = "direction string, fqn string, neighbour string, link_count bigint, parts int, part int"
    return spark.read.schema(schema).parquet(path)


def looked_up_neighbours(ids: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of :func:`tablecensus.operators.lineage.neighbours`, from a stored index.

    Only folders that one of the ids falls into are read, and of these only row groups that
    reach into the range of the ids. What the driver gets for that are numbers of folders, at
    most as many as there are, and two ids. Ids are met in a plain join, which
    Spark broadcasts if they are few; ``ids`` is computed twice. Repeated ids count
    once, ids with a null part find nothing, no ids read nothing.
    """
    stored = index.select("parts").first()
    wanted = ids.select(fqn().alias("fqn")).where(F.col("fqn").isNotNull()).distinct()
    parts = _part(stored.parts if stored else 1)
    met = wanted.agg(
        F.collect_set(parts).alias("parts"), F.min("fqn").alias("least"), F.max("fqn").alias("most")
    ).first()
    near = F.col("part").isin(met.parts) & F.col("fqn").between(met.least, met.most) if met.parts else F.lit(False)
    return index.where(near).join(wanted, "fqn", "left_semi").select(
        *split_fqn(F.col("fqn")),
        "direction",
        *[c.alias(f) for c, f in zip(split_fqn(F.col("neighbour")), FAR_COLS)],
        "link_count",
    )
