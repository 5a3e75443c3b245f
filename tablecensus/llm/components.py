"""Connected components of links that lie in a table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecensus.llm.frames import stored


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``node, root`` for every end of ``links`` (columns ``a`` and ``b``): the least node it reaches.

    Large and small stars in turn: every node is linked to the least of its
    neighbours, first those above it, then those below, until nothing changes. Each
    turn keeps at most as many links as there were and is written to the shared
    folder; nothing comes to the driver but whether the links changed. A node
    with very many neighbours is found its least by partial sums, and met by its
    links in a plain join that Spark can split.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    links = links.where(F.col("a") != F.col("b")).select(high.alias("a"), low.alias("b"))
    links = stored(links.distinct(), label)

    def star(links: DataFrame, both_ways: bool) -> DataFrame:
        ways = links
        if both_ways:
            ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        joined = ways.join(stored(least, label), "a")
        if both_ways:
            # neighbours above a node to the least it knows
            new = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            # the node and its neighbours below to the least of them
            new = joined.where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
            new = new.unionByName(joined.select("a", F.col("least").alias("b")))
        return stored(new.where(F.col("a") != F.col("b")).distinct(), label)

    def state(links: DataFrame) -> tuple:
        return tuple(
            links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        )

    before = state(links)
    while before[0]:
        links = star(star(links, True), False)
        after = state(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
