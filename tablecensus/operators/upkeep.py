"""What roots reach, kept up as links come and go, without searching the whole lineage again."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecensus.functions.ids import fqn, split_fqn
from tablecensus.operators.lineage import DEFAULT_LOCATION, edges
from tablecensus.operators.reach import STEPS_TOGETHER, follow, store_graph
from tablecensus.session import checkpoint

STEP = ["fqn", "neighbour"]


def steps_of(links: DataFrame, allowed_projects=None, location: str = DEFAULT_LOCATION) -> DataFrame:
    """The different steps of the lineage, ``fqn`` and the ``neighbour`` it feeds."""
    return edges(links, allowed_projects, location).distinct()


def steps_changed(before: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps that are new and steps that are gone, from both states in one shuffle.

    A step that is recorded several times is gone only when its last record is.
    """
    was, is_now = F.max(F.col("state") == 0), F.max(F.col("state") == 1)
    both = before.select(*STEP, F.lit(0).alias("state")).unionByName(now.select(*STEP, F.lit(1).alias("state")))
    changed = both.groupBy(*STEP).agg(was.alias("was"), is_now.alias("is_now")).where("was <> is_now")
    stored = checkpoint(changed).df
    return stored.where("is_now").select(*STEP), stored.where("was").select(*STEP)


def _closure(seeds: DataFrame, steps: DataFrame, steps_together: int) -> DataFrame:
    """``seeds`` and all that ``steps`` lead to from them."""
    graph = store_graph(steps.select(*STEP, F.lit(1).cast("bigint").alias("link_count")), steps_together)
    return follow(seeds.select(*split_fqn(F.col("fqn"))), graph).select("fqn")


def reached_after_change(
    reached: DataFrame,
    roots: DataFrame,
    steps: DataFrame,
    added: DataFrame,
    removed: DataFrame,
    steps_together: int = STEPS_TOGETHER,
) -> DataFrame:
    """The ids of all tables that ``roots`` reach by ``steps``, from those ``reached`` before the change.

    ``steps`` is the state after the change, ``added`` and ``removed`` how it differs from the one that
    ``reached`` (id columns, the roots included) was found in. First all that may have been reached by way of a removed
    step is taken out, cycles included; then what is left is followed by steps into what it
    lacks, which brings back what other ways lead to and adds what is new. Tables that are neither
    behind a removed nor behind an added step are not followed. Further roots may be given, former ones not
    left out. Roots and tables with a null part lead nowhere and are dropped; steps may repeat.
    """
    known = checkpoint(reached.select(fqn().alias("fqn")).where("fqn IS NOT NULL").distinct()).df
    start = checkpoint(roots.select(fqn().alias("fqn")).where("fqn IS NOT NULL").distinct()).df

    def column(df, name):
        return df.select(F.col("fqn").alias(name))

    cut = (
        removed.join(known, "fqn", "left_semi").select(F.col("neighbour").alias("fqn"))
        .join(known, "fqn", "left_semi").join(start, "fqn", "left_anti").distinct()
    )
    cut = checkpoint(cut)
    doubtful, kept = cut.df, known
    if cut.rows:
        inside = (
            steps.select(*STEP).unionByName(removed.select(*STEP)).distinct()
            .join(column(known, "neighbour"), "neighbour", "left_semi")
            .join(column(start, "neighbour"), "neighbour", "left_anti")
        )
        doubtful = checkpoint(_closure(cut.df, inside, steps_together)).df
        kept = checkpoint(known.join(doubtful, "fqn", "left_anti")).df
    outward = steps.select(*STEP).distinct().join(column(kept, "neighbour"), "neighbour", "left_anti")
    outward = checkpoint(outward).df
    back = outward.join(column(doubtful, "neighbour"), "neighbour", "left_semi")
    new = outward.join(added.select(*STEP).distinct(), STEP, "left_semi")
    entered = [
        *[ways.join(kept, "fqn", "left_semi").select(F.col("neighbour").alias("fqn")) for ways in (back, new)],
        start.join(kept, "fqn", "left_anti"),
    ]
    seeds = checkpoint(reduce(DataFrame.unionByName, entered).distinct())
    found = kept
    if seeds.rows:
        found = kept.unionByName(_closure(seeds.df, outward, steps_together))
    return found.select(*split_fqn(F.col("fqn")))
