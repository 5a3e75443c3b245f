"""Prefix sums along a linked list that lies in a table, too long for one task."""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecensus.llm.frames import parts_for, stored

# Elements of a range that one task walks along, and of a list that one task may rank by itself.
RANGE_ROWS = 200_000
SHORT_LIST = 200_000


def _fragments(ids: np.ndarray, follows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element the head of the fragment of the list that lies here, and its running sums there.

    ``follows`` is -1 at the end of the list. A fragment begins where the element
    before is not here, and ends where the one after is not.
    """
    order = np.argsort(ids)
    at = np.searchsorted(ids[order], follows)
    at[at == len(ids)] = 0
    here = order[at]
    to = np.where(ids[here] == follows, here, -1)
    begins = np.ones(len(ids), bool)
    begins[to[to >= 0]] = False
    walk, head = [], np.empty(len(ids), np.int64)
    after = to.tolist()
    cuts = []
    for first in np.flatnonzero(begins).tolist():
        cuts.append(len(walk))
        i = first
        while i >= 0:
            walk.append(i)
            i = after[i]
    walk = np.array(walk, np.int64)
    lengths = np.diff(np.append(cuts, len(walk)).astype(np.int64))
    total = np.cumsum(weights[walk], 0)
    starts = np.repeat(np.array(cuts, np.int64), lengths)
    before = np.where((starts > 0)[:, None], total[np.maximum(starts - 1, 0)], 0)
    sums = np.empty_like(weights)
    sums[walk] = total - before
    head[walk] = ids[walk[starts]]
    return head, sums


def _coin(element: str, turn: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(turn), element), F.lit(2)) == 1


def _spliced(links: DataFrame, sums: Sequence[str], turn: int) -> tuple[DataFrame, DataFrame]:
    """``links`` (``head, next`` and sums) without a share of their elements, and those taken out.

    A coin is tossed for each element. One that shows heads and follows one that shows tails goes:
    the one before takes over its successor and its sums. No two neighbours go at once, and about a
    quarter goes. Of those gone is kept after whom they came, and the sums of that one.
    """
    gone = links.where(_coin("head", turn)).select(
        F.col("head").alias("gone"), F.col("next").alias("gone_next"), *[F.col(s).alias(f"gone_{s}") for s in sums]
    )
    met = stored(links.join(gone, (F.col("next") == F.col("gone")) & ~_coin("head", turn), "left"), "spliced")
    taken = met.where(F.col("gone").isNotNull()).select(
        F.col("gone").alias("head"), F.col("head").alias("after"), *sums
    )
    left = met.select(
        "head",
        F.when(F.col("gone").isNotNull(), F.col("gone_next")).otherwise(F.col("next")).alias("next"),
        *[(F.col(s) + F.coalesce(f"gone_{s}", F.lit(0))).alias(s) for s in sums],
    )
    return stored(left.join(taken.select("head"), "head", "left_anti"), "list"), taken


def _ranked_here(links: DataFrame, sums: Sequence[str]) -> DataFrame:
    """``head`` and the sums before it, of a list of bounded length, walked along in one task."""

    def rank(rows: pd.DataFrame) -> pd.DataFrame:
        ids, follows = rows["head"].to_numpy(np.int64), rows["next"].fillna(-1).to_numpy(np.int64)
        weights = rows[list(sums)].to_numpy(np.int64)
        _, total = _fragments(ids, follows, weights)
        return pd.DataFrame({"head": ids, **{s: (total - weights)[:, i] for i, s in enumerate(sums)}})

    schema = ", ".join(["head bigint", *[f"{s} bigint" for s in sums]])
    return links.withColumn("list", F.lit(0)).groupBy("list").applyInPandas(rank, schema)


def sums_before(links: DataFrame, sums: Sequence[str], short: int = SHORT_LIST) -> DataFrame:
    """``head`` and the ``sums`` of all elements before it, for a list ``head, next`` and weights.

    While more than ``short`` elements are left a share of them is spliced out, a join
    each; a list of at most ``short`` is ranked by one task; then those taken
    out come back in the opposite order, each with the sums of the one it came after.
    Rounds grow with the logarithm of the length, what is moved in proportion to it.
    """
    taken, left = [], links
    while left.count() > short:
        left, gone = _spliced(left, sums, len(taken))
        taken.append(gone)
    ranked = stored(_ranked_here(left.select("head", "next", *sums), sums), "ranked")
    for gone in reversed(taken):
        known = ranked.select(F.col("head").alias("after"), *[F.col(s).alias(f"before_{s}") for s in sums])
        back = gone.join(known, "after").select("head", *[(F.col(s) + F.col(f"before_{s}")).alias(s) for s in sums])
        ranked = stored(ranked.unionByName(back), "ranked")
    return ranked


def list_sums(
    elements: DataFrame, near: Sequence[str], sums: Sequence[str], short: int = SHORT_LIST, rows: int = RANGE_ROWS
) -> DataFrame:
    """``elements`` (``id, next`` and weights ``sums``) with ``before_`` sums: all that stand before in the list.

    The list is one path through all rows; ``next`` is null at its end. Rows are sorted by
    the ``near`` columns into ranges of about ``rows``, in which a task follows the
    list as far as it stays there. If neighbours of the list are mostly near, few such
    fragments are left; if not, still no more than there are rows. The list of
    fragments is ranked by :func:`sums_before`, and what stands before a fragment
    is added to the sums within it.
    """
    parts = parts_for(elements.count(), rows)
    columns = elements.columns

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = list(batches)  # a range
        if not batches:
            return
        here = pd.concat(batches, ignore_index=True)
        ids, follows = here["id"].to_numpy(np.int64), here["next"].fillna(-1).to_numpy(np.int64)
        weights = here[list(sums)].to_numpy(np.int64)
        head, total = _fragments(ids, follows, weights)
        here["head"] = head
        for i, s in enumerate(sums):
            here[f"in_{s}"] = total[:, i]
        # the last of each fragment tells where it goes on
        here["last"] = ~np.isin(follows, ids)
        yield here[[*columns, "head", *[f"in_{s}" for s in sums], "last"]]

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in elements.schema]
    schema = ", ".join([*fields, "head bigint", *[f"in_{s} bigint" for s in sums], "last boolean"])
    within = stored(elements.repartitionByRange(parts, *near).mapInPandas(follow, schema), "fragments")
    fragments = within.where("last").select("head", "next", *[F.col(f"in_{s}").alias(s) for s in sums])
    known = sums_before(stored(fragments, "list"), sums, short)
    known = known.select("head", *[F.col(s).alias(f"start_{s}") for s in sums])
    before = [
        (F.col(f"start_{s}") + F.col(f"in_{s}") - F.col(s)).alias(f"before_{s}") for s in sums
    ]
    return within.join(known, "head").select(*columns, *before)
