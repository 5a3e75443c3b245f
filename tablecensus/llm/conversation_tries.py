"""The trie of conversations: what their beginnings share, summed over subtrees by an Euler tour."""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecensus.llm.frames import stored
from tablecensus.llm.list_ranking import SHORT_LIST, list_sums
from tablecensus.operators.skew import numbered, running

# Conversations of one block of ids share the beginning of its first; of how many turns is a checksum's remainder.
BLOCK, MOST_SHARED = 5, 9
# Ids of conversations that are written in one piece.
PIECE = 4_096
LANES = ("lane_a", "lane_b")


def turn_prints(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, print, bytes``: a SHA-256 of role and text, and the length of the text, for every turn.

    Null roles and texts are empty ones. Turns without a ``conv_id`` belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.sha2(whole, 256).alias("print"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )


def rebuilt_turns(prints: DataFrame, block: int = BLOCK, most: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """``conv_id, position, print, bytes`` of all rebuilt conversations, and ``conv_id, length`` of each, stored.

    Of a conversation c the first h turns are those of conversation c - c % ``block`` (all if it has
    fewer, none if there is none), where h is the checksum of c modulo ``most``; its own turns follow after its first h.
    Turns are ordered by ``turn`` (null first), then by their content.
    """
    order = stored(numbered(prints, ["conv_id"], ["turn", "print"], "at"), "turns")
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    convs = order.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("first"), shared.alias("h"), "own"
    )
    heads = (
        order.where((F.col("conv_id") % block == 0) & (F.col("at") < most - 1))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("at", "print", "bytes"))).alias("head"))
        .withColumnRenamed("conv_id", "first")
    )  # of at most ``most`` - 1 turns each
    convs = convs.join(heads, "first", "left").select(
        "conv_id", "h", "own", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h")).alias("head")
    )
    convs = stored(convs.withColumn("taken", F.size("head").cast("bigint")), "conversations")
    length = F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    lengths = convs.select("conv_id", length.alias("length"))
    borrowed = convs.select("conv_id", F.inline("head")).withColumnRenamed("at", "position")
    own = order.join(convs.select("conv_id", "h", "taken"), "conv_id").where(F.col("at") >= F.col("h")).select(
        "conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("position"), "print", "bytes"
    )
    return stored(borrowed.unionByName(own), "rebuilt"), lengths


def _lane(print_at_place: Column, begin: int) -> Column:
    return F.conv(F.substring(print_at_place, begin, 15), 16, 10).cast("decimal(20,0)")


def _name(depth: Column, lane_a: Column, lane_b: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), lane_a.cast("string"), lane_b.cast("string")).cast("binary")))


def trie_members(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """``conv_id, depth, name, parent, bytes, ends``: each node that each conversation passes, the root included.

    A beginning is named by its depth and the sums of two lanes of 60 bits over its
    turns, each a SHA-256 of the place and the turn. Sums of a conversation of any length are running
    totals (:func:`running`), so no task has to follow a whole one.
    """
    placed = F.sha2(F.concat_ws(":", F.col("position").cast("string"), "print"), 256)
    lanes = {name: _lane(placed, 1 + 15 * i) for i, name in enumerate(LANES)}
    zero = F.lit(0).cast("decimal(30,0)")
    valued = turns.select("conv_id", "position", "bytes", *[lane.alias(f"turn_{name}") for name, lane in lanes.items()])
    sums = running(valued, ["conv_id"], ["position"], **{name: F.col(f"turn_{name}").cast("decimal(20,0)") for name in LANES})
    wide = lambda c: c.cast("decimal(30,0)")
    depth = F.col("position") + 1
    nodes = sums.join(lengths, "conv_id").select(
        "conv_id",
        depth.alias("depth"),
        _name(depth, *[wide(F.col(n)) for n in LANES]).alias("name"),
        _name(F.col("position"), *[wide(F.col(n) - F.col(f"turn_{n}")) for n in LANES]).alias("parent"),
        "bytes",
        (depth == F.col("length")).alias("ends"),
    )
    root = lengths.select(
        "conv_id",
        F.lit(0).cast("bigint").alias("depth"),
        _name(F.lit(0), zero, zero).alias("name"),
        F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("bigint").alias("bytes"),
        (F.col("length") == 0).alias("ends"),
    )
    return nodes.unionByName(root)


def joined_ids(ends: DataFrame) -> DataFrame:
    """``name, ends_sha256``: the digest of the ``conv_id`` of each name, ascending and joined by commas.

    Ids are numbered per name and joined in pieces of ``PIECE`` side by side; the
    pieces of a name are then read in order by a task that keeps no more than one and the
    state of the digest, however many there are.
    """
    pieces = (
        numbered(ends, ["name"], ["conv_id"])
        .groupBy("name", F.floor(F.col("number") / PIECE).alias("piece"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done = []
            for found, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = ids.as_py().encode()
                if found == name:
                    state.update(b"," + text)
                    continue
                if state:
                    done.append((name, state.hexdigest()))
                name, state = found, hashlib.sha256(text)
            yield _digest_rows(done)
        if state:
            yield _digest_rows([(name, state.hexdigest())])

    # a batch of few rows, as a piece may be long
    sorted_pieces = pieces.repartition("name").sortWithinPartitions("name", "piece").select("name", "ids")
    return sorted_pieces.mapInArrow(digests, "name binary, ends_sha256 string")


def _digest_rows(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())], names=["name", "ends_sha256"]
    )


def euler_tour(nodes: DataFrame) -> DataFrame:
    """``id, next, leaves, saved`` of the arcs of all ``nodes``: 2 n enters node n, 2 n + 1 leaves it.

    ``nodes`` has ``node, parent, parent_node, name, conv_id, depth, n_children, first_child, saved``. Children are
    visited by ``conv_id``. From the enter arc of a node the tour goes to its first child, from an exit
    arc to the next child of the parent, or else leaves the parent. Children are
    numbered by :func:`numbered`, so a node may have any share of all nodes as children.
    """
    children = nodes.where(F.col("parent").isNotNull()).select("parent", "conv_id", "node")
    children = stored(numbered(children, ["parent"], ["conv_id"]), "children")
    following = children.select("parent", (F.col("number") - 1).alias("number"), F.col("node").alias("next_child"))
    following = children.join(following, ["parent", "number"]).select("node", "next_child")
    enters = F.coalesce(2 * F.col("first_child"), 2 * F.col("node") + 1)
    leaves = F.coalesce(2 * F.col("next_child"), 2 * F.col("parent_node") + 1)
    zero = F.lit(0).cast("bigint")
    arc = lambda i, to, leaf, saved: F.struct(
        (2 * F.col("node") + i).alias("id"), to.alias("next"), leaf.alias("leaves"), saved.alias("saved")
    )
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint")
    return nodes.join(following, "node", "left").select(
        "conv_id", "depth", F.inline(F.array(arc(0, enters, leaf, F.col("saved")), arc(1, leaves, zero, zero)))
    )


def conversation_trie(conversations: DataFrame, short: int = SHORT_LIST) -> DataFrame:
    """One row per distinct beginning of the rebuilt conversations (see :func:`rebuilt_turns`).

    ``conv_id`` (the least member), ``depth``, ``parent_conv_id``, ``n_convs`` (members), ``n_children``,
    ``n_leaves`` and ``saved_tokens`` (over the subtree, its top included; a node saves the bytes of its
    last text once per member but one), ``ends_sha256`` (members that end there).

    Nodes are found by one aggregate. Subtrees are summed by an Euler tour: its arcs are
    ranked as a list (:func:`list_sums`), and what a subtree holds is the difference of the
    sums at its exit and its enter arc. Repeated turns count as turns of their own; columns besides
    ``conv_id``, ``turn``, ``role`` and ``text`` are not looked at; without conversations there is no node, not even a root.
    """
    turns, lengths = rebuilt_turns(turn_prints(conversations))
    members = stored(trie_members(turns, lengths), "members")
    nodes = members.groupBy("name", "depth").agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.first("parent").alias("parent"),
        F.first("bytes").alias("bytes"),
    )
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # from here on numbers stay
    families = (
        nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("name"))
        .agg(F.count(F.lit(1)).alias("n_children"), F.min_by("node", "conv_id").alias("first_child"))
    )
    parents = nodes.select(F.col("name").alias("parent"), F.col("node").alias("parent_node"), F.col("conv_id").alias("parent_conv_id"))
    nodes = (
        nodes.join(families, "name", "left")
        .join(parents, "parent", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))
    )
    nodes = stored(nodes, "families")
    arcs = stored(euler_tour(nodes), "tour")
    ranked = list_sums(arcs, ["conv_id", "depth"], ["leaves", "saved"], short)
    subtree = [(F.max(f"before_{c}") - F.min(f"before_{c}")).alias(f"sub_{c}") for c in ("leaves", "saved")]
    # nothing is weighed at exits, so what stands before an exit is all of the subtree besides what stands before its enter
    sums = ranked.groupBy(F.shiftright("id", 1).alias("node")).agg(*subtree)
    digests = joined_ids(members.where("ends").select("name", "conv_id"))
    return (
        nodes.join(sums, "node")
        .join(digests, "name", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
            F.col("sub_leaves").alias("n_leaves"),
            F.col("sub_saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )
