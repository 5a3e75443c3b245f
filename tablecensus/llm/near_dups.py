"""Near-duplicates by HyperMinHash registers, banded, estimated and then verified."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecensus.llm.components import components
from tablecensus.llm.frames import TEXT_BATCH_BYTES, lean, small, stored, utf8
from tablecensus.llm.words import grouped, mixed, shingle_sets

# A sketch has this many registers of 32 bits: leading zeros, then bits that follow. With
# fewer bits, bands of small sets, which have one register filled, meet by chance.
REGISTERS, MANTISSA = 128, 26
BAND = 4
WORDS = 5
PERCENT = 75
# Estimates this far below the threshold are still verified: over five deviations.
MARGIN = 0.2
# Of sets with fewer shingles so few registers are filled that the estimate rules nothing out.
TINY = 32
# Members of a bucket that are compared in one piece with those of other components, in sketches of 512 bytes.
BLOCK, SLICE = 512, 4_096
# A piece is at most some 3 MB, so a task gets few at once.
PIECE_BYTES = 8 << 20
# Bytes of text whose shingles are found together; arrays over them hold many times as much.
SHINGLE_BYTES = 512 << 10
NO_ID = (1 << 63) - 1


def registers(values: np.ndarray, owners: np.ndarray, texts: int) -> np.ndarray:
    """The sketch of each text's shingles.

    A shingle's hash chooses a register, which keeps the least of the rest:
    its number of leading zeros plus one, and the ``MANTISSA`` bits behind the
    first one. Equal sets have equal sketches; 0 is an empty register.
    """
    hashes = mixed(values, 0x2545F4914F6CDD1D)
    place = owners * REGISTERS + (hashes & np.uint64(REGISTERS - 1)).astype(np.int64)
    rest = hashes >> np.uint64(REGISTERS.bit_length() - 1)  # of 57 bits
    least = np.full(texts * REGISTERS, ~np.uint64(0))
    np.minimum.at(least, place, rest)
    filled = least != ~np.uint64(0)
    width = 64 - (REGISTERS.bit_length() - 1)
    # 53 upper bits are exact as floats, which suffices for the exponent and the mantissa
    short = (least >> np.uint64(width - 53)).astype(np.float64)
    exponent = np.where(filled & (short > 0), np.frexp(np.where(short > 0, short, 1))[1], 0)
    zeros = np.minimum(53 - exponent, (1 << (32 - MANTISSA)) - 2) + 1
    shift = np.maximum(exponent - 1 - MANTISSA, 0).astype(np.uint64)
    tail = (short.astype(np.uint64) >> shift) & np.uint64((1 << MANTISSA) - 1)
    packed = (zeros << MANTISSA) | tail.astype(np.int64)
    return np.where(filled, packed, 0).astype("<u4").reshape(texts, REGISTERS)


def estimated(one: np.ndarray, other: np.ndarray, size_one: np.ndarray, size_other: np.ndarray) -> np.ndarray:
    """Jaccard similarity from two rows of registers, corrected for chance collisions.

    Of registers filled on either side, equal ones are counted. Registers of
    different elements agree by chance: leading zeros like those of the larger
    set's least hashes, and then all bits behind, about once in 2^MANTISSA
    times a third (the chance that the zeros agree).
    """
    filled = (one > 0) | (other > 0)
    equal = ((one == other) & filled).sum(-1)
    chance = 1 / (3 << MANTISSA)
    share = equal / np.maximum(filled.sum(-1), 1)
    found = np.clip((share - chance) / (1 - chance), 0, 1)
    # one set can hold no more than the smaller size of the larger
    most = np.minimum(size_one, size_other) / np.maximum(np.maximum(size_one, size_other), 1)
    return np.minimum(found, most)


def similar(one: np.ndarray, other: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets (sorted, distinct) overlap enough, exactly."""
    if not len(one) or not len(other) or 100 * min(len(one), len(other)) < percent * max(len(one), len(other)):
        return False
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(other) - both)


_SKETCH = "id bigint, text_hash bigint, n_shingles bigint, set_a bigint, set_b bigint, sketch binary"


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``id, text_hash`` of every row, the size of its shingle set, two fingerprints of it and its sketch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for texts in grouped(batch.column(2).to_pylist(), SHINGLE_BYTES):
                n = len(texts)
                values, owners = shingle_sets(texts, words)
                sizes = np.bincount(owners, minlength=n)
                prints = []
                for salt in (1, 2):
                    total = np.zeros(n, np.uint64)
                    np.add.at(total, owners, mixed(values, salt * 0x632BE59BD9B4E019))
                    prints.append(mixed(total).view(np.int64))
                sketch = [r.tobytes() for r in registers(values, owners, n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(sizes.astype(np.int64)),
                     pa.array(prints[0]), pa.array(prints[1]), pa.array(sketch, pa.binary())],
                    names=["id", "text_hash", "n_shingles", "set_a", "set_b", "sketch"],
                )
                first += n

    return keyed(docs).mapInArrow(lean(rows), _SKETCH)


def keyed(docs: DataFrame) -> DataFrame:
    """``id`` (a number for null, too), ``text_hash`` and the bytes of each row."""
    return docs.select(*row_key(), utf8().alias("bytes"))


def row_key() -> list[Column]:
    """What tells rows apart: the id and a hash of the text."""
    return [
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(utf8()).alias("text_hash"),
    ]


def band_rows(classes: DataFrame) -> DataFrame:
    """``bucket, cls`` for every band of a sketch that is not wholly empty.

    Sets of one or two shingles are left out, being similar to none but equal ones.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, REGISTERS // BAND, BAND)
            bits = np.ascontiguousarray(sketch).view("<u8")
            place = np.arange(bits.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            bucket = mixed(mixed(mixed(bits[:, :, 0]) + bits[:, :, 1]) + place)
            filled = (bits != 0).any(2)
            cls = np.repeat(np.asarray(batch.column(0)), filled.sum(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[filled].view(np.int64)), pa.array(cls)], names=["bucket", "cls"]
            )

    return (
        classes.where(F.col("n_shingles") > 2).select("cls", "sketch").mapInArrow(lean(rows), "bucket bigint, cls bigint")
    )


def distinct_buckets(shared: DataFrame) -> DataFrame:
    """Of buckets with the very same classes one only: what meets in it has met in all of them.

    Copies of a text share many bands, so most buckets are such repetitions, and each would send its members' sketches
    and sets again. Buckets are told apart by their number of classes, the least and two fingerprints of them all.
    """
    members = shared.groupBy("bucket").agg(
        F.min("hub").alias("hub"),
        F.count(F.lit(1)).alias("n"),
        *[F.bit_xor(F.xxhash64("cls", F.lit(salt))).alias(f"print_{salt}") for salt in (1, 2)],
    )
    one = members.groupBy("hub", "n", "print_1", "print_2").agg(F.min("bucket").alias("bucket"))
    return stored(shared.join(one.select("bucket"), "bucket", "left_semi"), "distinct-buckets")


def plausible(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT, margin: float = MARGIN) -> DataFrame:
    """Those of the pairs ``a, b`` whose sketches leave it open that they are similar."""
    for side in ("a", "b"):
        pairs = pairs.join(
            classes.select(F.col("cls").alias(side), F.col("sketch").alias(f"sketch_{side}"), F.col("n_shingles").alias(f"size_{side}")),
            side,
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [
                np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, REGISTERS) for i in (2, 3)
            ]
            sizes = [np.asarray(batch.column(i)) for i in (4, 5)]
            found = estimated(*sides, *sizes)
            tiny = (np.minimum(*sizes) < TINY) & (100 * np.minimum(*sizes) >= percent * np.maximum(*sizes))
            keep = pa.array(tiny | (found >= percent / 100 - margin))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "sketch_a", "sketch_b", "size_a", "size_b").mapInArrow(lean(rows), "a bigint, b bigint")


def texts_of(chosen: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``cls, bytes``: the text that stands for each of the classes in ``chosen`` (column ``cls``), stored."""
    wanted = stored(classes.select("cls", "id", "text_hash").join(chosen.distinct(), "cls", "left_semi"), "wanted")
    # three numbers each; where they are few enough the texts need not be shuffled to find them
    wanted = small(wanted, F.lit(24))
    texts = stored(keyed(docs).join(wanted, ["id", "text_hash"]).select("cls", "bytes"), "texts")
    return texts


def _sets(column: list[bytes], words: int) -> list[np.ndarray]:
    """The shingle set of each text; of equal ones found once."""
    distinct = {t: n for n, t in enumerate(dict.fromkeys(column))}
    sets = [found for group in grouped(list(distinct), SHINGLE_BYTES) for found in _each_set(group, words)]
    return [sets[distinct[t]] for t in column]


def _each_set(texts: list[bytes], words: int) -> list[np.ndarray]:
    values, owners = shingle_sets(texts, words)
    cuts = np.searchsorted(owners, np.arange(len(texts) + 1))
    return [values[x:y] for x, y in zip(cuts, cuts[1:])]


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose whole shingle sets are similar enough."""
    left = texts.select(F.col("cls").alias("a"), F.col("bytes").alias("bytes_a"))
    right = texts.select(F.col("cls").alias("b"), F.col("bytes").alias("bytes_b"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "bytes_a", "bytes_b")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for low in range(0, batch.num_rows, 64):
                some = batch.slice(low, 64)
                one, other = (_sets(some.column(i).to_pylist(), words) for i in (2, 3))
                keep += [similar(x, y, percent) for x, y in zip(one, other)]
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(chosen) for i in (0, 1)], names=["a", "b"])

    return met.mapInArrow(lean(rows), "a bigint, b bigint")


def shingles_of(texts: DataFrame, words: int) -> DataFrame:
    """``cls, shingles``: the whole sorted set of each text, as 64-bit numbers in one binary value."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for group in grouped(batch.column(1).to_pylist(), SHINGLE_BYTES):
                sets = [values.astype("<u8").tobytes() for values in _each_set(group, words)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(group)), pa.array(sets, pa.binary())], names=["cls", "shingles"]
                )
                first += len(group)

    return texts.select("cls", "bytes").mapInArrow(lean(rows), "cls bigint, shingles binary")


def with_shared(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The classes in ``sets`` with their ``shingles`` and ``shared``: how many of these another of them has, too.

    A shingle met once belongs to one class; counting those needs one shuffle of
    the shingles, summed up before by each task.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(shingles, "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values), pa.array(np.full(len(values), cls))], names=["shingle", "cls"]
                )

    once = (
        sets.mapInArrow(lean(rows), "shingle bigint, cls bigint")
        .groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("cls"))
        .where(F.col("n") == 1)
        .groupBy("cls").agg(F.count(F.lit(1)).alias("own"))
    )
    own = F.coalesce("own", F.lit(0).cast("bigint"))
    return (
        classes.join(sets, "cls")
        .join(once, "cls", "left")
        .select("cls", "n_shingles", "sketch", (F.col("n_shingles") - own).alias("shared"), "shingles")
    )


def _members(column: pa.Array) -> Iterator[tuple]:
    """For each row its members: sketches, classes, roots, sizes, shared sizes and whole sets."""
    values = column.values
    sketch = np.frombuffer(b"".join(values.field("sketch").to_pylist()), "<u4").reshape(-1, REGISTERS)
    rest = [np.asarray(values.field(c)) for c in ("cls", "root", "n_shingles", "shared")]
    sets = values.field("shingles")
    offsets = np.asarray(column.offsets)
    for low, high in zip(offsets - offsets[0], offsets[1:] - offsets[0]):
        yield sketch[low:high], *[c[low:high] for c in rest], sets.slice(low, high - low).to_pylist()


def overlapping(one: bytes, others: list[bytes], percent: int) -> np.ndarray:
    """Which of the other whole sets (sorted numbers, as bytes) overlap with one enough, exactly."""
    mine = np.frombuffer(one, "<u8")
    theirs = np.frombuffer(b"".join(others), "<u8")
    sizes = np.array([len(o) // 8 for o in others])
    at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
    both = np.add.reduceat((mine[at] == theirs).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= percent * (len(mine) + sizes - both)


def across(bands: DataFrame, classes: DataFrame, roots: DataFrame, percent: int, margin: float, links: bool) -> DataFrame:
    """What in a bucket may still link different components: the classes ``cls``, or with ``links`` links ``a, b``.

    In every bucket with several components all members meet those outside of its
    largest component, which are cut into blocks; what they meet is cut into slices.
    So a bucket with nearly all members linked costs little more than reading
    it, and no task gets a whole large bucket: blocks and slices are bounded in bytes. Two sets that share m shingles have
    a similarity of m in the rest of both and m; since m is at most what
    either shares with any set (``shared`` of ``classes``), and by the
    estimate from the registers, most pairs are ruled out where they meet.

    With ``links`` the others are compared there, too, on their whole sets
    (``shingles`` of ``classes``); what is linked counts as one component from then on, so a
    piece gives fewer links than it has members, however many of its pairs are similar or have to be compared.
    """
    rooted = bands.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn(
        "root", F.coalesce("root", "cls")
    )
    # in sketches, so that long sets count for what they hold
    weight = F.lit(1).cast("bigint")
    if links:
        rooted = rooted.join(classes.select("cls", "n_shingles"), "cls")
        weight = 1 + F.expr(f"n_shingles div {REGISTERS // 2}")
    else:
        classes = classes.withColumn("shingles", F.lit(b""))
    shares = rooted.groupBy("bucket", "root").agg(F.sum(weight).alias("n"))
    mixed_buckets = (
        shares.groupBy("bucket")
        .agg(F.sum("n").alias("members"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("largest"))
        .where(F.col("members") > F.col("most"))
    )
    mixed_buckets = stored(mixed_buckets, "mixed-buckets")
    blocks = F.ceil((F.col("members") - F.col("most")) / BLOCK).cast("bigint")
    slices = F.ceil(F.col("members") / SLICE).cast("bigint")
    met = stored(
        rooted.select("bucket", "cls", "root").join(mixed_buckets, "bucket")
        .join(classes.select("cls", "n_shingles", "shared", "sketch", "shingles"), "cls")
        .select(
            "bucket",
            F.struct("cls", "root", "n_shingles", "shared", "sketch", "shingles").alias("one"),
            (F.col("root") != F.col("largest")).alias("outside"),
            blocks.alias("blocks"), slices.alias("slices"),
            F.pmod(F.xxhash64("cls"), blocks).alias("block"), F.pmod(F.xxhash64("cls", F.lit(1)), slices).alias("slice"),
        ),
        "bucket-members",
    )
    zero = F.lit(0).cast("bigint")
    outside = met.where("outside").select(
        "bucket", "block", F.explode(F.sequence(zero, F.col("slices") - 1)).alias("slice"), "one", F.lit(True).alias("asks")
    )
    others = met.select(
        "bucket", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), "slice", "one", F.lit(False).alias("asks")
    )
    pieces = outside.unionByName(others).groupBy("bucket", "block", "slice").agg(
        F.collect_list(F.when(F.col("asks"), F.col("one"))).alias("asking"),
        F.collect_list(F.when(~F.col("asks"), F.col("one"))).alias("asked"),
    )  # of about BLOCK and SLICE sketches

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            for asking, asked in zip(_members(batch.column(0)), _members(batch.column(1))):
                sketch, cls, root, size, shared, sets = asked
                own_roots, root = asking[2].copy(), root.copy()
                hit_any = np.zeros(len(cls), bool)
                for i, (one, a, _, n, has, whole) in enumerate(zip(*asking)):
                    own = own_roots[i]
                    most = np.minimum(shared, has)
                    hit = (root != own) & (100 * most >= percent * (size + n - most))
                    some = np.flatnonzero(hit)
                    if not len(some):
                        continue
                    near = estimated(one[None], sketch[some], n, size[some]) >= percent / 100 - margin
                    some = some[near | (np.minimum(size[some], n) < TINY)]
                    if not len(some):
                        continue
                    if not links:
                        hit_any[some] = True
                        found.append(np.array([[a], [a]]))
                        continue
                    some = some[overlapping(whole, [sets[j] for j in some], percent)]
                    merged, first = np.unique(root[some], return_index=True)
                    linked = cls[some[first]]
                    found.append(np.stack([np.maximum(linked, a), np.minimum(linked, a)]))
                    root[np.isin(root, merged)] = own
                    own_roots[np.isin(own_roots, merged)] = own
                if hit_any.any():
                    found.append(np.stack([cls[hit_any], cls[hit_any]]))
            every = np.unique(np.concatenate(found, 1), axis=1) if found else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(every[0]), pa.array(every[1])], names=["a", "b"])

    found = pieces.select("asking", "asked").mapInArrow(lean(rows), "a bigint, b bigint")
    return found.distinct() if links else found.select(F.col("a").alias("cls")).distinct()


def _further_links(
    stars: DataFrame, links: DataFrame, bands: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int
) -> DataFrame:
    """Links that the first stars have missed, so that all together give the right components.

    Classes with a plausible partner in another component are looked at on
    their own: what each has in common with any of the others is counted on whole sets.
    In each bucket the one with the least of its own, such as the text that the
    others are edited from, is the hub of a second star, again one link per class. What is plausible even then,
    in view of the counts, is compared on whole sets where it meets, and only links come out.
    """
    roots = components(links)
    any_share = classes.withColumn("shared", F.col("n_shingles"))
    open_classes = stored(across(bands, any_share, roots, percent, MARGIN, links=False), "open-classes", PIECE_BYTES)
    if not open_classes.limit(1).count():
        return roots
    texts = texts_of(open_classes, classes, docs)
    sets = stored(shingles_of(texts, words), "open-shingles", TEXT_BATCH_BYTES)
    known = stored(with_shared(classes, sets), "open-sets", TEXT_BATCH_BYTES)
    bands = stored(bands.join(open_classes, "cls", "left_semi"), "open-bands")
    least_own = F.struct(((F.col("n_shingles") - F.col("shared")) / F.col("n_shingles")).alias("own"), "cls")
    hubs = bands.join(known, "cls").groupBy("bucket").agg(F.min(least_own).alias("hub"))
    hubs = stored(hubs, "hubs")
    second = bands.join(hubs, "bucket").where(F.col("cls") != F.col("hub.cls"))
    second = second.groupBy("cls").agg(F.min("hub").alias("hub")).select("cls", F.col("hub.cls").alias("hub"))
    second = second.select(F.greatest("cls", "hub").alias("a"), F.least("cls", "hub").alias("b")).distinct()
    second = stored(plausible(second.join(stars, ["a", "b"], "left_anti"), classes, percent), "stars")
    known_links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    near = stored(verified(second, texts, words, percent), "links", TEXT_BATCH_BYTES)
    roots = components(known_links.unionByName(near))
    more = stored(across(bands, known, roots, percent, MARGIN, links=True), "further-links", PIECE_BYTES)
    if not more.limit(1).count():
        return roots
    known_links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(known_links.unionByName(more))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept`` for every row of ``docs``.

    Rows with equal shingle sets are one class. Classes sharing a band are
    candidates: each first with one other only, the least class of all its buckets, which links
    whole groups of copies at the cost of one pair per member; then, in buckets
    whose members did not all come together, as :func:`_further_links` says.
    Candidates that the estimate leaves open are verified on their whole sets.
    ``component_id`` is the least ``doc_id`` reachable; ``kept`` is true for the row with
    this id (if texts share it, the one with the least hash).

    Texts without words (null and empty ones too) are linked with nothing and kept.
    A null ``doc_id`` counts as larger than any other, and a component of such rows alone has
    a null id. Of wholly equal rows all are kept if one is. Columns besides ``doc_id`` and ``text`` are not looked at.
    """
    rows = stored(sketches(docs, words), "sketches", TEXT_BATCH_BYTES)
    classes = (
        rows.where(F.col("n_shingles") > 0)
        .groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min(F.struct("id", "text_hash")).alias("first"), F.first("sketch").alias("sketch"))
        .select("set_a", "set_b", "n_shingles", "first.*", "sketch", F.monotonically_increasing_id().alias("cls"))
    )
    classes = stored(classes, "classes")  # from here on numbers stay
    bands = band_rows(classes)
    hubs = bands.groupBy("bucket").agg(F.min("cls").alias("hub"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    hubs = stored(hubs.select("bucket", "hub"), "hubs")
    shared = distinct_buckets(stored(bands.join(hubs, "bucket"), "shared-bands"))
    stars = shared.where(F.col("cls") != F.col("hub")).groupBy("cls").agg(F.min("hub").alias("hub"))
    stars = stored(plausible(stars.select(F.col("cls").alias("a"), F.col("hub").alias("b")), classes, percent), "stars")
    ends = stars.select(F.col("a").alias("cls")).union(stars.select("b"))
    links = stored(verified(stars, texts_of(ends, classes, docs), words, percent), "links", TEXT_BATCH_BYTES)
    shared = shared.select("bucket", "cls")
    roots = _further_links(stars, links, shared, classes, docs, words, percent)
    roots = stored(roots, "roots")
    ids = classes.select("cls", F.struct("id", "text_hash").alias("first")).join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    ids = ids.withColumn("root", F.coalesce("root", "cls"))
    least = stored(ids.groupBy("root").agg(F.min("first").alias("least")), "least")
    named = ids.join(least, "root").select("cls", "least")
    sets = ["set_a", "set_b", "n_shingles"]
    named = classes.select(*sets, "cls").join(named, "cls").drop("cls")
    placed = rows.select("id", "text_hash", *sets).join(stored(named, "named"), sets, "left")
    component = F.coalesce("least.id", "id")
    return placed.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        "text_hash",
        "n_shingles",
        F.when(component != NO_ID, component).alias("component_id"),
        (
            (F.col("id") == component) & (F.col("text_hash") == F.coalesce("least.text_hash", "text_hash"))
        ).alias("kept"),
    )
