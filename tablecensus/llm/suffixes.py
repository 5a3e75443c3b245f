"""Long strings that occur twice: suffixes in buckets, long ties settled on a difference cover.

Two suffixes tie for ``length`` bytes wherever the first may start modulo the
period of a difference cover: some offset below the period takes both to positions
of the cover. So every string that occurs twice shows as a tie between two
cover positions, and their ranks, computed first, decide in bulk:

1. *Cover ranks.* Every cover position is named by the bytes that any such string
   around it must contain (the core) and by all bytes that any such string around it
   could contain (the reach). Names are sorted one bucket at a time. A core that
   occurs once rules out all suffixes around; a reach that occurs twice settles
   that all of them tie, however long the tie is, and only one of
   those places stands for the rest in what follows.
2. *Suffix buckets.* What is left, suffixes around a repeated core, is dealt out in
   buckets, which are sorted one at a time by the name of their first ``length``
   bytes; neighbours with equal names tie.

Names are 64-bit fingerprints, and buckets are chosen by bits independent of them, so
the bits that must agree grow with the data. Order among different names
is of no use here, as only ties count, so fingerprints stand for lexicographic ranks.
"""

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecensus.llm.frames import lean, parts_for, stored, utf8
from tablecensus.llm.words import Fingerprints, grouped, mixed

LENGTH = 400
# The cover is a perfect difference set of a projective plane of this prime order.
ORDER = 11
# Names sorted together.
BUCKET_NAMES = 2_000_000
BUCKET_SUFFIXES = 4_000_000
LEAST_BUCKETS = 24
# Bytes of text in a chunk, which one task cuts.
CHUNK_BYTES = 16 << 20
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
OPEN, STANDS, SETTLED = 1, 2, 3


@cache
def difference_cover(order: int) -> tuple[int, tuple[int, ...]]:
    """The period and ``order`` + 1 offsets whose differences are all numbers below it.

    Powers of a root of a cubic over the field of ``order`` (a prime) elements that
    lie in a plane; a cubic is tried until it gives such a set.
    """
    period = order * order + order + 1
    for a in range(order):
        for b in range(order):
            for c in range(1, order):
                power, offsets = (1, 0, 0), []
                for i in range(period):
                    if power[2] == 0:
                        offsets.append(i)
                    x, y, z = power
                    power = ((z * c) % order, (x + z * b) % order, (y + z * a) % order)
                if len(offsets) == order + 1:
                    differences = {(i - j) % period for i in offsets for j in offsets if i != j}
                    if len(differences) == period - 1:
                        return period, tuple(offsets)
    raise ValueError(f"no difference cover of order {order}")


class Batch:
    """Texts joined, and where each begins."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes


def cover_positions(batch: Batch, length: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The text and the place in ``data`` of every cover position a string can go around."""
    period, offsets = difference_cover(order)
    core = length - period + 1
    longest = int(batch.sizes.max(initial=0))
    every = (np.arange(0, longest + period, period)[:, None] + np.array(offsets)).ravel()
    every.sort()
    last = np.where(batch.sizes >= length, batch.sizes - core, -1)
    counts = np.searchsorted(every, last, "right")
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return owner, batch.begins[owner] + every[np.arange(len(owner)) - first[owner]]


def around(batch: Batch, owner: np.ndarray, at: np.ndarray, length: int, period: int):
    """Begin and end of all bytes that a string of ``length`` bytes around ``at`` may contain."""
    begin, size = batch.begins[owner], batch.sizes[owner]
    return np.maximum(begin, at - period + 1), np.minimum(begin + size, at + length)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Which of sorted rows begins a run of equal ones."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


_BUCKET = (
    "bucket bigint, ids binary, hashes binary, begins binary, places binary, names binary, "
    "reaches binary, repeated binary, settled binary"
)
_BUCKET_NAMES = [c.split()[0] for c in _BUCKET.split(", ")]


def _blobs(
    batch: Batch, keys: np.ndarray, buckets: int, bucket: np.ndarray, at: np.ndarray,
    names: np.ndarray, reaches: np.ndarray | None, repeated: np.ndarray, known: np.ndarray,
) -> Iterator[pa.RecordBatch]:
    """What goes to each bucket: names of places, in order of the places.

    ``known`` marks places of which a text nearby already tells that they tie; of them only the
    place travels, and to a bucket apart, so that places of a very common string do not meet.
    """
    def row(b: int, mine: np.ndarray, asked: bool) -> tuple:
        there = at[mine]
        texts, owner = np.unique(np.searchsorted(batch.begins, there, "right") - 1, return_inverse=True)
        # of texts without bytes, which begin where the next does, the last is found
        starts = np.cumsum(batch.sizes[texts]) - batch.sizes[texts]
        dense = _packed(starts[owner] + there - batch.begins[texts][owner])
        row_keys = b, _packed(keys[texts, 0]), keys[texts, 1].astype("<u4").tobytes(), _packed(starts)
        if not asked:
            return *row_keys, _packed(dense_none), b"", b"", b"", dense
        return (
            *row_keys, dense, names[mine].tobytes(), _six_bytes(reaches[mine]) if reaches is not None else b"",
            np.packbits(repeated[mine]).tobytes(), _packed(dense_none),
        )

    dense_none = np.zeros(0, np.int64)
    rows = []
    asked = np.flatnonzero(~known)
    order = asked[np.argsort(bucket[asked], kind="stable")]  # places ascend within a bucket
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
        rows.append(row(int(b), order[cuts[b] : cuts[b + 1]], True))
    if known.any():
        # decided already: together, and dealt over all buckets by the text they begin in
        rows.append(row(buckets + int(keys[0].sum() % buckets), np.flatnonzero(known), False))
    columns = list(zip(*rows)) or [()] * 9
    yield pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=_BUCKET_NAMES
    )


@cache
def _codecs() -> tuple:
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers that mostly ascend, as compressed differences."""
    return _codecs()[0].compress(np.diff(numbers, prepend=0).astype("<i8").tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(_codecs()[1].decompress(blob), "<i8"))


def _six_bytes(names: np.ndarray) -> bytes:
    """The upper 48 bits of each; equal cores add over 32 more to what must agree."""
    return np.ascontiguousarray(names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _from_six_bytes(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return wide.view("<u8")[:, 0]


class Bucket:
    """All that came to one bucket: keys of the texts, places in them, names."""

    def __init__(self, rows: pd.DataFrame, name_type: str, reaches: bool):
        keys, asked, passed, texts = [], [], [], 0
        for ids, hashes, begins, places, settled in zip(*[rows[c] for c in ("ids", "hashes", "begins", "places", "settled")]):
            keys.append(np.stack([_unpacked(ids), np.frombuffer(hashes, "<u4").astype(np.int64)], 1))
            begins = _unpacked(begins)
            for blob, found in ((places, asked), (settled, passed)):
                dense = _unpacked(blob)
                owner = np.searchsorted(begins, dense, "right") - 1
                found.append((owner + texts, dense - begins[owner]))
            texts += len(begins)
        self.keys = np.concatenate(keys)
        self.owner, self.at = (np.concatenate(x) for x in zip(*asked))
        self.passed_owner, self.passed_at = (np.concatenate(x) for x in zip(*passed))
        self.names = np.concatenate([np.frombuffer(x, name_type) for x in rows["names"]])
        counts = [len(x) // np.dtype(name_type).itemsize for x in rows["names"]]
        self.repeated = np.concatenate(
            [np.unpackbits(np.frombuffer(x, np.uint8))[:n].astype(bool) for x, n in zip(rows["repeated"], counts)]
        )
        self.reaches = np.concatenate([_from_six_bytes(x) for x in rows["reaches"]]) if reaches else None

    def by_text(self, owner: np.ndarray, at: np.ndarray, kind: np.ndarray) -> pd.DataFrame:
        """One row per text with the places found in it and their kinds."""
        order = np.lexsort((at, owner))
        owner, at, kind = owner[order], at[order].astype("<u4"), kind[order]
        first = np.flatnonzero(_runs(owner)) if len(owner) else np.array([], np.int64)
        last = np.append(first[1:], len(owner))
        return pd.DataFrame({
            "id": self.keys[owner[first], 0],
            "text_hash": self.keys[owner[first], 1],
            "places": [at[a:b].tobytes() for a, b in zip(first, last)],
            "kinds": [kind[a:b].tobytes() for a, b in zip(first, last)],
        })

    def by_chunk(self, owner: np.ndarray, at: np.ndarray, chunks: int) -> pd.DataFrame:
        """One row per chunk: its texts, how many places each has, and the places."""
        chunk = _chunk(self.keys[:, 0], self.keys[:, 1], chunks)
        order = np.lexsort((at, owner, chunk[owner]))
        owner, at = owner[order], at[order]
        cuts = np.searchsorted(chunk[owner], np.arange(chunks + 1))
        rows = []
        for c in np.flatnonzero(cuts[1:] > cuts[:-1]):
            texts, counts = np.unique(owner[cuts[c] : cuts[c + 1]], return_counts=True)
            rows.append((
                int(c), _packed(self.keys[texts, 0]), self.keys[texts, 1].astype("<u4").tobytes(),
                counts.astype("<u4").tobytes(), _packed(at[cuts[c] : cuts[c + 1]]),
            ))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _TIES.split(", ")])


def row_key() -> list[Column]:
    """What tells rows apart: the id (for null a hash of the text) and 32 bits of a hash of the text."""
    return [
        F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64(utf8(), F.lit("no id"))).alias("id"),
        F.pmod(F.xxhash64(utf8()), F.lit(1 << 32)).alias("text_hash"),
    ]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*row_key(), utf8().alias("bytes"))


_TIES = "chunk bigint, ids binary, hashes binary, counts binary, places binary"


def _chunk(ids, hashes, chunks: int):
    """The chunk of a text, from columns or arrays alike; copies of a text lie in many."""
    if isinstance(ids, Column):
        return F.pmod(F.pmod(ids, F.lit(chunks)) + F.pmod(hashes, F.lit(chunks)), F.lit(chunks))
    return (ids % chunks + hashes % chunks) % chunks


_FOUND = "id bigint, text_hash bigint, places binary, kinds binary"


def _texts(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, Batch, int]]:
    """Keys of neighbouring texts, the texts joined, and the row of the first."""
    keys = np.stack([np.asarray(batch.column(i)) for i in (0, 1)], 1).astype("<i8")
    first = 0
    for texts in grouped(batch.column(2).to_pylist()):
        yield keys[first : first + len(texts)], Batch(texts), first
        first += len(texts)


def cover_ranks(docs: DataFrame, length: int, order: int, buckets: int) -> DataFrame:
    """Cover positions with a repeated core, by text: ``OPEN``, or settled by a repeated reach.

    Of equal reaches one ``STANDS`` for all. Places with equal core and reach in
    one batch are told apart there, so a string with very many copies comes to its
    bucket as a name per batch.
    """
    period, _ = difference_cover(order)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for keys, batch, _ in _texts(rows, length):
                owner, at = cover_positions(batch, length, order)
                if not len(at):
                    continue
                low, high = around(batch, owner, at, length, period)
                core = Fingerprints(batch.data, BASES[0]).of(at, at + length - period + 1)
                reach = Fingerprints(batch.data, BASES[1]).of(low, high)
                reach = mixed(reach + ((at - low) * 2 * length + (high - at)).astype(np.uint64))
                by = np.lexsort((at, reach, core))
                new = _runs(core[by], reach[by])
                first = np.zeros(len(at), bool)
                first[by[new]] = True
                repeated = np.zeros(len(at), bool)
                repeated[by[new]] = np.diff(np.append(np.flatnonzero(new), len(by))) > 1
                bucket = (core & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets
                yield from _blobs(
                    batch, keys, buckets, bucket, at, (core >> np.uint64(32)).astype("<u4"), reach.astype("<u8"),
                    repeated, ~first,
                )

    def rank(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = Bucket(rows, "<u4", True)
        by = np.lexsort((bucket.reaches, bucket.names))
        names, reaches, repeated = bucket.names[by], bucket.reaches[by], bucket.repeated[by]
        same_core = np.cumsum(_runs(names)) - 1
        new = _runs(names, reaches)
        same_reach = np.cumsum(new) - 1
        shared = (np.bincount(same_reach)[same_reach] > 1) | repeated
        candidates = (np.bincount(same_core)[same_core] > 1) | repeated
        kind = np.where(shared, np.where(new, STANDS, SETTLED), OPEN).astype(np.uint8)
        some = by[candidates]
        return bucket.by_text(
            np.concatenate([bucket.owner[some], bucket.passed_owner]),
            np.concatenate([bucket.at[some], bucket.passed_at]),
            np.concatenate([kind[candidates], np.full(len(bucket.passed_at), SETTLED, np.uint8)]),
        )

    return keyed(docs).mapInArrow(lean(name), _BUCKET).groupBy("bucket").applyInPandas(rank, _FOUND)


def _marks(rows: pa.RecordBatch, column: int, first: int, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in ``data`` and kind of all that was found of the texts of ``batch``."""
    owner, at, kind = [], [], []
    for i in range(len(batch.sizes)):
        for found in rows.column(column)[first + i].as_py() or []:
            places = np.frombuffer(found["places"], "<u4").astype(np.int64)
            owner.append(np.full(len(places), i))
            at.append(places + batch.begins[i])
            kind.append(np.frombuffer(found["kinds"], np.uint8))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    return np.concatenate(owner), np.concatenate(at), np.concatenate(kind)


def _between(begins: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the ranges."""
    change = np.bincount(begins, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(change)[:size] > 0


def suffix_ties(marked: DataFrame, length: int, order: int, buckets: int, chunks: int) -> DataFrame:
    """Places where a string of ``length`` bytes begins that occurs twice, by chunk of texts.

    Of each text of ``marked`` (``id, text_hash, bytes, marks``) the suffixes around
    open and standing cover positions go to their buckets.
    """
    period, _ = difference_cover(order)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for keys, batch, first in _texts(rows, length):
                owner, at, kind = _marks(rows, 3, first, batch)
                ask = kind != SETTLED
                low, high = around(batch, owner[ask], at[ask], length, period)
                if not len(low):
                    continue
                wanted = np.flatnonzero(_between(low, np.minimum(at[ask], high - length) + 1, len(batch.data)))
                names = Fingerprints(batch.data, BASES[0]).of(wanted, wanted + length)
                other = Fingerprints(batch.data, BASES[1]).of(wanted, wanted + length)
                by = np.lexsort((wanted, names))
                new = _runs(names[by])
                head = np.zeros(len(wanted), bool)
                head[by[new]] = True
                repeated = np.zeros(len(wanted), bool)
                repeated[by[new]] = np.diff(np.append(np.flatnonzero(new), len(by))) > 1
                bucket = (other % np.uint64(buckets)).astype(np.int64)
                yield from _blobs(batch, keys, buckets, bucket, wanted, names.astype("<u8"), None, repeated, ~head)

    def sort(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = Bucket(rows, "<u8", False)
        by = np.argsort(bucket.names)
        names = bucket.names[by]
        same = np.cumsum(_runs(names)) - 1
        tied = by[(np.bincount(same)[same] > 1) | bucket.repeated[by]]
        return bucket.by_chunk(
            np.concatenate([bucket.owner[tied], bucket.passed_owner]),
            np.concatenate([bucket.at[tied], bucket.passed_at]),
            chunks,
        )

    return marked.mapInArrow(lean(name), _BUCKET).groupBy("bucket").applyInPandas(sort, _TIES)


def _gathered(found: DataFrame, name: str) -> DataFrame:
    """One row per text; of repeated rows, whose places are the same, each task keeps one."""
    return found.groupBy("id", "text_hash").agg(F.collect_set(F.struct("places", "kinds")).alias(name))


_SPANS = "id bigint, text_hash bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"


def _word_counts(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many whole words, parted by ASCII white space, lie in each range of ``data``."""
    space = np.append((data == 32) | ((data >= 9) & (data <= 13)), True)
    starts = np.flatnonzero(~space[:-1] & np.append(True, space[:-2]))
    inside = np.searchsorted(starts, ends) - np.searchsorted(starts, begins)
    cut = ~space[ends - 1] & ~space[ends]
    return np.maximum(inside - cut, 0)


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, order: int = ORDER, least_words: int = 0
) -> DataFrame:
    """``id, text_hash, spans, kept`` of the texts with bytes in a string that occurs twice.

    A byte counts if a string of ``length`` bytes over it also begins anywhere else
    in the table, in the same text as well, overlapping or not. Strings lie in one text,
    and are judged on the input. ``spans`` are the maximal runs of such bytes
    (UTF-8, end exclusive), ``kept`` all other bytes joined. With ``least_words`` a run of fewer words is left alone.

    Rows are known by ``id`` and ``text_hash`` (see :func:`row_key`);
    repeated rows are occurrences of their own but have one row here. Null
    texts are empty, and texts below ``length`` bytes have no such string. Other
    columns are not looked at. Texts are read twice and moved twice, and only
    those with a repeated core; each step is written, and frees the shuffle before.
    """
    period, offsets = difference_cover(order)
    if length < 2 * period:
        raise ValueError(f"length must be at least {2 * period}")
    total = docs.agg(F.sum(F.octet_length(utf8()))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, parts_for(total * len(offsets) // period, BUCKET_NAMES))
    ranks = stored(cover_ranks(docs, length, order, buckets), "cover-ranks")
    marked = keyed(docs).join(_gathered(ranks, "marks"), ["id", "text_hash"])
    marked = stored(marked.dropDuplicates(["id", "text_hash"]), "marked")
    names = ranks.agg(F.sum(F.length("kinds"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, parts_for(names * period, BUCKET_SUFFIXES))
    chunks = max(LEAST_BUCKETS, parts_for(total, CHUNK_BYTES))
    ties = stored(suffix_ties(marked, length, order, buckets, chunks), "suffix-ties")

    def cut(texts: pa.Table, tied: pa.Table) -> pa.Table:
        places: dict[tuple[int, int], list[np.ndarray]] = {}
        for row in tied.to_pylist():
            ids, hashes = _unpacked(row["ids"]).tolist(), np.frombuffer(row["hashes"], "<u4").tolist()
            found = np.split(_unpacked(row["places"]), np.cumsum(np.frombuffer(row["counts"], "<u4").astype(np.int64))[:-1])
            for key, some in zip(zip(ids, hashes), found):
                places.setdefault(key, []).append(some)
        out: list[tuple] = []
        for rows in texts.combine_chunks().to_batches():
            for keys, batch, first in _texts(rows, length):
                owner, at, kind = _marks(rows, 3, first, batch)
                settled = kind != OPEN
                low, high = around(batch, owner[settled], at[settled], length, period)
                begins = [
                    some + begin
                    for key, begin in zip(map(tuple, keys.tolist()), batch.begins)
                    for some in places.get(key, ())
                ]
                begins = np.concatenate([np.zeros(0, np.int64), *begins])
                gone = _between(np.concatenate([low, begins]), np.concatenate([high, begins + length]), len(batch.data))
                for key, begin, size in zip(keys.tolist(), batch.begins, batch.sizes):
                    here = gone[begin : begin + size]
                    if here.any():
                        data = batch.data[begin : begin + size]
                        edges = np.flatnonzero(np.diff(here, prepend=False, append=False)).reshape(-1, 2)
                        if least_words:
                            edges = edges[_word_counts(data, *edges.T) >= least_words]
                            here = _between(*edges.T, size)
                        spans = [{"start": a, "end": b} for a, b in edges.tolist()]
                        if spans:
                            out.append((*key, spans, data[~here].tobytes()))
        columns = list(zip(*out)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        return pa.Table.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "text_hash", "spans", "kept"]
        )

    chunk = _chunk(F.col("id"), F.col("text_hash"), chunks).alias("chunk")
    texts = marked.select("id", "text_hash", "bytes", "marks", chunk)
    return texts.groupBy("chunk").cogroup(ties.groupBy("chunk")).applyInArrow(cut, _SPANS)


def without_repeats(
    docs: DataFrame, length: int = LENGTH, order: int = ORDER, least_words: int = 0
) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``; see :func:`repeated_spans`.

    A character of which only some bytes are left goes, too, and ``n_chars``, if there is such a column, is
    counted anew. Texts without such bytes, null ones
    among them, stay as they are, and no row is dropped.
    """
    spans = repeated_spans(docs, length, order, least_words).select("id", "text_hash", "kept")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.decode("utf-8", "ignore") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "text_hash", "kept_text"]
            )

    spans = stored(spans.mapInArrow(lean(read), "id bigint, text_hash bigint, kept_text string"), "kept-texts")
    rows = docs.select(F.struct(*docs.columns).alias("row"), *row_key())
    joined = rows.join(spans, ["id", "text_hash"], "left")
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    columns["text"] = F.coalesce("kept_text", "row.text")
    if "n_chars" in columns:
        columns["n_chars"] = F.coalesce(F.length("kept_text").cast(docs.schema["n_chars"].dataType), "row.n_chars")
    return joined.select(*[column.alias(c) for c, column in columns.items()])
