"""Byte-level BPE: texts to ids of a rank file, and back."""

import base64
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablecensus.llm.merging import Merges

# Contractions that are pieces of their own, by what follows the apostrophe.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")

# What a code point is to the splitter.
LETTER, NUMBER, OTHER, LAST_SPACE, LAST_WHITE, SHORT, LONG, INNER_WHITE, END = range(9)
# What the splitter is in the middle of, having read a code point.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, AFTER_WHITE, ONE_TO_GO, TWO_TO_GO = range(9)
STATES = 9
BLOCK = 128
# Code points split together, rows decoded together, and pieces remembered by a task.
BATCH_CHARS = 1_000_000
DECODE_ROWS = 256
REMEMBERED_PIECES = 500_000
REMEMBERED_BYTES = 64


@cache
def _kinds() -> np.ndarray:
    """For every code point: letter, number, other, or white space (as LAST_WHITE).

    Asked of the library whose ids are to be met, since versions of Unicode
    differ: an encoding whose tokens are single bytes returns just the code
    points that its pattern matches.
    """
    import tiktoken

    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    kinds = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (LAST_WHITE, r"\s")):
        codes = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(codes.encode_ordinary(everything)).decode()
        kinds[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    return kinds


@cache
def _machine() -> tuple[bytes, bytes]:
    """Next state, and whether a piece starts, at 9 times the kind plus the state.

    Both as tables of 256 bytes, so that one ``translate`` looks up a whole array.
    """
    goes = np.zeros((9, STATES), np.uint8)
    starts = np.ones((9, STATES), bool)

    def step(kind, to, also=(), stays=()):
        goes[kind] = to
        for state in stays:
            starts[kind, state] = False
        for state, other in also:
            goes[kind, state] = other
            starts[kind, state] = False

    step(LETTER, IN_LETTERS, [(ONE_TO_GO, FRESH), (TWO_TO_GO, ONE_TO_GO)], [IN_LETTERS, AFTER_SPACE])
    step(NUMBER, IN_NUMBERS, stays=[IN_NUMBERS, AFTER_SPACE])
    step(OTHER, IN_OTHERS, stays=[IN_OTHERS, AFTER_SPACE])
    # an apostrophe opens a contraction only where a piece starts
    step(SHORT, ONE_TO_GO, [(IN_OTHERS, IN_OTHERS), (AFTER_SPACE, IN_OTHERS)])
    step(LONG, TWO_TO_GO, [(IN_OTHERS, IN_OTHERS), (AFTER_SPACE, IN_OTHERS)])
    # of a run of white space before something else the last is a piece apart,
    # and if it is a space the next piece begins with it
    step(LAST_SPACE, AFTER_SPACE)
    step(LAST_WHITE, AFTER_WHITE)
    step(INNER_WHITE, IN_WHITE, stays=[IN_WHITE])
    step(END, FRESH)
    return tuple(t.astype(np.uint8).tobytes().ljust(256, b"\0") for t in (goes, starts))


def _classes(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The kind of each code point, what follows it taken into account."""
    kind = _kinds()[points]
    kind[ends] = END
    after = np.append(points[1:], 0)
    after[ends] = 0
    second = np.append(after[1:], 0)
    white = kind == LAST_WHITE
    last = np.append(~white[1:], False)
    last[np.maximum(ends - 1, 0)] = False  # at the end of a text all of the run is one piece
    kind[white & ~last] = INNER_WHITE
    kind[white & last & (points == ord(" "))] = LAST_SPACE
    quote = points == ord("'")
    quote[ends] = False
    kind[quote & np.isin(after, [ord(c) for c in SHORT_ENDINGS])] = SHORT
    for one, two in LONG_ENDINGS:
        kind[quote & (after == ord(one)) & (second == ord(two))] = LONG
    return kind


def piece_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces start in ``points``, texts joined by one code point at each of ``ends``.

    A code point is a function from state to state. Blocks of them are composed
    side by side, for all states a block might begin in; the functions of the
    blocks are composed by an associative scan, which tells in which state each
    block does begin; then all blocks are run side by side from there.
    """
    goes, starts = _machine()
    kinds = _classes(points, ends) * np.uint8(STATES)
    blocks = -(-len(kinds) // BLOCK)
    padded = np.full(blocks * BLOCK, END * STATES, np.uint8)
    padded[: len(kinds)] = kinds
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    whole = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], blocks, 1)
    for column in columns:
        whole = _look_up(goes, column + whole)
    reach = 1
    while reach < blocks:  # whole[:, i] becomes the function of all blocks up to i
        later = np.take_along_axis(whole[:, reach:], whole[:, :-reach].astype(np.intp), 0)
        whole = np.concatenate([whole[:, :reach], later], 1)
        reach *= 2
    state = np.append(np.uint8(FRESH), whole[FRESH, :-1])
    begins = np.empty((BLOCK, blocks), np.uint8)
    for i, column in enumerate(columns):
        at = column + state
        begins[i] = _look_up(starts, at)
        state = _look_up(goes, at)
    return np.flatnonzero(begins.T.ravel()[: len(kinds)])


def _look_up(table: bytes, at: np.ndarray) -> np.ndarray:
    return np.frombuffer(at.tobytes().translate(table), np.uint8).reshape(at.shape)


class Ranks:
    """The tokens of a rank file."""

    def __init__(self, rank_file: str):
        with open(rank_file, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.merges = Merges(
            (ranks[token[:i]], ranks[token[i:]], rank, rank)
            for token, rank in ranks.items() for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        )
        # all tokens one after another, and where each lies
        size = max(self.tokens, default=-1) + 1
        self.lengths = np.array([len(self.tokens.get(i, b"")) for i in range(size)], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Join the neighbours of least rank, the leftmost first, until none can be joined.

        For a long piece: parts are a linked list, candidate pairs lie in a heap.
        """
        ranks, size = self.ranks, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        follows, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [
            (rank, i, i + 2) for i in range(size - 1) if (rank := ranks.get(piece[i : i + 2])) is not None
        ]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            middle = follows[i]
            # stale unless both parts still stand as they did
            if middle < 0 or middle >= size or follows[middle] != end:
                continue
            follows[i], follows[middle] = end, -1
            if end < size:
                before[end] = i
                if (rank := ranks.get(piece[i : follows[end]])) is not None:
                    heappush(heap, (rank, i, follows[end]))
            if (j := before[i]) >= 0 and (rank := ranks.get(piece[j:end])) is not None:
                heappush(heap, (rank, j, end))
        ids, i = [], 0
        while i < size:
            ids.append(ranks[piece[i : follows[i]]])
            i = follows[i]
        return ids

    def merge_short(self, pieces: list[bytes]) -> Iterator[bytes]:
        """The ids of each of many short pieces, joined side by side."""
        whole = [self.ranks.get(piece) for piece in pieces]
        parted = [piece for piece, rank in zip(pieces, whole) if rank is None]
        sizes = np.array([len(piece) for piece in parted], np.int64)
        tokens = self.bytes[np.frombuffer(b"".join(parted), np.uint8)]
        found = iter(self.merges.join(tokens, sizes))
        for rank in whole:
            yield (next(found) if rank is None else np.array([rank])).astype("<u4").tobytes()

    def encode(self, texts: list[list[bytes]], known: dict[bytes, bytes]) -> list[bytes]:
        """The ids of the pieces of each text as unsigned 32-bit little-endian numbers; ``known`` ones are not merged again."""
        if len(known) > REMEMBERED_PIECES:
            known.clear()
        new = set(chain.from_iterable(texts)).difference(known)
        short = [piece for piece in new if len(piece) <= REMEMBERED_BYTES]
        known.update(zip(short, self.merge_short(short)))
        long = {piece: np.array(self.merge(piece), "<u4").tobytes() for piece in new if len(piece) > REMEMBERED_BYTES}
        if long:
            return [b"".join([known.get(piece) or long[piece] for piece in pieces]) for pieces in texts]
        return [b"".join(map(known.__getitem__, pieces)) for pieces in texts]

    def begins_of(self, ids: np.ndarray) -> np.ndarray:
        """Where the bytes of each id begin in the decoded text."""
        widths = self.lengths[ids]
        return np.cumsum(widths) - widths

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, gathered from the tokens."""
        widths = self.lengths[ids]
        at = np.repeat(self.begins[ids] - (np.cumsum(widths) - widths), widths)
        return self.blob[at + np.arange(len(at))]


@cache
def _ranks(rank_file: str) -> Ranks:
    return Ranks(rank_file)


def split_texts(texts: list[str]) -> Iterator[list[bytes]]:
    """The pieces of each text as UTF-8, one after another the whole text."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts = piece_starts(points, ends)  # the code point that ends a text is a piece, too
    widths = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    at = np.append(0, np.cumsum(widths))[np.append(starts, len(points))].tolist()
    blob = joined.encode()
    first = 0
    for last in np.searchsorted(starts, ends).tolist():
        yield [blob[a:b] for a, b in zip(at[first:last], at[first + 1 : last + 1])]
        first = last + 1


def _in_groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= BATCH_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, rank_file: str, offsets: bool = True) -> DataFrame:
    """``doc_id``, ``ids`` and ``starts`` of every whole text, without special tokens.

    Texts are cut into pieces by :func:`piece_starts`, as the usual pattern of such
    vocabularies does, and each piece is merged by itself. ``ids`` holds unsigned
    32-bit little-endian numbers, ``starts`` likewise the byte of the text at which
    each id begins (null with ``offsets=False``). A null text is an empty one and has no ids. Rows come out as
    often as they went in; columns besides ``doc_id`` and ``text`` are not looked
    at. ``rank_file`` is a path that exists on every executor.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known = _ranks(rank_file), {}
        for batch in batches:
            first = 0
            for texts in _in_groups([t or "" for t in batch.column(1).to_pylist()]):
                ids = ranks.encode(list(split_texts(texts)), known)
                places = [None] * len(ids)
                if offsets:
                    places = [ranks.begins_of(np.frombuffer(x, "<u4")).astype("<u4").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(ids)), pa.array(ids, pa.binary()), pa.array(places, pa.binary())],
                    names=["doc_id", "ids", "starts"],
                )
                first += len(ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, ids binary, starts binary")


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of the ids; null ids are none.

    Offsets (``starts``), where there are any, must be where the bytes of each id begin.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(rank_file)
        # few rows at a time, as a batch with its offsets is large
        for batch in (b.slice(low, DECODE_ROWS) for b in batches for low in range(0, b.num_rows, DECODE_ROWS)):
            at = batch.schema.get_field_index("starts")
            places = batch.column(at) if at >= 0 else [None] * batch.num_rows
            texts = []
            for x, starts in zip(batch.column(batch.schema.get_field_index("ids")), places):
                ids = np.frombuffer(x.as_py() or b"", "<u4")
                if starts is not None and starts.is_valid:
                    if not np.array_equal(np.frombuffer(starts.as_py(), "<u4"), ranks.begins_of(ids)):
                        raise ValueError("offsets do not fit the ids")
                texts.append(ranks.decode(ids).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"]
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "decoded"]
    return encoded.drop("decoded").mapInArrow(rows, ", ".join([*fields, "decoded binary"]))


def decode_part(ids: bytes, starts: bytes, low: int, high: int, rank_file: str) -> bytes:
    """Bytes ``low`` to ``high`` of an encoded text, decoding only the ids they lie in."""
    if high <= low:
        return b""
    at = np.frombuffer(starts, "<u4")
    first = max(int(np.searchsorted(at, low, "right")) - 1, 0)
    last = int(np.searchsorted(at, high, "left"))
    token = _ranks(rank_file).tokens.__getitem__
    found = b"".join(map(token, np.frombuffer(ids, "<u4")[first:last].tolist()))
    return found[low - int(at[first]) : high - int(at[first])] if last > first else b""
