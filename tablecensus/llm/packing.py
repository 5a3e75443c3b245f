"""Token sequences filled by minimum bin slack."""

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecensus.llm.frames import TEXT_BATCH_BYTES, lean, parts_for, stored
from tablecensus.llm.merging import Merges, runs

PIECES_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
# Pieces that are packed together; the number of such groups grows with the table.
GROUP_PIECES = 2_048
# Words whose ids a task remembers.
REMEMBERED_WORDS = 500_000
# Bytes of texts that are parted into words at a time, and up to one text more.
BYTES_AT_ONCE = 4 << 20


def _strings(found: pa.Array) -> list[str]:
    """What ``to_pylist`` gives, without an object of Arrow for each."""
    return found.to_numpy(zero_copy_only=False).tolist()


class WordIds:
    """The ids of every word met so far, in one array of unsigned 32-bit numbers.

    The tokenizer drops white space and never joins what it parts, so the ids of
    a text are those of its words one after another. It lower-cases, and a full
    stop or comma after a letter is a part of its own, so such forms share the
    ids of the bare word.
    """

    def __init__(self, tokenizer_file: str):
        self.tokenizer = _tokenizer(tokenizer_file)
        self.letters = _letters(tokenizer_file)
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._add([""], np.zeros(0, "<u4"), np.zeros(1, np.int64))

    def __len__(self) -> int:
        return len(self.numbers)

    def __getitem__(self, word: str) -> bytes:
        at = self.numbers[word]
        return self.flat[self.starts[at] : self.starts[at] + self.sizes[at]].tobytes()

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.numbers.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words))))
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.flat = np.append(self.flat, ids.astype("<u4"))

    def _of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def _joined(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of words, given their numbers, one after another."""
        return self.flat[runs(self.starts[numbers], self.sizes[numbers])]

    def learn(self, words: Iterable[str]) -> None:
        """Look up what is new among ``words``: plain ones side by side, others in one call of the tokenizer."""
        if len(self) > REMEMBERED_WORDS:
            self._forget()
        new = [word for word in words if word not in self.numbers]
        if not new:
            return
        given = pa.array(new, pa.string())
        marked = pc.match_substring_regex(given, MARKED)
        bare = pc.if_else(marked, pc.utf8_slice_codeunits(given, 0, -1), given)
        # capitals of these letters have one small letter each, which no normaliser changes
        cores = pc.if_else(pc.match_substring_regex(bare, LOWERED), pc.utf8_lower(bare), bare)
        unknown = [c for c in dict.fromkeys(_strings(pc.unique(cores)) + [".", ","]) if c not in self.numbers]
        plain = list(filter(PLAIN, unknown)) if self.letters else []
        if plain:
            self._add(plain, *self.letters.ids_flat(plain))
        other = [core for core in unknown if core not in self.numbers]
        if other:
            found = [one.ids for one in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._add(other, np.fromiter(chain.from_iterable(found), "<u4", sizes.sum()), sizes)
        # other forms have the ids of the core, then those of the mark
        forms = [(word, core) for word, core in zip(new, _strings(cores)) if word not in self.numbers]
        parts = np.zeros((len(forms), 2), np.int64)  # word 0 is empty
        parts[:, 0] = self._of([core for _, core in forms])
        ends = {mark: self.numbers[mark] for mark in ".,"}
        parts[:, 1] = [ends[word[-1]] if len(word) != len(core) else 0 for word, core in forms]
        self._add([word for word, _ in forms], self._joined(parts.ravel()), self.sizes[parts].sum(1))

    def of_texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each with ``end_id`` behind, and how many each has."""
        parts = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        found = parts.flatten().dictionary_encode()
        words = _strings(found.dictionary)
        self.learn(words)
        numbers = self._of(words)[found.indices.to_numpy()]
        counts = parts.value_lengths().to_numpy().astype(np.int64)
        totals = np.add.reduceat(self.sizes[numbers], np.cumsum(counts) - counts)  # no text is without a word
        ids = self._joined(numbers)
        return np.insert(ids, np.cumsum(totals), end_id), totals + 1


# Words of small letters that no normaliser changes and that are one part whole; words of those
# and their capitals; such a letter, or another of ASCII, and a mark that is a part of its own.
PLAIN = re.compile("[a-zß-öø-ÿ]{1,64}").fullmatch
LOWERED = r"\A(?:[[:ascii:]]*|[A-Za-zÀ-ÖØ-Þß-öø-ÿ]*)\z"
MARKED = r"[A-Za-zÀ-ÖØ-Þß-öø-ÿ][.,]\z"


class Letters:
    """What the merges of a byte-level BPE model make of plain words."""

    def __init__(self, vocabulary: dict[str, int], merges: list[list[str]], end: str):
        # the usual spelling of bytes: printable ones as themselves, others from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        signs = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.inner, self.last = (
            np.array([vocabulary.get(signs[b] + suffix, -1) for b in range(256)], np.int64) for suffix in ("", end)
        )
        self.merges = Merges(
            (vocabulary[a], vocabulary[b], rank, vocabulary[a + b]) for rank, (a, b) in enumerate(merges)
        )

    def ids_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has."""
        coded = [word.encode() for word in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        data = np.frombuffer(b"".join(coded), np.uint8)
        tokens, ends = self.inner[data], np.cumsum(sizes) - 1
        tokens[ends] = self.last[data[ends]]
        return self.merges.join_flat(tokens, sizes)


@cache
def _letters(tokenizer_file: str) -> Letters | None:
    """For a model of the kind that :class:`Letters` reads, whose words lie in its vocabulary; else null."""
    with open(tokenizer_file, encoding="utf-8") as file:
        model = json.load(file)["model"]
    plain = model.get("type") == "BPE" and not any(
        model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
    )
    if not plain:
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    found = Letters(model["vocab"], merges, model.get("end_of_word_suffix") or "")
    # the tokenizer itself must agree on words of all letters
    letters = [chr(c) for c in range(256) if PLAIN(chr(c))]
    tried = [*letters, *[a + b + a for a, b in zip(letters, letters[1:])], "".join(letters[:40])]
    asked = _tokenizer(tokenizer_file).encode_batch_fast(tried, add_special_tokens=False)
    ids, sizes = found.ids_flat(tried)
    same = ids.tolist() == [i for a in asked for i in a.ids] and sizes.tolist() == [len(a.ids) for a in asked]
    return found if same else None


@cache
def _tokenizer(tokenizer_file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_file)
    found.encode_special_tokens = True
    return found


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """The ids of every text and ``end_id``, cut every ``capacity`` ids.

    One row per piece with its place, length and checksum. ``tokenizer_file`` is a
    path that exists on every executor.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(tokenizer_file)  # of this task, so what it remembers goes with it
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[tuple] = []
            sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
            share = np.cumsum(sizes, dtype=np.int64) // BYTES_AT_ONCE
            edges = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(keys)] if keys else []
            for low, high in zip(edges, edges[1:]):
                ids, totals = known.of_texts(texts.slice(low, high - low), end_id)
                at = 0
                for key, total in zip(keys[low:high], totals.tolist()):
                    for start in range(0, total, capacity):
                        piece = ids[at + start : at + min(start + capacity, total)]
                        rows.append((key, start, len(piece), zlib.crc32(piece), total))
                    at += total
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )
            del batch, texts
            pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(lean(cut), PIECES_SCHEMA)


def best_fill(counts: dict[int, int], space: int) -> dict[int, int]:
    """The multiset of lengths whose sum comes closest to ``space`` from below.

    ``counts`` says how often each length may be used. Bit s of ``reach`` is set
    if some multiset adds up to s. Lengths join one after another, a number of
    equal ones in steps of 1, 2, 4, ...; the reach before each step is kept to
    find the way back. It ends as soon as the space can be filled wholly.
    """
    reach, whole, steps = 1, (1 << (space + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], space // length)
        step = 1
        while left:
            step = min(step, left)
            steps.append((length, step, reach))
            reach |= (reach << (length * step)) & whole
            left -= step
            step *= 2
        if reach >> space:
            break
    at, used = reach.bit_length() - 1, {}
    for length, step, before in reversed(steps):
        if not before >> at & 1:
            at -= length * step
            used[length] = used.get(length, 0) + step
    return used


def fill_windows(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fillings that use up all lengths: each a multiset and how often it is taken.

    The longest length left opens a window and :func:`best_fill` completes it;
    a filling is repeated as long as the counts allow.
    """
    left = {n: c for n, c in counts.items() if c}
    fillings = []
    while left:
        longest = max(left)
        left[longest] -= 1
        filling = best_fill({n: c for n, c in left.items() if c and n <= capacity - longest}, capacity - longest)
        left[longest] += 1
        filling[longest] = filling.get(longest, 0) + 1
        times = min(left[n] // k for n, k in filling.items())
        for n, k in filling.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        fillings.append((filling, times))
    return fillings


def pack(pieces: DataFrame, capacity: int = 4096, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (see :func:`token_pieces`) with ``sequence_id`` and ``offset``.

    Pieces are dealt by a hash into groups of about ``group_pieces``, each packed by
    itself: a filled window wastes next to nothing, so only the last of a group
    has padding. ``sequence_id`` is the group's number in the upper 32 bits.
    """
    groups = parts_for(pieces.count(), group_pieces)

    def pack_group(key, group):
        order = np.lexsort((group["start"], group["doc_id"].fillna(-1), -group["length"]))
        group = group.iloc[order].reset_index(drop=True)
        lengths = group["length"].to_numpy()
        waiting: dict[int, list[int]] = {}
        for i in range(len(lengths) - 1, -1, -1):
            waiting.setdefault(int(lengths[i]), []).append(i)
        sequence = np.zeros(len(lengths), np.int64)
        offset = np.zeros(len(lengths), np.int64)
        number = int(key[0]) << 32
        for filling, times in fill_windows({n: len(w) for n, w in waiting.items()}, capacity):
            for _ in range(times):
                at = 0
                for n in sorted(filling, reverse=True):
                    for _ in range(filling[n]):
                        i = waiting[n].pop()
                        sequence[i], offset[i] = number, at
                        at += n
                number += 1
        group["sequence_id"], group["offset"] = sequence, offset
        return group[[*columns, "sequence_id", "offset"]]

    columns = pieces.columns
    return (
        pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
        .groupBy("group")
        .applyInPandas(pack_group, f"{PIECES_SCHEMA}, sequence_id bigint, offset bigint")
    )


def packed_sequences(
    docs: DataFrame,
    tokenizer_file: str,
    capacity: int = 4096,
    end_id: int = 2,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """All texts as pieces of sequences of at most ``capacity`` ids.

    A null or empty text is its end id alone. Documents longer than a sequence
    are cut every ``capacity`` ids, others stay whole. Repeated rows and null
    doc_ids are packed like others; columns besides ``doc_id`` and ``text`` are not
    looked at; no documents give no pieces. The pieces, without their ids, are
    stored once, so texts are read and encoded once.
    """
    pieces = stored(token_pieces(docs, tokenizer_file, capacity, end_id), "pieces", TEXT_BATCH_BYTES)
    return pack(pieces, capacity, group_pieces)
