"""Fingerprints of words and shingles, many texts at a time."""

from collections.abc import Iterator

import numpy as np

WORD_BASE = 0x9E3779B97F4A7C15
SHINGLE_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
# Bytes of text looked at together.
BATCH_BYTES = 2 << 20


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bits of 64-bit numbers spread over each other, one to one."""
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``base`` and its inverse to the powers from 0 to ``size``, modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) <= size:
        found = []
        for factor in (base, pow(base, -1, 1 << 64)):
            up = np.full(size + 1, np.uint64(factor))
            up[0] = 1
            found.append(np.multiply.accumulate(up))
        _powers[base] = tuple(found)
    return _powers[base][0][: size + 1], _powers[base][1][: size + 1]


def forget_powers() -> None:
    """What :func:`powers` remembers, 16 bytes for each byte of the longest group of texts and each base."""
    _powers.clear()


class Fingerprints:
    """Fingerprints of any parts of ``data``, from the running sums of a polynomial."""

    def __init__(self, data: np.ndarray, base: int = WORD_BASE):
        up, self.down = powers(base, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def grouped(texts: list[bytes], most: int | None = None) -> Iterator[list[bytes]]:
    """Neighbouring texts of about ``most`` bytes together, by default ``BATCH_BYTES``; a longer one alone."""
    most = BATCH_BYTES if most is None else most
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > most:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def shingle_sets(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text: fingerprints, sorted, and whose they are.

    A-Z are lower-cased; a word is a run of anything but ASCII white space. A text
    with fewer than ``words`` words has them all as one shingle, one without words none.
    """
    data = np.frombuffer(b" ".join([b"", *[t.lower() for t in texts], b""]), np.uint8)
    bounds = np.cumsum([1, *[len(t) + 1 for t in texts]])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    found = Fingerprints(data).of(starts, ends) + (ends - starts).astype(np.uint64)
    first = np.searchsorted(starts, bounds[:-1])
    counts = np.searchsorted(starts, bounds[1:]) - first
    last_word = np.repeat(first + counts, counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(found))
    whole = at + words <= last_word
    short = (at == np.repeat(first, counts)) & (np.repeat(counts, counts) < words)
    chosen = np.flatnonzero(whole | short)
    length = np.minimum(last_word[chosen] - chosen, words)
    value = mixed(length.astype(np.uint64))
    for i in range(words):
        inside = length > i
        word = mixed(found[np.minimum(chosen + i, len(found) - 1)], SHINGLE_BASES[i % 5] + i)
        value = np.where(inside, mixed(value + word * np.uint64(SHINGLE_BASES[i % 5])), value)
    owner = owner[chosen]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], owner[new]
