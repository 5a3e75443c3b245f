"""Byte pair merging of many pieces at once."""

from collections.abc import Iterable

import numpy as np

NEVER = np.int64(1) << 40


class Merges:
    """Which two neighbouring tokens become which one, and in which order."""

    def __init__(self, pairs: Iterable[tuple[int, int, int, int]]):
        """``pairs``: left and right token, the merge's rank, and the token it gives."""
        left, right, ranks, merged = np.array(list(pairs), np.int64).reshape(-1, 4).T
        keys = (left << 32) | right
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(ranks[order], NEVER)
        self.merged = np.zeros(ranks.max(initial=-1) + 1, np.int64)
        self.merged[ranks] = merged

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def join(self, tokens: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The tokens of each piece when nothing is left to join, see :meth:`join_flat`."""
        tokens, sizes = self.join_flat(tokens, sizes)
        ends = np.cumsum(sizes)
        return [tokens[low:high] for low, high in zip((ends - sizes).tolist(), ends.tolist())]

    def join_flat(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces when nothing is left to join, and how many each has.

        ``tokens`` are those of all pieces one after another, ``sizes`` (none 0) how many each has. Each
        turn joins in every piece the pair of least rank, of equal ones the leftmost; a
        piece without such a pair is done and leaves.
        """
        done: list[tuple[np.ndarray, ...]] = []
        piece, tokens, sizes = np.arange(len(sizes)), tokens.copy(), sizes.copy()
        starts = np.cumsum(sizes) - sizes
        rank = np.append(self.rank(tokens[:-1], tokens[1:]), NEVER) if len(tokens) else tokens
        rank[starts + sizes - 1] = NEVER
        while len(piece):
            least = np.minimum.reduceat(rank, starts)
            over = least == NEVER
            if over.any():
                stays = np.repeat(~over, sizes)
                done.append((piece[over], sizes[over], tokens[~stays]))
                tokens, rank = tokens[stays], rank[stays]
                piece, sizes, least = piece[~over], sizes[~over], least[~over]
                if not len(piece):
                    break
                starts = np.cumsum(sizes) - sizes
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            # the first of each piece
            owner = np.searchsorted(starts, at, "right")
            at = at[np.append(True, owner[1:] != owner[:-1])]
            tokens[at] = self.merged[least]
            stays = np.ones(len(tokens), bool)
            stays[at + 1] = False
            tokens, rank = tokens[stays], rank[stays]
            sizes = sizes - 1
            starts = np.cumsum(sizes) - sizes
            at = at - np.arange(len(at))  # one has gone from every piece before
            last = at == starts + sizes - 1
            rank[at[last]] = NEVER
            for changed in (at[~last], at[at > starts] - 1):
                rank[changed] = self.rank(tokens[changed], tokens[changed + 1])
        if not done:
            return tokens, sizes
        piece, sizes, tokens = map(np.concatenate, zip(*done))
        order = np.argsort(piece)
        return tokens[runs((np.cumsum(sizes) - sizes)[order], sizes[order])], sizes[order]


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``starts`` and are ``sizes`` long, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
