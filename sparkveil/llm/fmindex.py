"""A compressed full-text index over words: Burrows-Wheeler transform in a wavelet matrix of packed bits, searched backward for many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: 64 bits a word and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), dtype=np.int32)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        below = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(below).astype(np.int64)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.height = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        x = symbols
        for shift in range(self.height - 1, -1, -1):
            bit = (x >> shift) & 1
            self.levels.append((Bits(bit.astype(np.uint8)), int(len(bit) - bit.sum())))
            x = np.concatenate([x[bit == 0], x[bit == 1]])
        first = np.full(sigma + 1, len(x), dtype=np.int64)
        change = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
        first[x[change]] = change
        self.first = first  # where a symbol's run begins in the last level

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c before position i."""
        for depth, (bits, zeros) in enumerate(self.levels):
            one = (c >> (self.height - 1 - depth)) & 1
            r = bits.rank(i)
            i = np.where(one == 1, zeros + r, i - r)
        return i - self.first[c]


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` symbols at least, by doubling, and the symbols that each shares with the one before it, -1 at both ends."""
    n, k = len(text), 1
    ranks = [np.append(text.astype(np.int64), -1)]  # by the first 1, 2, 4, .. symbols; what is past the end is like nothing
    while True:
        rank = ranks[-1]
        after = np.full(n, -1, dtype=np.int64)
        after[: n - k if k < n else 0] = rank[k:n]
        key = rank[:n] * (n + int(rank.max()) + 2) + after + 1
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.full(n + 1, -1, dtype=np.int64)
        rank[order] = step
        ranks.append(rank)
        k *= 2
        if k >= depth or step[-1] == n - 1:
            break
    shared = np.zeros(n + 1, dtype=np.int32)
    x, y = order[:-1].copy(), order[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        same = (ranks[level][x] == ranks[level][y]).astype(np.int64) << level
        x, y = x + same, y + same
    shared[1:n] = y - order[1:]
    shared[0] = shared[n] = -1
    return order, shared


def nearest_less(x: np.ndarray) -> np.ndarray:
    """For each place, the last one before it that holds less; the first place holds the least of all and gets 0."""
    out = np.maximum(np.arange(len(x)) - 1, 0)
    todo = np.flatnonzero(x[out] >= x)
    todo = todo[x[todo] > x[0]]
    while len(todo):  # between a place and the one it points to, nothing is less than at the place
        out[todo] = out[out[todo]]
        todo = todo[x[out[todo]] >= x[todo]]
    return out


class FMIndex:
    """Index of pieces of words, each with an owner; patterns shorter than `depth` words can be searched.

    `codes` are the words of all pieces, from 1 up, each piece ended by a 0; `owner` is the owner of each position."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray, depth: int):
        sa, self.shared = suffix_array(codes, depth)
        self.left, self.right = nearest_less(self.shared), len(codes) - nearest_less(self.shared[::-1])[::-1]
        sigma = int(codes.max()) + 1
        self.bwt = WaveletMatrix(codes[sa - 1], sigma)
        count = np.bincount(codes, minlength=sigma)
        self.start = np.concatenate([[0], np.cumsum(count)])[:-1]
        self.size = len(codes)
        table = [owner[sa].astype(np.int32)]
        while 2 ** len(table) <= self.size:  # least owners of runs of 2^k suffixes
            half, last = 2 ** (len(table) - 1), table[-1]
            table.append(np.minimum(last[:-half], last[half:]))
        self.table = table
        self.width = np.array([len(t) for t in table])
        self.flat = np.concatenate(table)
        self.at = np.concatenate([[0], np.cumsum(self.width)])[:-1]

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        return np.minimum(self.flat[self.at[k] + lo], self.flat[self.at[k] + hi - (1 << k)])

    def extend_left(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = self.bwt.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        n = len(c)
        return self.start[c] + r[:n], self.start[c] + r[n:]

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffixes that share the longest prefix of what [lo, hi) have in common that more suffixes begin with, and its length."""
        k = np.where(self.shared[lo] >= self.shared[hi], lo, hi)
        return self.left[k], self.right[k], self.shared[k]

    def matching_statistics(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray, least: int) -> np.ndarray:
        """For each place in codes, the length of the longest match from there on, within its pattern codes[start:end], that occurs in a piece with
        an owner less than the pattern's. Each pattern is read once, from its end: a match grows to the left as long as it occurs, and
        else gives up words on its right. A pattern is left, with 0, where no match of `least` words can begin any more."""
        out = np.zeros(len(codes), dtype=np.int32)
        lane = np.flatnonzero(end - start >= least)
        at = end[lane] - 1
        lo, hi, size = np.zeros(len(lane), np.int64), np.full(len(lane), self.size, np.int64), np.zeros(len(lane), np.int64)
        while len(lane):
            x, y = self.extend_left(codes[at], lo, hi)
            fits = y > x
            fits[fits] = self.least_owner(x[fits], y[fits]) < owner[lane[fits]]
            lo, hi, size = np.where(fits, x, lo), np.where(fits, y, hi), size + fits
            up = ~fits & (size > 0)
            lo[up], hi[up], size[up] = self.parent(lo[up], hi[up])
            out[at[~up]] = np.where(fits, size, 0)[~up]
            at = at - ~up
            live = (at >= start[lane]) & (at + 1 + size >= start[lane] + least)
            lane, at, lo, hi, size = lane[live], at[live], lo[live], hi[live], size[live]
        return out
