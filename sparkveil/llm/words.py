"""Word and n-gram hashes of whole Arrow text columns in numpy, without a Python object a word.

A word is a run of bytes of a class; delimiters are ASCII, so that runs of UTF-8 bytes are runs of code points. A word's hash is a
polynomial over Z/2^64 in random byte values, finished by a mixer; that of n consecutive words is one over their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that are worked on at a time; a longer text is worked on alone.
PIECE = 1 << 18
_rng = np.random.default_rng(20_240_601)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_R, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_powers: dict[int, np.ndarray] = {}


def _class(delimiters: list[int]) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[delimiters] = False
    return out


#: Runs without white space, unchanged.
PLAIN = (_class([0x20, *range(0x09, 0x0E)]), _BYTE)
#: Runs of letters, digits and non-ASCII, A-Z lower-cased.
_lower = _BYTE.copy()
_lower[0x41:0x5B] = _BYTE[0x61:0x7B]
FOLDED = (_class([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), _lower)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, PIECE + 64)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        _powers[int(base)] = have = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of some texts: start and end are byte positions in `data`, first[d]:first[d+1] are the words of text d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind=PLAIN):
        self.data, self.offsets = data, offsets
        inside = kind[0][data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True  # texts end words
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(kind[1][data] * powers(_R, len(data)), dtype=np.uint64, out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * powers(_inverse(_R), len(data) + 1)[self.start]
        self.hash = mix(h + (self.end - self.start).astype(np.uint64))

    def grams(self, n: int) -> np.ndarray:
        """Hashes of n consecutive words, one for each start; runs over the ends of texts: see starts_of()."""
        h = self.hash
        if len(h) < n:
            return np.zeros(0, dtype=np.uint64)
        sums = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * powers(_Q, len(h)), dtype=np.uint64, out=sums[1:])
        return mix((sums[n:] - sums[:-n]) * powers(_inverse(_Q), len(h) + 1)[: len(h) - n + 1])

    def within(self, n: int) -> np.ndarray:
        """For each of grams(n): whether its words are of one text."""
        k = max(0, len(self.hash) - n + 1)
        out = np.ones(k, dtype=bool)
        for j in self.first[1:-1] if n > 1 else ():
            out[max(0, j - n + 1) : min(j, k)] = False
        return out

    def text(self, i: int, j: int) -> bytes:
        """Bytes from word i to the end of word j - 1."""
        return self.data[self.start[i] : self.end[j - 1]].tobytes()

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of a string column, null as empty, cut between rows so that a piece has about `size` bytes at most."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = int(np.searchsorted(offs, offs[i] + size, side="right")) - 1
        j = min(max(j, i + 1), len(column))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
