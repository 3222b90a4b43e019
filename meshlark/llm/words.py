"""Vectorised scan of whole texts: words, word hashes and hashes of runs of words, straight on Arrow buffers.

A word is ``[^\\x20\\x09-\\x0D]+``. A hash is a polynomial over the prime 2**61 - 1 at a point drawn from a seed, so
different sequences of ``n`` items agree with a chance of ``n / 2**61`` whatever they look like; operators that cannot
live with that compare the words themselves afterwards and draw another point where a comparison fails. A run of any
length costs the same and equal runs always get equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLOCK = 1 << 19
_MASK = (1 << 64) - 1
PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + np.uint64((0x632BE59BD9B4E019 * (seed + 1)) & _MASK)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _reduce(x: np.ndarray) -> np.ndarray:
    """Any unsigned 64-bit numbers modulo the prime."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, through halves of 31 bits."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    return _reduce(np.uint64(2) * (a1 * b1) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half) + a0 * b0)


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``low + high * 2**32`` modulo the prime."""
    high = _reduce(high)
    return _reduce(_reduce(low) + (high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32)))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the seed's point and of its inverse, at least ``n`` of each."""
    if seed not in _powers or len(_powers[seed][0]) < n:
        point = int(mix(np.array([seed], np.uint64), 21)[0]) % (PRIME - (1 << 32)) + (1 << 32)
        tables = []
        for x in (point, pow(point, -1, PRIME)):
            out = np.ones(1, np.uint64)
            while len(out) < n:  # doubling: the next stretch is the last one times the power between them
                out = np.concatenate([out, times(out, np.uint64(pow(x, len(out), PRIME)))])
            tables.append(out)
        if len(_powers) > 8:
            _powers.clear()
        _powers[seed] = (tables[0], tables[1])
    return _powers[seed]


class Runs:
    """Prefix sums over a sequence of numbers below the prime; ``of`` gives the hash of any run of up to ``reach`` of them."""

    def __init__(self, values: np.ndarray, reach: int, seed: int = 0):
        n = len(values)
        self.up, self.down = _tables(min(n, _BLOCK) + reach + 1, seed)
        self.at, low, high = [], [], []
        size = 0
        for i in range(0, max(n, 1), _BLOCK):
            part = values[i : i + _BLOCK + reach]
            if part.dtype == np.uint8 and len(part) <= 1 << 22:  # bytes count from 1, so that no run is a multiple of another
                part, power = part.astype(np.uint64) + np.uint64(1), self.up[: len(part)]
                one, two = part * (power & np.uint64(0xFFFFFFFF)), part * (power >> np.uint64(32))
            else:
                part = part.astype(np.uint64) + np.uint64(part.dtype == np.uint8)
                product = times(part, self.up[: len(part)])
                one, two = product & np.uint64(0xFFFFFFFF), product >> np.uint64(32)
            for sums, x in ((low, one), (high, two)):
                total = np.zeros(len(x) + 1, np.uint64)
                np.cumsum(x, out=total[1:])
                sums.append(total)
            self.at.append(size)
            size += len(part) + 1
        self.low, self.high = (x[0] if len(x) == 1 else np.concatenate(x) for x in (low, high))
        self.at = np.array(self.at)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers below the prime, for ``starts[i]:ends[i]``."""
        block = starts // _BLOCK
        inner = starts - block * _BLOCK
        s = self.at[block] + inner
        e = s + (ends - starts)
        return times(_joined(self.low[e] - self.low[s], self.high[e] - self.high[s]), self.down[inner])


class Words:
    """The words of a few texts: ``starts`` and ``ends`` in ``data``; text ``i`` has words ``first[i]:first[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        word = ~_SEPARATOR[data]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        edge = np.unique(offsets)
        at = edge[edge < len(data)]
        begins[at] = word[at]
        at = edge[edge > 0] - 1
        ends[at] = word[at]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A number below the prime for each word."""
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):  # a block of bytes at a time, or one word if it is longer
            low = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.ends, low + _BLOCK, "right")))
            high = int(self.ends[j - 1])
            out[i:j] = Runs(self.data[low:high], max(0, high - low - _BLOCK), 2 * seed).of(self.starts[i:j] - low, self.ends[i:j] - low)
            i = j
        return out

    def runs(self, reach: int, seed: int = 0, hashes: np.ndarray | None = None) -> Runs:
        """Hashes of runs of up to ``reach`` words; ``hashes`` are those of the words, if they have been made."""
        return Runs(self.hashes(seed) if hashes is None else hashes, reach, 2 * seed + 1)

    def places(self, k: int) -> np.ndarray:
        """Words that begin a run of ``k`` words inside one text."""
        last = np.repeat(self.first[1:], self.counts)
        return np.flatnonzero(np.arange(k, len(self.starts) + k) <= last)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string or binary array, nulls as empty; no copy is made where there are no nulls."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces_of(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together, or one text if it is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def scan(column: pa.Array, lower: bool = False, most: int = 2 << 20) -> Iterator[tuple[int, int, Words]]:
    """Goes over the whole texts of an Arrow column a few megabytes at a time."""
    data, offsets = buffers(column)
    for i, j in pieces_of(offsets, most):
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
