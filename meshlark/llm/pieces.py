"""Texts as sequences of space-led units, each distinct unit encoded once for a worker and kept.

Byte-level pre-tokenizers never join what stands before a single space to what follows it: a match takes one space at
its start at most, and of a run of white space it leaves the last space to the word behind. So a text may be cut before
every space that a character other than white space follows, each cut-out unit encoded apart, and the ids put together.
A text with any other space (doubled, trailing, or before a line end) is encoded in one go.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: Distinct units a worker keeps before it forgets the rare ones; with their ids they take some 80 MB.
KEPT_UNITS = 400_000


class _Numbering(dict):
    """Numbers units in the order of their first look-up; ``fresh`` holds those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.fresh.append(unit)
        return n


class UnitEncoder:
    """``encode_new`` gets texts and returns all their ids, concatenated, and each one's number of ids."""

    def __init__(self, encode_new: Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]], most: int = KEPT_UNITS):
        self.encode_new, self.most = encode_new, most
        self.number = _Numbering()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at, self.size, self.odd = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, bool)
        self.hits = np.zeros(0, np.int64)
        self.used = 0

    def _learn(self) -> None:
        if not (fresh := self.number.fresh):
            return
        # a key that begins with a space is a text's first unit, which has none; all others stand for a space and the key
        ids, sizes = self.encode_new([k[1:] if k[:1] == " " else " " + k for k in fresh])
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.at) < len(self.number):
            self.at, self.size, self.odd = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.odd))
        self.ids[self.used : self.used + len(ids)] = ids
        low, high = len(self.number) - len(fresh), len(self.number)
        self.size[low:high] = sizes
        self.at[low:high] = self.used + np.cumsum(sizes) - sizes
        self.odd[low:high] = [not k or (k[:1] != " " and k[0].isspace()) for k in fresh]
        self.used += len(ids)
        fresh.clear()

    def _forget(self) -> None:
        """Keeps the units used most often, at most half of ``most``."""
        least = max(2, int(np.sort(self.hits)[-(self.most // 2)]) + 1)
        keep = np.flatnonzero(self.hits >= least)
        names = list(self.number)
        self.number = _Numbering()
        self.number.update((names[i], n) for n, i in enumerate(keep.tolist()))
        sizes = self.size[keep].astype(np.int64)
        take = np.repeat(self.at[keep] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        self.ids[: len(take)] = self.ids[take]
        self.used = len(take)
        self.at[: len(keep)], self.size[: len(keep)], self.odd[: len(keep)] = np.cumsum(sizes) - sizes, sizes, self.odd[keep]
        self.hits = self.hits[keep]

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the number of ids of each text."""
        if len(self.number) > self.most:
            self._forget()
        numbers, look = [], self.number.__getitem__
        for text in texts:
            units = text.split(" ")
            units[0] = " " + units[0]
            numbers.append(np.fromiter(map(look, units), np.int32, len(units)))
        self._learn()
        counts = np.array([len(x) for x in numbers], np.int64)
        flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        hits = np.bincount(flat, minlength=len(self.number))
        hits[: len(self.hits)] += self.hits
        self.hits = hits
        sizes = self.size[flat].astype(np.int64)
        ends = np.cumsum(sizes)
        take = np.repeat(self.at[flat] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        marks = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        ids, lengths = self.ids[take], np.diff(marks)
        odd = [i for i, own in enumerate(numbers) if self.odd[own].any()]
        if odd:
            parts = np.split(ids, marks[1:-1])
            own, sizes = self.encode_new([texts[i] for i in odd])
            for i, part in zip(odd, np.split(own, np.cumsum(sizes)[:-1]), strict=True):
                parts[i], lengths[i] = part, len(part)
            ids = np.concatenate(parts)
        return ids, lengths


_made: dict = {}


def kept(key: tuple, make: Callable):
    """One encoder for each key in a Python worker, which Spark reuses from task to task."""
    if key not in _made:
        _made[key] = make()
    return _made[key]
