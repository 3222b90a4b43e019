"""Byte-level BPE encoding and decoding (operator 9).

The pattern's matches are encoded apart. A match that is a token is done; the other distinct ones that a worker has not
met yet are put into matrices of equal padded width. In each round every row of a matrix merges its leftmost pair of
minimum rank, found through a hash table of all pairs that some token joins; rows are compacted by one place, and rows
without such a pair leave. A match longer than ``LONG`` bytes lies in a matrix of its own, row by row: each row knows its least pair, so a round
finds the leftmost pair of minimum rank by the rows. Such a round goes on to the further places of the same pair: the
rule takes them next, from left to right, as long as no merge makes a pair of lower rank, so the round ends with the
first merge that makes one. Instead of compaction, joined places are linked to the next one that is left.

Results for special input: a null text counts as an empty one and has no ids; texts of any length are encoded whole;
repeated rows each give a row; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from meshlark.llm.pieces import UnitEncoder, kept
from meshlark.llm.scratch import pick, released
from meshlark.llm.words import pieces_of

WIDTHS = (4, 8, 16, 32, 64, 128, 256, 512, 1024)
LONG = WIDTHS[-1]
NONE = np.iinfo(np.int32).max


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) to the joined token's rank: open addressing in numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        lefts, rights, joined = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = ranks.get(token[:cut])
                right = ranks.get(token[cut:]) if left is not None else None
                if right is not None:
                    lefts.append(left), rights.append(right), joined.append(rank)
        self.n = max(ranks.values(), default=0) + 1
        keys = np.array(lefts, np.int64) * self.n + np.array(rights, np.int64)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.wrap = (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        values = np.array(joined, np.int32)
        while len(todo):
            free = self.keys[slot[todo]] < 0
            ask = todo[free]
            self.keys[slot[ask]] = keys[ask]
            won = ask[self.keys[slot[ask]] == keys[ask]]
            self.values[slot[won]] = values[won]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.wrap

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The joined ranks, ``NONE`` for pairs that no token joins or where an id is negative."""
        keys = left.astype(np.int64) * self.n + right
        out = np.full(keys.shape, NONE, np.int32).ravel()
        todo = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        keys = keys.ravel()[todo]
        slot = self._slot(keys)
        while len(todo):
            there = self.keys[slot]
            hit = there == keys
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there >= 0)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & self.wrap
        return out.reshape(left.shape)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token

    def merge_matrix(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges rows padded with -1 until no pair joins; returns the rows and their lengths."""
        out, lengths = ids.copy(), (ids >= 0).sum(1)
        rows, ranks = np.arange(len(ids)), self.pairs.look_up(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            on = best < NONE
            if not on.all():
                out[rows[~on]] = ids[~on]
                rows, ids, ranks, at, best = rows[on], ids[on], ranks[on], at[on], best[on]
                if not len(rows):
                    break
            lengths[rows] -= 1
            n, width = ids.shape
            each = np.arange(n)
            # compaction: what stands right of the merged pair moves one place to the left
            source = np.arange(width)[None, :] + (np.arange(width)[None, :] > at[:, None])
            ids = np.take_along_axis(np.concatenate([ids, np.full((n, 1), -1, np.int32)], 1), source, 1)
            ids[each, at] = best
            source = source[:, : width - 1]
            ranks = np.take_along_axis(np.concatenate([ranks, np.full((n, 1), NONE, np.int32)], 1), source, 1)
            before = np.maximum(at - 1, 0)
            left = np.where(at > 0, ids[each, before], -1)
            after = np.minimum(at + 1, width - 1)
            right = np.where(at + 1 < width, ids[each, after], -1)
            fresh = self.pairs.look_up(np.stack([left, best]), np.stack([best, right]))
            has = at > 0
            ranks[each[has], at[has] - 1] = fresh[0][has]
            has = at < width - 1
            ranks[each[has], at[has]] = fresh[1][has]
        return out, lengths

    def merge_long(self, piece: np.ndarray, width: int = 512) -> np.ndarray:
        """The merges of one sequence of ids of any length."""
        n = len(piece)
        size = -(-(n + 1) // width) * width
        ids = np.full(size, -1, np.int32)  # -1 behind the end and, through place -1, before the start
        ids[:n] = piece
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        after[-1] = size - 1
        ranks = np.full(size, NONE, np.int32)
        ranks[: n - 1] = self.pairs.look_up(ids[: n - 1], ids[1:n])
        rows, alive = ranks.reshape(-1, width), np.arange(size) < n
        least = rows.min(1)
        while (best := least.min()) < NONE:
            row = np.flatnonzero(least == best)
            y, x = np.nonzero(rows[row] == best)
            at = row[y] * width + x
            run = np.concatenate([[True], at[1:] != after[at[:-1]]])
            place = np.arange(len(at))
            at = at[(place - place[run][np.cumsum(run) - 1]) % 2 == 0]  # of places that overlap every second one, as from the left
            gone = after[at]
            left, right, joined = ids[before[at]], ids[after[gone]], np.full(len(at), best, np.int32)
            left[1:][at[1:] == after[gone[:-1]]] = best
            lower = np.minimum(self.pairs.look_up(left, joined), self.pairs.look_up(joined, right)) < best
            if lower.any():
                k = int(lower.argmax()) + 1
                at, gone = at[:k], gone[:k]
            ids[at] = best
            ranks[gone], alive[gone] = NONE, False
            after[at] = after[gone]
            before[after[at]] = at
            changed = np.concatenate([at, before[at][before[at] >= 0]])
            ranks[changed] = self.pairs.look_up(ids[changed], ids[after[changed]])
            touched = np.unique(np.concatenate([changed, gone]) // width)
            least[touched] = rows[touched].min(1)
        return ids[alive]

    def encode_pieces(self, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        found: list = [None] * len(raw)
        whole = [self.ranks.get(p) for p in raw]
        size = np.array([len(p) for p in raw], np.int64)
        sizes = np.ones(len(raw), np.int64)
        todo = np.array([w is None for w in whole], bool)
        low = 0
        for width in WIDTHS:
            at = np.flatnonzero(todo & (size > low) & (size <= width))
            for k in range(0, len(at), most := max(1, (1 << 20) // width)):
                part = at[k : k + most]
                ids = np.full((len(part), width), -1, np.int32)
                ids[np.arange(width)[None, :] < size[part][:, None]] = self.byte[np.frombuffer(b"".join([raw[i] for i in part]), np.uint8)]
                ids, n = self.merge_matrix(ids)
                sizes[part] = n
                for i, row, m in zip(part.tolist(), ids, n.tolist(), strict=True):
                    found[i] = row[:m]
            low = width
        for i in np.flatnonzero(todo & (size > LONG)).tolist():
            found[i] = self.merge_long(self.byte[np.frombuffer(raw[i], np.uint8)])
            sizes[i] = len(found[i])
        out = [w if (f := found[i]) is None else f for i, w in enumerate(whole)]
        return (np.concatenate([np.atleast_1d(x) for x in out]).astype(np.uint32) if out else np.zeros(0, np.uint32)), sizes

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class PatternBpe:
    """Texts to ids: each match of the pattern apart, each distinct match of a call merged once."""

    def __init__(self, bpe: ByteBpe, pattern: str):
        self.bpe, self.split = bpe, regex.compile(pattern).findall

    def __call__(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.split(text) for text in texts]
        number: dict[str, int] = {}
        flat = np.array([number.setdefault(p, len(number)) for pieces in found for p in pieces], np.int64)
        ids, sizes = self.bpe.encode_pieces(list(number))
        begin = np.cumsum(sizes) - sizes
        own = sizes[flat]
        ends = np.cumsum(own)
        take = np.repeat(begin[flat] - (ends - own), own) + np.arange(int(ends[-1]) if len(ends) else 0)
        marks = np.concatenate([[0], ends])[np.cumsum([0, *map(len, found)])]
        return ids[take], np.diff(marks)


def encoder(ranks_path: str, pattern: str) -> tuple[ByteBpe, UnitEncoder]:
    def make():
        bpe = ByteBpe(load_ranks(ranks_path))
        return bpe, UnitEncoder(PatternBpe(bpe, pattern))

    return kept(("byte_bpe", ranks_path, pattern), make)


def _coded(column: pa.Array, ranks_path: str, pattern: str, decode: bool) -> Iterator[tuple[np.ndarray, bytes | None]]:
    """Ids and decoded bytes for each text of an Arrow column, some megabytes of text at a time."""
    bpe, pieces = encoder(ranks_path, pattern)
    offsets = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    for i, j in pieces_of(offsets, 1 << 20):
        ids, counts = pieces.encode([x or "" for x in column.slice(i, j - i).to_pylist()])
        at = 0
        for n in counts.tolist():
            own = ids[at : at + n]
            at += n
            yield own, bpe.decode(own.tolist()) if decode else None


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``df``: doc_id, n_tokens, ids (array of int)."""

    def run(batches):
        for batch in batches:
            found = [ids for ids, _ in _coded(batch.column("text"), ranks_path, pattern, decode=False)]
            sizes = np.array([len(x) for x in found], np.int64)
            flat = pa.array(np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), lists], ["doc_id", "n_tokens", "ids"])

    rows = pick(df, doc_id=id_col, text=text_col)
    return rows.mapInArrow(released(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``df``: doc_id, n_tokens, SHA-256 of the ids (little-endian unsigned 32-bit) and of the bytes decoded from them."""

    def run(batches):
        for batch in batches:
            sizes, of_ids, of_bytes = [], [], []
            for ids, raw in _coded(batch.column("text"), ranks_path, pattern, decode=True):
                sizes.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = pick(df, doc_id=id_col, text=text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
