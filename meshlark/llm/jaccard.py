"""N-gram Jaccard self-join by rare-first prefix filtering (operator 3).

A document's set holds the hashes of its distinct word n-grams. Sets are ordered by how often an n-gram's slot of a fixed
count table occurs in all documents, rarest first; ties go by the hash, so the order is one for all documents. Two sets
of similarity ``t`` share an n-gram of their prefixes (the first ``n - ceil(t n) + 1``), and at the first that they
share the length and positional bounds hold. Equal sets are one class from the start; a class sends each prefix n-gram
once for a task, packed by target partition.

Classes that meet at an n-gram are candidates. Where up to ``SMALL`` meet, all their pairs are; where more meet, first
each with the two classes that hold the fewest rarer n-grams (a text has fewer than its edited copies), with the class of
least key and with its neighbour in the order of size. Once these links are
verified, components are known, and only pairs that lie in different components yet are compared as well, in pairs of
blocks that are dealt over tasks. So a large group of near copies costs a few pairs for each member, no n-gram's
members meet in one task, and no link between components is lost. Each candidate pair passes a suffix filter (counts of
both sets over fixed ranges of the hash space bound their Hamming distance from below) and is verified once, on the real
words of both documents: hashes find candidates but never decide a link. The words are fetched for the classes in such
pairs only; a bitmap tells the scan which documents may be among them, so only their texts are shuffled.

Equal sets share two 64-bit keys. Should two different sets agree in the first key alone, the join begins again with
hashes drawn anew.

Results for special input: null and empty texts have no set and link with nothing; fewer words than ``n`` form one gram;
rows of a null doc_id get their set's size, link with nothing and have no component; rows of one doc_id but different
texts are different documents; repeated rows are copies; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.components import components, hub_join
from meshlark.llm.packing import count_rows, pack, partition_keys, sum_counts, unpack
from meshlark.llm.scratch import Scratch, in_block_pairs, input_bytes, pick, released, tasks_for
from meshlark.llm.words import Words, buffers, mix, scan

N, PERCENT = 5, 75
#: Slots of the count table: one for so many bytes of text, between these bounds.
SLOT_BYTES, LEAST_SLOTS, MOST_SLOTS, CHUNK = 4096, 1 << 20, 1 << 24, 1 << 12
#: Ranges of the hash space whose counts the suffix filter compares.
RANGE_BITS = 8
RANGES = 1 << RANGE_BITS
SMALL = 8
#: Places of a prefix up to which a member carries the grams before; a pair first met beyond may be made more than once.
LISTED = 512
#: Bits of the map of documents whose words are fetched: eight for each class, between these bounds.
LEAST_WANTED, MOST_WANTED = 1 << 20, 1 << 27
PART_BYTES = 32 << 20
#: Bytes of text that a task hashes at once, unless one text is longer.
SCAN_BYTES = 1 << 20
BLOCK = 512
#: Members of a block of one n-gram while it has few blocks, and at most.
GRAM_BLOCK, MOST_GRAM_BLOCK = 512, 1 << 13
#: Draws of the hashes before the join gives up.
DRAWS = 8


def power_of_two(n: int, least: int, most: int) -> int:
    return min(most, max(least, 1 << max(0, n - 1).bit_length()))


def _spans(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of each n-gram, ascending, and its text; fewer words than ``n`` are one gram."""
    counts, at = words.counts, words.places(n)
    begin, length = at, np.full(len(at), n)
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        begin = np.concatenate([at, words.first[few]])
        length = np.concatenate([length, counts[few]])
        order = np.argsort(begin, kind="stable")
        begin, length = begin[order], length[order]
    return begin, length, np.searchsorted(words.first, begin, "right") - 1


class Sets:
    """The n-gram sets of a few texts: ``grams[first[i]:first[i + 1]]`` ascends and has no repeats."""

    def __init__(self, words: Words, n: int, seed: int):
        begin, length, row = _spans(words, n)
        grams = mix(words.runs(n, seed).of(begin, begin + length))
        first = np.searchsorted(row, np.arange(len(words) + 1))
        for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            grams[i:j].sort()
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
        self.grams, self.row = grams[new], row[new]
        self.first = np.searchsorted(self.row, np.arange(len(words) + 1))
        self.sizes = np.diff(self.first)
        self.keys, self.checks = self._sum(3), self._sum(13)

    def _sum(self, seed: int) -> np.ndarray:
        """A key of each set: a sum over its members, so one for equal sets whatever their order."""
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.grams, seed))])
        return mix(total[self.first[1:]] - total[self.first[:-1]] + self.sizes.astype(np.uint64), seed + 2).view(np.int64)

    def ranges(self) -> pa.Array:
        """A byte for each range and set; counts are cut at 255, which can only lower a distance."""
        cell = self.row * RANGES + (self.grams >> np.uint64(64 - RANGE_BITS)).astype(np.int64)
        counts = np.minimum(np.bincount(cell, minlength=len(self.sizes) * RANGES), 255).astype(np.uint8)
        return pa.Array.from_buffers(pa.binary(), len(self.sizes), [None, pa.py_buffer(np.arange(0, len(counts) + 1, RANGES, np.int32)), pa.py_buffer(counts)])

    def slots(self, size: int) -> np.ndarray:
        return (self.grams & np.uint64(size - 1)).astype(np.int64)


def _profile(rows: DataFrame, n: int, seed: int, slots: int) -> DataFrame:
    """Pass over all texts: (doc_id, text_hash, n, key, other, ranges) for each row; rows of chunk and counts for the count table."""

    def run(batches):
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for i, j, words in scan(batch.column("text"), lower=True, most=SCAN_BYTES):
                sets = Sets(words, n, seed)
                total += np.bincount(sets.slots(slots), minlength=slots)
                k = j - i
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, k), batch.column("text_hash").slice(i, k), pa.array(sets.sizes), pa.array(sets.keys), pa.array(sets.checks), sets.ranges(), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        counts = count_rows(total, CHUNK)
        k = counts.num_rows
        yield pa.RecordBatch.from_arrays([*[pa.nulls(k, pa.int64())] * 5, pa.nulls(k, pa.binary()), *counts.columns], names)

    names = ["doc_id", "text_hash", "n", "key", "other", "ranges", "chunk", "counts"]
    return rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(released(run), "doc_id long, text_hash long, n long, key long, other long, ranges binary, chunk int, counts binary")


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + (n > 0)


def least_overlap(total: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that two sets of ``total`` members together need."""
    return -(-percent * total // (100 + percent))


def fits(n1, at1, n2, at2, percent: int) -> np.ndarray:
    """Length and positional filters at the first n-gram that two prefixes share."""
    close = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
    return close & (1 + np.minimum(n1 - at1, n2 - at2) - 1 >= least_overlap(n1 + n2, percent))


def _range_matrix(column) -> np.ndarray:
    return buffers(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)[0].reshape(-1, RANGES)


def near_enough(ranges1: np.ndarray, ranges2: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """The suffix filter: whether the distance that the counts prove leaves room for the needed overlap."""
    on = np.zeros(len(total), bool)
    for i in range(0, len(total), 1 << 14):
        j = i + (1 << 14)
        apart = np.abs(ranges1[i:j].astype(np.int16) - ranges2[i:j]).sum(1, dtype=np.int64)
        on[i:j] = apart <= total[i:j] - 2 * least_overlap(total[i:j], percent)
    return on


def _emit(words: Words, known: np.ndarray, seen: set, counts: np.ndarray, n: int, percent: int, partitions: int, seed: int) -> list[tuple[int, bytes]]:
    """The prefix n-grams of the classes not yet seen in this task, packed by partition."""
    sets = Sets(words, n, seed)
    fresh = np.zeros(len(known), bool)
    for i, key in enumerate(sets.keys.tolist()):
        if known[i] and sets.sizes[i] and key not in seen:
            seen.add(key)
            fresh[i] = True
    rank = (np.minimum(counts[sets.slots(len(counts))], (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (sets.grams >> np.uint64(24))
    take, place, keep = [], [], prefix_size(sets.sizes, percent)
    for i in np.flatnonzero(fresh).tolist():
        low, high = sets.first[i], sets.first[i + 1]
        take.append(low + np.argsort(rank[low:high], kind="stable")[: keep[i]])
        place.append(np.arange(keep[i]))
    if not take:
        return []
    take, place = np.concatenate(take), np.concatenate(place)
    grams, row = sets.grams[take], sets.row[take]
    part = (mix(grams, 11) % np.uint64(partitions)).astype(np.int64)
    order = np.argsort(part.astype(np.uint16 if partitions < 1 << 16 else np.int64), kind="stable")
    part, grams, row, place = part[order], grams[order], row[order], place[order]
    bounds = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))
    out = []
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = row[i:j]
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        used = own[begin]
        out.append((int(part[i]), pack(sets.keys[used].view(np.uint64), sets.sizes[used], np.diff(np.append(begin, j - i)), grams[i:j], place[i:j])))
    return out


def _pairs_in_groups(key, size, place, first, percent: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Candidates among the members ``first[g]:first[g + 1]`` of each group, ascending by (size, key)."""
    left, right = [], []

    def add(a, b):
        on = fits(size[a], place[a], size[b], place[b], percent)
        left.append(a[on]), right.append(b[on])

    counts = np.diff(first)
    for k in range(2, SMALL + 1):
        at = first[:-1][counts == k]
        for i in range(k):
            for j in range(i + 1, k):
                add(at + i, at + j)
    for g in np.flatnonzero(counts > SMALL).tolist():
        own = np.arange(first[g], first[g + 1])
        # a class with few grams that are rarer than this one is near the text that the others are copies of
        for hub in (*own[np.lexsort((key[own], place[own]))[:2]], own[key[own].argmin()]):
            add(np.full(len(own) - 1, hub), own[own != hub])
        add(own[:-1], own[1:])
    return left, right


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return low[new], high[new]


def _meet(rows: DataFrame, counts: np.ndarray, n: int, percent: int, seed: int) -> DataFrame:
    """Second pass: candidate pairs (a, b) and the members (gram, a, n, place) of groups above ``SMALL``."""
    partitions = tasks_for(rows.select("text"), PART_BYTES)
    keys = partition_keys(partitions)
    shared = rows.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 32) - 1).astype(np.uint32))  # MOST_SLOTS numbers at most

    def emit(batches):
        seen: set = set()
        counts = shared.value
        for batch in batches:
            known = pa.compute.is_valid(batch.column("doc_id")).to_numpy(zero_copy_only=False)
            for i, j, words in scan(batch.column("text"), lower=True, most=SCAN_BYTES):
                blobs = _emit(words, known[i:j], seen, counts, n, percent, partitions, seed)
                yield pa.RecordBatch.from_arrays([pa.array(keys[[p for p, _ in blobs]] if blobs else np.zeros(0, np.int32)), pa.array([b for _, b in blobs], pa.binary())], ["part", "grams"])

    def meet(batches):
        blobs = [unpack(blob) for batch in batches for blob in batch.column("grams").to_pylist()]
        if not blobs:
            return
        key, size, count, gram, place = (np.concatenate(x) for x in zip(*blobs, strict=True))
        del blobs
        owner = np.repeat(np.arange(len(key)), count.astype(np.int64))
        order = np.argsort(gram)
        same = gram[order][1:] == gram[order][:-1]
        shared_ = np.zeros(len(order), bool)
        shared_[1:] |= same
        shared_[:-1] |= same
        order = order[shared_]
        gram, owner, place = gram[order], owner[order], place[order].astype(np.int64)
        key, size = key[owner].view(np.int64), size[owner].astype(np.int64)
        order = np.lexsort((key, size, gram))
        gram, key, size, place = gram[order], key[order], size[order], place[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])
        gram, key, size, place = gram[new], key[new], size[new], place[new]
        begin = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
        first = np.append(begin, len(gram))
        left, right = _pairs_in_groups(key, size, place, first, percent)
        if left:
            a, b = _unique_pairs(key[np.concatenate(left)], key[np.concatenate(right)])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.nulls(len(a), pa.int64())] * 3], names)
        large = np.repeat(np.diff(first) > SMALL, np.diff(first))
        if large.any():
            k = int(large.sum())
            yield pa.RecordBatch.from_arrays([pa.array(key[large]), pa.nulls(k, pa.int64()), pa.array(gram[large].view(np.int64)), pa.array(size[large]), pa.array(place[large])], names)

    names = ["a", "b", "gram", "n", "place"]
    packed = rows.mapInArrow(released(emit), "part int, grams binary").repartition(partitions, "part")
    return packed.mapInArrow(released(meet), "a long, b long, gram long, n long, place long")


def _earlier_matrix(lists: pa.ChunkedArray, at: np.ndarray) -> np.ndarray:
    """A row for each of the lists at ``at``, a column for each value that two of them hold: 1 where a list holds it."""
    own = lists.take(pa.array(at)).combine_chunks()
    own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
    size = pa.compute.list_value_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
    values, code, count = np.unique(own.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    column = (np.cumsum(count > 1) - 1)[code]
    out = np.zeros((len(at), int((count > 1).sum())), np.float32)
    out[np.repeat(np.arange(len(at)), size)[shared], column[shared]] = 1
    return out


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of members (gram, a, n, place, component, ranges, earlier) that meet but lie in different components.

    A pair is made at the first gram that both hold: ``earlier`` has a member's grams before this one.
    """

    def run(batches):
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        table = pa.Table.from_batches(own)
        group = np.stack([table.column(c).to_numpy() for c in ("gram", "i", "j")])
        ranges = _range_matrix(table.column("ranges"))
        block, a, size, place, comp = (table.column(c).to_numpy() for c in ("own", "a", "n", "place", "component"))
        order = np.lexsort((a, size, *group[::-1]))
        cut = [0, *(np.flatnonzero((group[:, order[1:]] != group[:, order[:-1]]).any(0)) + 1).tolist(), len(order)]
        for low, high in zip(cut[:-1], cut[1:], strict=True):
            part = order[low:high]  # ascends by size
            _, i, j = group[:, part[0]]
            left, right = (part, part) if i == j else (part[block[part] == i], part[block[part] == j])
            for k in range(0, len(left), BLOCK):
                x = left[k : k + BLOCK]
                # of fitting size; within one block a pair is made from its earlier side
                start = k if i == j else int(np.searchsorted(100 * size[right], percent * size[x[0]]))
                stop = int(np.searchsorted(percent * size[right], 100 * size[x[-1]], "right"))
                for m in range(start, stop, BLOCK):
                    y = right[m : min(stop, m + BLOCK)]
                    on = comp[x][:, None] != comp[y][None, :]
                    if i == j:
                        on &= np.arange(k, k + len(x))[:, None] < np.arange(m, m + len(y))[None, :]
                    on &= fits(size[x][:, None], place[x][:, None], size[y][None, :], place[y][None, :], percent)
                    p, q = np.nonzero(on)
                    if not len(p):
                        continue
                    close = near_enough(ranges[x[p]], ranges[y[q]], size[x[p]] + size[y[q]], percent)
                    p, q = p[close], q[close]
                    if len(p):
                        before = _earlier_matrix(table.column("earlier"), np.concatenate([x, y]))
                        if before.shape[1]:
                            new = (before[: len(x)] @ before[len(x) :].T == 0)[p, q]
                            p, q = p[new], q[new]
                    if len(p):
                        one, two = _unique_pairs(a[x[p]], a[y[q]])
                        yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], ["a", "b"])

    dealt = in_block_pairs(members, ["gram"], "a", GRAM_BLOCK, MOST_GRAM_BLOCK)
    return dealt.repartition("gram", "i", "j").mapInArrow(released(run), "a long, b long").distinct()


def _words_of(words: Words) -> pa.Array:
    """The words of each text, a space behind each."""
    out = np.full(int((words.ends - words.starts + 1).sum()), ord(" "), np.uint8)
    size = words.ends - words.starts
    at = np.cumsum(size + 1) - (size + 1)
    ends = np.cumsum(size)
    shift = np.repeat(np.arange(len(size)), size)  # a space for each word before
    out[np.arange(int(ends[-1]) if len(ends) else 0) + shift] = words.data[np.repeat(words.starts - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
    offsets = np.append(at, len(out))[words.first].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def exact_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """For texts as ``_words_of`` gives them: each one's distinct n-grams as numbers, equal for equal words only."""
    data, offsets = buffers(column)
    words = Words(data, offsets)
    if not len(words.starts):
        return [np.zeros(0, np.int64)] * len(words)
    ends = np.append(words.starts, len(data)).astype(np.int64)
    code = lambda x: x.dictionary_encode().indices.to_numpy().astype(np.int64)
    # 0 stands for no word, behind the words of a text with fewer than n
    word = np.append(code(pa.Array.from_buffers(pa.large_binary(), len(words.starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])) + 1, np.zeros(n, np.int64))
    begin, length, row = _spans(words, n)
    gram, kinds = word[begin], int(word.max()) + 1
    for k in range(1, n):
        if int(gram.max()) >= (1 << 62) // kinds:
            gram = code(pa.array(gram))
        gram = gram * kinds + np.where(k < length, word[begin + k], 0)
    gram = code(pa.array(gram))
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    return np.split(gram[new], np.searchsorted(row[new], np.arange(1, len(words))))


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, n: int, percent: int, seed: int, wanted_bits: int, scratch: Scratch) -> DataFrame:
    """The pairs of classes whose sets are similar enough, by their real words; those of pairs that pass the suffix filter are fetched."""
    side = lambda c: classes.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("ranges").alias(f"r_{c}"), F.col("doc").alias(f"doc_{c}"))
    both = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")

    def suffix(batches):
        for batch in batches:
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            on = near_enough(_range_matrix(batch.column("r_a")), _range_matrix(batch.column("r_b")), total, percent)
            yield batch.select(["a", "b", "doc_a", "doc_b"]).filter(pa.array(on))

    left = scratch.write(both.mapInArrow(suffix, "a long, b long, doc_a long, doc_b long"), "left")
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(wanted_bits))
    wanted = left.select(F.col("doc_a").alias("doc_id")).union(left.select("doc_b")).select(F.shiftright(bit, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int")).alias("x"))
    bits = np.zeros(wanted_bits // 64, np.int64)
    for r in wanted.groupBy("w").agg(F.bit_or("x").alias("x")).toLocalIterator():  # at most MOST_WANTED / 64 rows
        bits[r.w] = r.x
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def make(batches):
        seen: set = set()
        for batch in batches:
            at = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1) if len(at) else pa.array([], pa.bool_()))
            for _, _, words in scan(batch.column("text"), lower=True, most=SCAN_BYTES):
                sets = Sets(words, n, seed)
                fresh = np.array([k not in seen and not seen.add(k) for k in sets.keys.tolist()], bool)
                yield pa.RecordBatch.from_arrays([pa.array(sets.keys), _words_of(words)], ["key", "words"]).filter(pa.array(fresh))

    def compare(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                texts = pa.concat_arrays([part.column("w_a"), part.column("w_b")]).dictionary_encode()
                sets, at = exact_sets(texts.dictionary, n), texts.indices.to_numpy().reshape(2, -1).tolist()
                on = []
                for x, y in zip(*at, strict=True):
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    on.append(100 * common >= percent * (len(sets[x]) + len(sets[y]) - common))
                yield part.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    made = scratch.write(rows.filter("doc_id is not null").select("text", bit.alias("bit")).mapInArrow(released(make), "key long, words binary"), "words")
    one, two = (made.groupBy(F.col("key").alias(c)).agg(F.first("words").alias(f"w_{c}")) for c in "ab")
    # pairs grow with the data, so they are merged, never broadcast
    compared = left.select("a", "b").hint("merge").join(one, "a").hint("merge").join(two, "b").select("a", "b", "w_a", "w_b")
    links = scratch.write(compared.mapInArrow(released(compare), "a long, b long"), "links")
    scratch.drop(left, made)
    scratch.free_shuffles()
    return links


def join(df: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_key (one for equal sets) and text_hash (``xxhash64`` of the text) for every row."""
    scratch = Scratch(df.sparkSession, "jaccard")
    rows = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    slots = power_of_two(min(input_bytes(rows), SLOT_BYTES * MOST_SLOTS) // SLOT_BYTES, LEAST_SLOTS, MOST_SLOTS)
    for seed in range(DRAWS):
        profile = scratch.write(_profile(rows, n, seed, slots), "profile")
        docs = profile.filter("chunk is null").select("doc_id", "text_hash", "n", "key", "other", "ranges")
        classes = docs.filter("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("ranges").alias("ranges"), (F.min("other") != F.max("other")).alias("mixed"))
        classes = scratch.write(classes, "classes")
        if classes.filter("mixed").isEmpty():
            return _linked(scratch, rows, profile, docs, classes, n, percent, seed, slots)
        scratch.drop(profile, classes)
    raise RuntimeError(f"different sets agreed in a 64-bit key in each of {DRAWS} draws")


def _linked(scratch: Scratch, rows: DataFrame, profile: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int, seed: int, slots: int) -> DataFrame:
    counts = sum_counts(profile.filter("chunk is not null").select("chunk", "counts"), slots, CHUNK)
    wanted_bits = power_of_two(8 * classes.count(), LEAST_WANTED, MOST_WANTED)
    verified = lambda pairs: _verified(pairs, classes, rows, n, percent, seed, wanted_bits, scratch)
    met = scratch.write(_meet(rows, counts, n, percent, seed), "met")
    scratch.free_shuffles()
    pairs = scratch.write(met.filter("b is not null").select("a", "b").distinct(), "pairs")
    links = verified(pairs)
    found = scratch.write(components(links, scratch), "components")
    members = met.filter("gram is not null").select("a", "gram", "n", "place").join(found.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    members = scratch.write(members, "members")
    mixed = members.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("gram")
    mixed = members.join(mixed, "gram").join(classes.select(F.col("key").alias("a"), "ranges"), "a")
    held = members.groupBy("a").agg(F.collect_list(F.struct("place", "gram")).alias("held"))  # part of a class's own prefix
    earlier = F.transform(F.filter("held", lambda x: x["place"] < F.col("place")), lambda x: x["gram"])
    earlier = F.when(F.col("place") < LISTED, earlier).otherwise(F.array().cast("array<bigint>"))
    mixed = mixed.join(held, "a").withColumn("earlier", earlier).drop("held")
    more = scratch.write(_across(mixed, percent).join(pairs, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        links = links.union(verified(more))
        found = scratch.write(components(links, scratch), "components")
    of_linked = classes.select("key", "doc").join(found.withColumnRenamed("node", "key"), "key")
    least = of_linked.groupBy("component").agg(F.min("doc").alias("least"), F.count("*").alias("n"))
    of_class = hub_join(of_linked, least, "component", found.count()).select("key", F.col("least").alias("component_id"))
    of_class = of_class.union(classes.select("key", "doc").join(found.select(F.col("node").alias("key")), "key", "left_anti"))
    of_class = scratch.write(of_class, "result")
    scratch.drop(classes, met, pairs, found, members, more)
    linked = docs.filter("n > 0 and doc_id is not null").join(of_class, "key")
    alone = docs.filter("n = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("key").alias("class_key"), "text_hash"]
    return linked.select(*columns).union(alone.select(*columns))
