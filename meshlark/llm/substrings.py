"""Substring dedup by prefix-partitioned groups of suffixes (operator 10).

Suffixes begin at words. They are split into groups by word prefixes of variable length: prefixes of 1, 2, 4 ... words
are counted over the whole table (in hashed slots), a prefix with few enough suffixes makes a group, a more frequent one
is lengthened, up to ``min_words``; what is still larger than a task's share is dealt by the rest of its hash. All
suffixes that share ``min_words`` words thus meet in one group, of a size that fits a task's memory.

A suffix tree of a group would hang most suffixes from leaf edges above depth ``min_words``, where nothing is removed,
and the words of every suffix would have to travel to it, ``min_words`` times the text. So a suffix travels as the
fingerprint of its first ``min_words`` words. Sorted, runs of equal fingerprints are the nodes at that depth. Each node
yields its source, the least (doc_id, place) of its leaves, and hands it to the leaves of other documents. Along a document,
neighbouring leaves with one source at one distance join: that extends a node to the depth at which its leaf parts from
its source, a maximal repeat. Then the words themselves are compared: every repeat's words travel once, equal ones
collapsed, and must be a prefix of the words of its source. If one is not, fingerprints are drawn anew.

Before the shuffle each task settles what it can: of the leaves under one node in a chunk of text only those of the
chunk's smallest doc_id travel, the others join at once. So a passage that a third of all documents hold sends one
leaf for each chunk, not for each document.

Results for special input: null and empty texts have no words and keep none; a null doc_id ranks above all others, and
neither rows of null doc_id nor rows of one doc_id remove words of each other; rows that agree in doc_id and text are
treated alike; texts shorter than ``min_words`` keep all words; texts of any length are taken whole; an empty table
gives no rows; further columns are ignored (``dedup``) or kept as they are (``cut``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlark.llm.packing import COUNTS, count_rows, pack, partition_keys, sum_counts, unpack, unzigzag, zigzag
from meshlark.llm.scratch import Scratch, by_place, pick, place_of, released, tasks_for
from meshlark.llm.words import Words, mix, scan

MIN_WORDS = 50
#: Slots of a count table: 64 for each task, between these bounds.
LEAST_SLOTS, MOST_SLOTS, CHUNK = 1 << 13, 1 << 19, 1 << 10
#: Draws of the fingerprints before the operator gives up.
DRAWS = 8
#: Bytes of input text for one group.
GROUP_BYTES = 32 << 20
#: Tasks that gather the ranges of documents.
MOST_GATHERING = 1 << 12
#: A null doc_id's rank, above all others.
LAST = np.iinfo(np.int64).max
#: Bit of a row's tag that says that its doc_id is null; the bits below are of the text's hash.
NULL_TAG = 1 << 32


def prefix_lengths(min_words: int) -> list[int]:
    return [1 << k for k in range(min_words.bit_length()) if 1 << k < min_words] + [min_words]


def _slot(names: np.ndarray, slots: int) -> np.ndarray:
    return (names >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)


def prefix_names(hashes: np.ndarray, min_words: int) -> list[np.ndarray]:
    """For each prefix length but the last a name of that prefix at each word; equal prefixes have equal names."""
    out = [mix(hashes, 1)]
    for length in prefix_lengths(min_words)[1:-1]:
        further = np.zeros_like(hashes)
        further[: -(length // 2)] = out[-1][length // 2 :]
        out.append(mix(out[-1] * np.uint64(0x9E3779B97F4A7C15) + further))
    return out[: len(prefix_lengths(min_words)) - 1]


def prefix_counts(texts: DataFrame, min_words: int, slots: int = LEAST_SLOTS, seed: int = 0) -> np.ndarray:
    """How many suffixes of at least ``min_words`` words begin with the prefixes of each slot, for each prefix length."""
    lengths = prefix_lengths(min_words)

    def run(batches):
        total = np.zeros((len(lengths), slots), np.int64)
        for batch in batches:
            for _, _, words in scan(batch.column("text")):
                at, hashes = words.places(min_words), words.hashes(seed)
                for k, names in enumerate(prefix_names(hashes, min_words)):
                    total[k] += np.bincount(_slot(names[at], slots), minlength=slots)
                whole = mix(words.runs(min_words, seed, hashes).of(at, at + min_words))
                total[-1] += np.bincount(_slot(whole, slots), minlength=slots)
        yield count_rows(total.ravel(), CHUNK)

    return sum_counts(texts.select("text").mapInArrow(released(run), COUNTS), len(lengths) * slots, CHUNK).reshape(len(lengths), slots)


class Groups:
    """Which partition a suffix goes to."""

    def __init__(self, counts: np.ndarray, partitions: int, min_words: int):
        self.min_words, self.partitions, self.slots = min_words, partitions, counts.shape[1]
        total = int(counts[0].sum())
        # a group is at most an eighth of a task's share, or where there are more tasks than slots tell apart, twice a mean slot
        most = max(1, total // (8 * partitions), 2 * total // self.slots)
        self.settled = counts <= most
        self.settled[-1] = True
        self.spread = np.maximum(1, -(-counts // max(1, total // partitions))).astype(np.int32)
        # Counts of longer prefixes include suffixes that a shorter one has settled; as slots mix many prefixes, the
        # share that is left is taken as equal for all slots of a length. Groups then fill partitions in turn.
        size, left = np.zeros(counts.shape), 1.0
        for k in range(len(counts)):
            size[k] = np.where(self.settled[k], counts[k] * left, 0)
            left *= 1 - float(counts[k][self.settled[k]].sum()) / max(1, total)
        begin = np.concatenate([[0.0], np.cumsum(size.ravel())[:-1]])
        self.first = np.minimum(partitions - 1, begin * partitions / max(1.0, size.sum())).astype(np.int32).reshape(counts.shape)

    def of(self, names: list[np.ndarray], at: np.ndarray, whole: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(at), np.int64), np.arange(len(at))
        for k, settled in enumerate(self.settled):
            slot = _slot(whole[todo] if k == len(names) else names[k][at[todo]], self.slots)
            done = settled[slot]
            own, slot = todo[done], slot[done]
            out[own] = self.first[k][slot] + (whole[own] & np.uint64(0xFFFFFFFF)).astype(np.int64) % self.spread[k][slot]
            todo = todo[~done]
            if not len(todo):
                break
        return out % self.partitions


def _chains(row, at, source, place, length: int):
    """Joins windows ``at`` of ``row`` with their ``source`` row and ``place`` (sorted by row and at) into maximal repeats."""
    if not len(row):
        return row, at, at, source, place
    on = (row[1:] == row[:-1]) & (source[1:] == source[:-1]) & (at[1:] - at[:-1] == place[1:] - place[:-1]) & (at[1:] <= at[:-1] + length) & (at[1:] > at[:-1])
    begin = np.flatnonzero(np.concatenate([[True], ~on]))
    end = np.append(begin[1:], len(row)) - 1
    return row[begin], at[begin], at[end] + length, source[begin], place[begin]


def _dealt(doc: np.ndarray, tag: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray, source: np.ndarray, place: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """Repeats of rows (doc, tag) as blobs for the tasks that gather them by document; sources are rows too."""
    to = (mix(doc.view(np.uint64) ^ mix(tag.astype(np.uint64), 1)) % np.uint64(len(keys))).astype(np.int64)[row]
    order = np.argsort(to, kind="stable")
    to, row, begin, end, source, place = (x[order] for x in (to, row, begin, end, source, place))
    cut = np.append(np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])), len(to)) if len(to) else np.zeros(1, np.int64)
    blobs = []
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        used, own = np.unique(np.concatenate([row[i:j], source[i:j]]), return_inverse=True)
        blobs.append(pack(zigzag(doc[used]), tag[used], own[: j - i], begin[i:j], end[i:j], own[j - i :], place[i:j]))
    return pa.RecordBatch.from_arrays([pa.array(keys[to[cut[:-1]]]), pa.array(blobs, pa.binary())], ["part", "ranges"])


REPEATS = "doc_id long, tag long, begins array<int>, ends array<int>, repeats array<struct<begin:int,end:int,source:long,source_tag:long,place:int>>"


def _gather(batches):
    """From the blobs of ``_dealt`` each document's repeats and the disjoint ascending ranges that they cover."""
    blobs = [unpack(blob) for batch in batches for blob in batch.column("ranges").to_pylist()]
    if not blobs:
        return
    doc, tag, row, begin, end, source, place = zip(*blobs, strict=True)
    base = np.cumsum([0, *map(len, doc)])[:-1].tolist()
    row, source = (np.concatenate([r.astype(np.int64) + n for r, n in zip(x, base, strict=True)]) for x in (row, source))
    all_doc, all_tag = unzigzag(np.concatenate(doc)), np.concatenate(tag).astype(np.int64)
    doc, tag, from_doc, from_tag = all_doc[row], all_tag[row], all_doc[source], all_tag[source]
    begin, end, place = (np.concatenate(x).astype(np.int64) for x in (begin, end, place))
    del blobs, row, source
    # repeats with one source at one distance join where they touch
    order = np.lexsort((begin, place - begin, from_tag, from_doc, tag, doc))
    doc, tag, from_doc, from_tag, begin, end, place = (x[order] for x in (doc, tag, from_doc, from_tag, begin, end, place))
    same = lambda *columns: np.concatenate([[False], np.logical_and.reduce([x[1:] == x[:-1] for x in columns])])
    at, far = _merged(~same(doc, tag, from_doc, from_tag, place - begin), begin, end)
    doc, tag, from_doc, from_tag, begin, end, place = *(x[at] for x in (doc, tag, from_doc, from_tag, begin)), far, place[at]
    order = np.lexsort((begin, tag, doc))
    doc, tag, from_doc, from_tag, begin, end, place = (x[order] for x in (doc, tag, from_doc, from_tag, begin, end, place))
    first = ~same(doc, tag)
    at, far = _merged(first, begin, end)
    row = np.cumsum(first) - 1
    offsets = lambda x: pa.array(np.searchsorted(x, np.arange(row[-1] + 2)).astype(np.int32))
    ranges = [pa.ListArray.from_arrays(offsets(row[at]), pa.array(x.astype(np.int32))) for x in (begin[at], far)]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    found = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip((begin, end, from_doc, from_tag, place), kinds, strict=True)], ["begin", "end", "source", "source_tag", "place"])
    doc, tag = doc[first], tag[first]
    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=tag >= NULL_TAG), pa.array(tag), *ranges, pa.ListArray.from_arrays(offsets(row), found)], ["doc_id", "tag", "begins", "ends", "repeats"])


def _merged(first: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where unions of ranges that touch begin, and where they end; groups start at ``first``, each ascends by begin."""
    # running maximum of the ends within a group, by lifting each group above the one before
    lift = (np.cumsum(first) - 1) * (int(end.max()) + 1)
    far = np.maximum.accumulate(end + lift)
    new = first.copy()
    new[1:] |= begin[1:] + lift[1:] > far[:-1]
    at = np.flatnonzero(new)
    return at, (far - lift)[np.append(at[1:], len(far)) - 1]


def _sources(whole: np.ndarray, doc: np.ndarray, tag: np.ndarray, row_of, inner_of):
    """For leaves whose fingerprint a smaller doc_id has too: leaf, row, place in it, source's row and place; by row and place.

    ``row_of`` and ``inner_of`` give leaves' rows and places, so that they are made for leaves under nodes only.
    """
    order = np.argsort(whole)
    name = whole[order]
    same = name[1:] == name[:-1]
    deep = np.zeros(len(order), bool)
    deep[1:] |= same
    deep[:-1] |= same
    order, name = order[deep], name[deep]
    if not len(order):
        return (order,) * 5
    row, inner = row_of(order), inner_of(order)
    by = np.lexsort((inner, tag[row], doc[row], name))
    name, row, inner, leaf = name[by], row[by], inner[by], order[by]
    new = np.concatenate([[True], name[1:] != name[:-1]])
    least = np.flatnonzero(new)[np.cumsum(new) - 1]
    hit = doc[row] > doc[row[least]]
    row, inner, leaf, source, place = row[hit], inner[hit], leaf[hit], row[least][hit], inner[least][hit]
    by = np.lexsort((inner, row))
    return leaf[by], row[by], inner[by], source[by], place[by]


def _leaves(words: Words, doc: np.ndarray, tag: np.ndarray, groups: Groups, seed: int) -> tuple[list[tuple[int, bytes]], bytes | None]:
    """Of one chunk of text: a blob of leaves for each group, and a blob of the repeats settled here."""
    length = groups.min_words
    hashes, at = words.hashes(seed), words.places(groups.min_words)
    whole = mix(words.runs(length, seed, hashes).of(at, at + length))
    row = np.searchsorted(words.first, at, "right") - 1
    inner = at - words.first[row]
    leaf, own, place, source, source_place = _sources(whole, doc, tag, row.__getitem__, inner.__getitem__)
    settled = None
    if len(leaf):
        own, begin, end, source, source_place = _chains(own, place, source, source_place, length)
        used, both = np.unique(np.concatenate([own, source]), return_inverse=True)
        settled = pack(np.array([1]), zigzag(doc[used]), tag[used], both[: len(own)], begin, end, both[len(own) :], source_place)
    keep = np.ones(len(at), bool)
    keep[leaf] = False
    at, whole, row, inner = at[keep], whole[keep], row[keep], inner[keep]
    group = groups.of(prefix_names(hashes, length), at, whole)
    order = np.argsort(group.astype(np.uint16 if groups.partitions < 1 << 16 else np.int64), kind="stable")
    group, whole, row, inner = group[order], whole[order], row[order], inner[order]
    cut = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group)) if len(group) else np.zeros(1, np.int64)
    blobs = []
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        own, place = row[i:j], inner[i:j]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        gap = np.diff(place, prepend=0)
        gap[first] = place[first]
        used = own[first]
        blobs.append((int(group[i]), pack(np.array([0]), zigzag(doc[used]), tag[used], np.diff(np.append(first, j - i)), gap, whole[i:j])))
    return blobs, settled


def repeats(rows: DataFrame, min_words: int = MIN_WORDS, seed: int = 0) -> DataFrame:
    """By fingerprints, for documents (doc_id, tag, text): their maximal repeats of documents of smaller doc_id, and the covered ranges."""
    partitions = tasks_for(rows.select("text"), GROUP_BYTES)
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (64 * partitions - 1).bit_length()))
    groups = Groups(prefix_counts(rows, min_words, slots, seed), partitions, min_words)
    keys, doc_keys = partition_keys(partitions), partition_keys(min(partitions, MOST_GATHERING))
    shared = rows.sparkSession.sparkContext.broadcast(groups)  # MOST_SLOTS entries at most for each prefix length

    def emit(batches):
        groups, n = shared.value, 0
        for batch in batches:
            doc_ids, tags = batch.column("doc_id").fill_null(LAST).to_numpy(), batch.column("tag").to_numpy()
            for i, j, words in scan(batch.column("text")):
                blobs, settled = _leaves(words, doc_ids[i:j], tags[i:j], groups, seed)
                if settled:
                    n += 1
                    blobs.append((hash((int(doc_ids[i]), n)) % partitions, settled))
                yield pa.RecordBatch.from_arrays([pa.array(keys[[g for g, _ in blobs]] if blobs else np.zeros(0, np.int32)), pa.array([b for _, b in blobs], pa.binary())], ["part", "leaves"])

    def collect(batches):
        docs, tags, counts, gaps, wholes = [], [], [], [], []
        for batch in batches:
            for blob in batch.column("leaves").to_pylist():
                settled, doc, tag, *rest = unpack(blob)
                if settled[0]:
                    own, begin, end, source, place = (x.astype(np.int64) for x in rest)
                    yield _dealt(unzigzag(doc), tag.astype(np.int64), own, begin, end, source, place, doc_keys)
                    continue
                docs.append(unzigzag(doc)), tags.append(tag.astype(np.int64))
                for kept, x in zip((counts, gaps, wholes), (rest[0].astype(np.uint32), rest[1].astype(np.uint32), rest[2]), strict=True):
                    kept.append(x)
        if not docs:
            return
        doc, tag, count, gap, whole = np.concatenate(docs), np.concatenate(tags), np.concatenate(counts).astype(np.int64), np.concatenate(gaps), np.concatenate(wholes)
        del docs, tags, counts, gaps, wholes
        ends, total = np.cumsum(count), np.cumsum(gap, dtype=np.int64)
        before = np.concatenate([[0], total[ends[:-1] - 1]])
        row_of = lambda leaf: np.searchsorted(ends, leaf, "right")
        _, row, inner, source, place = _sources(whole, doc, tag, row_of, lambda leaf: total[leaf] - before[row_of(leaf)])
        if len(row):
            yield _dealt(doc, tag, *_chains(row, inner, source, place, min_words), doc_keys)

    leaves = rows.mapInArrow(released(emit), "part int, leaves binary").repartition(partitions, "part")
    dealt = leaves.mapInArrow(released(collect), "part int, ranges binary").repartition(len(doc_keys), "part")
    return dealt.mapInArrow(released(_gather), REPEATS)


def _spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """For each of a text's spans its words, a space behind each."""
    out = []
    for text, own in zip(texts.cast(pa.large_binary()), spans.to_pylist(), strict=True):
        words = (text.as_py() or b"").split()
        out.append([b" ".join([*words[s["begin"] : s["end"]], b""]) for s in own])
    return pa.array(out, pa.list_(pa.binary()))


def _mistaken(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Repeats whose words are not those of their source."""
    each = found.select("doc_id", "tag", F.explode("repeats").alias("r"))
    wanted = each.groupBy(F.col("r.source").alias("doc_id"), F.col("r.source_tag").alias("tag"), F.col("r.place").alias("place")).agg(F.max(F.col("r.end") - F.col("r.begin")).alias("n"))
    wanted = wanted.groupBy("doc_id", "tag").agg(F.collect_list(F.struct(F.col("place").alias("begin"), (F.col("place") + F.col("n")).alias("end"))).alias("sources"))  # a span for each word of the text at most
    asked = found.select("doc_id", "tag", "repeats").join(wanted.hint("merge"), (found.doc_id.eqNullSafe(wanted.doc_id)) & (found.tag == wanted.tag), "full")
    asked = asked.select(F.coalesce(found.doc_id, wanted.doc_id).alias("_id"), F.coalesce(found.tag, wanted.tag).alias("_tag"), "repeats", "sources")
    texts = rows.join(asked.hint("shuffle_hash"), rows.doc_id.eqNullSafe(F.col("_id")) & (rows.tag == F.col("_tag")))
    spans_of = F.arrow_udf(_spans, T.ArrayType(T.BinaryType()))
    empty = lambda c: F.coalesce(F.col(c), F.array())
    spans = F.concat(F.transform(empty("sources"), lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"))), F.transform(empty("repeats"), lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"))))
    of = F.concat(
        F.transform(empty("sources"), lambda s: F.struct(F.lit(True).alias("is_source"), F.col("_id").alias("source"), F.col("_tag").alias("source_tag"), s["begin"].alias("place"))),
        F.transform(empty("repeats"), lambda s: F.struct(F.lit(False).alias("is_source"), s["source"].alias("source"), s["source_tag"].alias("source_tag"), s["place"].alias("place"))),
    )
    texts = texts.select("text", spans.alias("spans"), of.alias("of"))
    parts = texts.select(F.explode(F.arrays_zip("of", spans_of("text", "spans").alias("words"))).alias("x")).select("x.of.*", "x.words").distinct()  # copies collapse in each task
    key = ["source", "source_tag", "place"]
    sources = parts.filter("is_source").select(*key, F.col("words").alias("source_words"))
    return parts.filter("not is_source").hint("merge").join(sources, key, "left").filter(~F.coalesce(F.startswith("source_words", "words"), F.lit(False))).select(*key)


def verified_repeats(rows: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """``repeats`` whose words have been compared with those of their sources."""
    for seed in range(DRAWS):
        found = scratch.write(repeats(rows, min_words, seed), "ranges")
        scratch.free_shuffles()
        if scratch.write(_mistaken(rows, found), "mistaken").isEmpty():
            return found
        scratch.drop(found)
    raise RuntimeError(f"different words agreed in a fingerprint in each of {DRAWS} draws")


def _cut(texts: pa.Array, begins: pa.Array, ends: pa.Array) -> pa.Array:
    """Each text's number of words, number of removed words and kept words joined by a space."""
    n_words, n_removed, kept = [], [], []
    for text, begin, end in zip(texts.cast(pa.large_binary()), begins, ends, strict=True):
        words = (text.as_py() or b"").split()
        n_words.append(len(words))
        if begin.is_valid:
            stay, at = [], 0
            for low, high in zip(begin.as_py(), end.as_py(), strict=True):
                stay += words[at:low]
                at = high
            words = stay + words[at:]
        n_removed.append(n_words[-1] - len(words))
        kept.append(b" ".join(words))
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "n_removed", "kept"])


CUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


def _tag(text: Column, doc_id: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(NULL_TAG - 1) + F.when(doc_id.isNull(), NULL_TAG).otherwise(0)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = pick(df, doc_id=id_col, text=text_col)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _tag(F.col("text"), F.col("doc_id")).alias("tag"))


def maximal_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, begin, end, source, place: words ``begin:end`` of a document are those of document ``source`` from word ``place``.

    A window's source is the least (doc_id, place) with its words in the chunk of text where that is settled, or else in
    the table; neighbouring windows with one source at one distance are one row. Which words are covered is the same for
    any layout of the table.
    """
    found = verified_repeats(_rows(df, id_col, text_col), Scratch(df.sparkSession, "substrings"), min_words)
    return found.select("doc_id", F.explode("repeats").alias("r")).select("doc_id", "r.begin", "r.end", "r.source", "r.place")


def cut(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, into: str = "_cut") -> DataFrame:
    """All columns of ``df``, by place, and a last column ``into``: n_words, n_removed and the kept words of each text.

    Ranges are joined to their documents by doc_id and tag; the table of ranges is on the build side, the texts stream.
    """
    scratch = Scratch(df.sparkSession, "substrings")
    found = verified_repeats(_rows(df, id_col, text_col), scratch, min_words)
    scratch.free_shuffles()
    found = found.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.col("begins").alias("_begins"), F.col("ends").alias("_ends"))
    flat = by_place(df)
    doc_id, text = flat[place_of(df, id_col)].cast("long"), flat[place_of(df, text_col)]
    joined = flat.join(found.hint("shuffle_hash"), doc_id.eqNullSafe(F.col("_id")) & (_tag(text, doc_id) == F.col("_tag")), "left")
    return joined.select(*[F.col(f"_in{i}").alias(n) for i, n in enumerate(df.columns)], F.arrow_udf(_cut, CUT)(text, F.col("_begins"), F.col("_ends")).alias(into))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) for each row."""
    out = cut(pick(df, doc_id=id_col, text=text_col), min_words=min_words)
    return out.select("doc_id", "_cut.n_words", "_cut.n_removed", "_cut.kept")
