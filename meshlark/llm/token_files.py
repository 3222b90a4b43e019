"""Flat token-id files: writing with document offsets (operator 2) and counting in unindexed ones (operator 1).

A part is a file of unsigned integers, 16 bits wide where the vocabulary allows it and 32 otherwise, little endian. Its
index file holds, after a header, the part's 64-bit document offsets and document ids. Both are memory-mapped to read.
The parts' bases are prefix sums of their sizes, so a part is written without knowing any other.

Every attempt of a task writes under a name of its own and Spark commits the row that names it; files of lost or
repeated attempts are never named in the manifest.

Results for special input: null texts count as empty, so only the end id is written; a null doc_id sorts last and is
read back as null; rows of equal doc_id follow one another in the order of a hash of their texts; an empty table gives
no parts and no rows; further columns are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Sequence
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlark.llm.pieces import kept
from meshlark.llm.scratch import Scratch, pick, released, tasks_for
from meshlark.llm.words import pieces_of

MAGIC = b"MLTOKEN1"
HEADER = struct.Struct("<8sQQQ")
#: Ids in one block of a separator scan.
BLOCK_IDS = 4 << 20
#: Bytes of input text for one part.
PART_BYTES = 64 << 20

# ---------------------------------------------------------------- shared files


def local_path(path: str) -> str | None:
    at = urlparse(path)
    return at.path if at.scheme in ("", "file") else None


def create(path: str):
    """A file in the shared folder, open for writing; folders are made as needed."""
    if (own := local_path(path)) is not None:
        os.makedirs(os.path.dirname(own), exist_ok=True)
        return open(own, "wb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    return store.open_output_stream(inner)


def mapped(path: str, kind, offset: int = 0, count: int | None = None) -> np.ndarray:
    """A memory-mapped array; a store that cannot be mapped is read."""
    if (own := local_path(path)) is not None:
        there = (os.path.getsize(own) - offset) // np.dtype(kind).itemsize
        n = there if count is None else count
        return np.asarray(np.memmap(own, kind, "r", offset, (n,))) if n else np.zeros(0, kind)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as f:
        f.seek(offset)
        return np.frombuffer(f.read() if count is None else f.read(count * np.dtype(kind).itemsize), kind)


# ---------------------------------------------------------------- encoding with the tokenizers library


#: How the library's ``ByteLevel`` splits a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Up to 16 words of letters and ASCII without apostrophes, single spaces between them, that end before white space or with the text.
STRETCH = r"(?>(?:(?> ?[!-&(-~\p{L}]+)(?=\s|\z)){1,16})"
#: Of bytes (as characters below 256): those of a stretch, where bytes from 128 on are letters'; those of one of its pieces; a character.
_OF_STRETCH, _OF_PIECE = re.compile(r"[ !-&(-~\x80-\xff]+"), re.compile(r" |(?: ?(?:[A-Za-z\x80-\xff]+|[0-9]+|[!-&(-/:-@\[-`{-~]+))")
_CHARACTER = re.compile(r"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _lies_across(token: str) -> bool:
    """Whether a token's bytes (as characters below 256) can lie in a stretch and reach over the end of a piece in it."""
    if _OF_PIECE.fullmatch(token) or not _OF_STRETCH.fullmatch(token) or "  " in token:
        return False
    found = "".join(_CHARACTER.findall(token)).encode("latin-1").decode("utf-8", "ignore")
    return not any(unicodedata.category(c)[0] in "PSZ" or unicodedata.category(c) == "Cf" for c in found)  # as a stretch has no such character


def byte_letters() -> dict[str, int]:
    """The letter that ``ByteLevel`` writes for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def with_stretches(tokenizer: dict) -> dict | None:
    """A tokenizer file that gives every text the same ids for less work; ``None`` if that is not certain.

    ``ByteLevel`` makes an object for each word, then writes its bytes as letters. Here pieces are whole stretches of
    words. A stretch begins and ends where ``ByteLevel`` splits too, and no token lies across a split within it, which is
    looked up in the vocabulary; so no merge can cross one, and the merges on its sides do not change each other. Bytes
    keep their numbers, only their names change: ASCII stands for itself and other bytes for the library's ``<0xNN>``,
    which it takes for characters that are no token.
    """
    model, splits = tokenizer["model"], tokenizer["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or tokenizer["normalizer"] or (splits.get("type"), splits.get("add_prefix_space"), splits.get("use_regex", True)) != ("ByteLevel", False, True):
        return None
    byte = byte_letters()
    if not byte.keys() <= model["vocab"].keys() or not all(byte.keys() >= set(token) for token in model["vocab"]):
        return None
    if any(_lies_across("".join(chr(byte[letter]) for letter in token)) for token in model["vocab"]):
        return None

    def renamed(token: str) -> str:
        return "".join(chr(b) if b < 128 else f"<0x{b:02X}>" for b in map(byte.__getitem__, token))

    vocab = {renamed(token): i for token, i in model["vocab"].items()}
    if len(vocab) < len(model["vocab"]):  # two tokens of one name, as where a token spells "<0xC3>"
        return None
    merges = [[renamed(x) for x in (m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    split = {"type": "Split", "pattern": {"Regex": f"{STRETCH}|{BYTE_LEVEL}"}, "behavior": "Isolated", "invert": False}
    return tokenizer | {"pre_tokenizer": split, "model": model | {"vocab": vocab, "merges": merges, "byte_fallback": True}}


class LibraryEncoder:
    """Ids that ``tokenizers`` gives whole texts, some texts at once."""

    def __init__(self, path: str, special_as_text: bool):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            lighter = with_stretches(json.load(f))
        self.tokenizer = Tokenizer.from_str(json.dumps(lighter)) if lighter else Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def encode(self, texts: Sequence[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the number of ids of each text; ``end_id`` follows each text."""
        ids, sizes, low = [], np.zeros(len(texts), np.int64), 0
        while low < len(texts):  # a few hundred short texts or one long text at once
            high, n = low, 0
            while high < len(texts) and n < 1 << 16:
                n += len(texts[high])
                high += 1
            flat = array("I")
            for i, e in enumerate(self.tokenizer.encode_batch_fast(texts[low:high], add_special_tokens=False), low):
                before = len(flat)
                flat.fromlist(e.ids)
                if end_id is not None:
                    flat.append(end_id)
                sizes[i] = len(flat) - before
            ids.append(np.array(flat, np.uint32))
            low = high
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), sizes


def library_encoder(path: str, special_as_text: bool = False) -> LibraryEncoder:
    return kept(("library", path, special_as_text), lambda: LibraryEncoder(path, special_as_text))


class PartWriter:
    """Writes the ids of documents in their order, and the index at the end."""

    def __init__(self, folder: str, encoder: LibraryEncoder, end_id: int, index: bool):
        self.part = TaskContext.get().partitionId()
        name = f"{folder}/part-{self.part:06d}-{uuid.uuid4().hex[:12]}"
        self.tokens_path, self.index_path = f"{name}.ids", f"{name}.idx" if index else None
        self.encoder, self.end_id = encoder, end_id
        self.kind = np.dtype("<u2" if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else "<u4")
        self.file = create(self.tokens_path)
        self.sizes, self.doc_ids, self.known = [], [], []

    def add(self, doc_ids: pa.Array, texts: pa.Array) -> None:
        lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for i, j in pieces_of(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), 1 << 20):
            ids, sizes = self.encoder.encode([x or "" for x in texts.slice(i, j - i).to_pylist()], self.end_id)
            self.file.write(ids.astype(self.kind).tobytes())
            self.sizes.append(sizes)
        if self.index_path:  # copied, as a slice would hold its whole batch in memory
            self.doc_ids.append(doc_ids.cast(pa.int64()).fill_null(0).to_numpy().copy())
            self.known.append(pa.compute.is_valid(doc_ids).to_numpy(zero_copy_only=False).astype(np.uint8))

    def close(self) -> dict:
        self.file.close()
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
        if self.index_path:
            with create(self.index_path) as f:
                f.write(HEADER.pack(MAGIC, self.kind.itemsize, len(sizes), int(offsets[-1])))
                f.write(offsets.tobytes())
                for x in (*self.doc_ids, *self.known):
                    f.write(x.tobytes())
        return {"part": self.part, "n_docs": len(sizes), "n_ids": int(offsets[-1]), "width": self.kind.itemsize, "tokens_path": self.tokens_path, "index_path": self.index_path}


MANIFEST = "part int, n_docs long, n_ids long, width int, tokens_path string, index_path string"


def write_indexed(df: DataFrame, tokenizer_path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents in ascending doc_id order; returns the plan of the manifest, which writes when it runs."""
    rows = pick(df, doc_id=id_col, text=text_col)
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(tasks_for(rows, PART_BYTES), *order).sortWithinPartitions(*order)

    def run(batches):
        writer = None
        for batch in batches:
            if batch.num_rows:
                writer = writer or PartWriter(folder, library_encoder(tokenizer_path), end_id, index=True)
                writer.add(batch.column("doc_id"), batch.column("text"))
        if writer:
            yield pa.RecordBatch.from_pylist([writer.close()], _arrow(MANIFEST))

    return rows.mapInArrow(released(run), MANIFEST)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


class TokenPart:
    """Random access to one part's documents."""

    def __init__(self, tokens_path: str, index_path: str):
        magic, width, self.n_docs, self.n_ids = HEADER.unpack(mapped(index_path, np.uint8, 0, HEADER.size).tobytes())
        if magic != MAGIC:
            raise ValueError(f"{index_path} is no index")
        self.ids = mapped(tokens_path, "<u2" if width == 2 else "<u4")
        if len(self.ids) != self.n_ids:
            raise ValueError(f"{tokens_path} holds {len(self.ids)} ids; its index has {self.n_ids}")
        at = HEADER.size
        self.offsets = mapped(index_path, "<u8", at, self.n_docs + 1)
        at += 8 * (self.n_docs + 1)
        self.doc_ids = mapped(index_path, "<i8", at, self.n_docs)
        self.known = mapped(index_path, np.uint8, at + 8 * self.n_docs, self.n_docs)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[int(self.offsets[i]) : int(self.offsets[i + 1])]


def with_bases(manifest: DataFrame) -> list[tuple]:
    """(tokens_path, index_path, base): a row for each part in the parts' order; the bases are prefix sums of n_ids."""
    base, out = 0, []
    for r in sorted(manifest.collect(), key=lambda r: r.part):  # a row for each written part, no document data
        out.append((r.tokens_path, r.index_path, base))
        base += r.n_ids
    return out


def read_indexed(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """From the files: doc_id, start, n_tokens and the CRC-32 of each document's ids as little-endian 32-bit integers."""
    parts = with_bases(manifest)
    table = spark.createDataFrame(parts, "tokens_path string, index_path string, base long").repartition(max(1, len(parts)))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                part = TokenPart(row["tokens_path"], row["index_path"])
                for i in range(0, part.n_docs, 4096):
                    j = min(part.n_docs, i + 4096)
                    offsets = part.offsets[i : j + 1].astype(np.int64)
                    crc = [zlib.crc32(part[k].astype("<u4")) for k in range(i, j)]
                    ids = pa.array(part.doc_ids[i:j], pa.int64(), mask=part.known[i:j] == 0)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(offsets[:-1] + row["base"]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files into the shared folder and reads them back."""
    scratch = Scratch(df.sparkSession, "token-files")
    manifest = scratch.write(write_indexed(df, tokenizer_path, end_id, scratch.path("parts"), id_col, text_col), "manifest")
    return read_indexed(df.sparkSession, manifest)


# ---------------------------------------------------------------- operator 1: separators in flat files


def write_flat(df: DataFrame, tokenizer_path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the documents as they lie, without an index; special tokens' strings in a text are ordinary text.

    Returns a row for each document (part, ordinal, doc_id) and one for each part (ordinal -1) with path and n_ids.
    """
    rows = pick(df, doc_id=id_col, text=text_col)

    def run(batches):
        writer, n = None, 0
        for batch in batches:
            if batch.num_rows:
                writer = writer or PartWriter(folder, library_encoder(tokenizer_path, special_as_text=True), end_id, index=False)
                writer.add(batch.column("doc_id"), batch.column("text"))
                k = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, writer.part, np.int32)), pa.array(np.arange(n, n + k)), batch.column("doc_id").cast(pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32())], names)
                n += k
        if writer:
            done = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([writer.part], pa.int32()), pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), pa.array([done["tokens_path"]]), pa.array([done["n_ids"]], pa.int64()), pa.array([done["width"]], pa.int32())], names)

    names = ["part", "ordinal", "doc_id", "tokens_path", "n_ids", "width"]
    return rows.mapInArrow(run, "part int, ordinal long, doc_id long, tokens_path string, n_ids long, width int")


def separator_scan(files: DataFrame, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Counts the ids of each document in flat files (part, tokens_path, n_ids, width).

    Blocks are searched apart from one another; a prefix scan over their summaries (number of separators, place of the
    last) gives each block the ordinal of its first document and where that document began. Returns part, ordinal,
    start, n_tokens (without the end id) and complete (false for ids after a file's last end id).
    """
    blocks = files.select("part", "tokens_path", "width", "n_ids", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(n_ids - 1, 0) div {block_ids}"))).alias("block"))
    blocks = blocks.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                start = row["block"] * block_ids
                kind = np.dtype("<u2" if row["width"] == 2 else "<u4")
                ids = mapped(row["tokens_path"], kind, start * kind.itemsize, min(block_ids, row["n_ids"] - start))
                found = np.flatnonzero(ids == end_id) + start
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([row["n_ids"]], pa.int64()), pa.array([found.tolist()], pa.list_(pa.int64()))], ["part", "block", "n_ids", "ends"])

    found = blocks.mapInArrow(search, "part int, block long, n_ids long, ends array<long>")
    earlier = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.withColumn("n", F.size("ends").cast("long")).withColumn("last", F.when(F.col("n") > 0, F.element_at("ends", -1)))
    scanned = scanned.withColumn("ordinal", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("begin", F.coalesce(F.max("last").over(earlier), F.lit(-1)) + 1)
    final = F.col("block") == F.expr(f"greatest(n_ids - 1, 0) div {block_ids}")
    ends = F.when(final & (F.coalesce(F.col("last") + 1, F.col("begin")) < F.col("n_ids")), F.concat("ends", F.array("n_ids"))).otherwise(F.col("ends"))
    begins = F.concat(F.array("begin"), F.transform("ends", lambda e: e + 1))
    out = scanned.withColumn("begins", begins).withColumn("ends", ends)
    out = out.select("part", "ordinal", "n", F.posexplode(F.arrays_zip(F.slice("begins", 1, F.size("ends")).alias("b"), F.col("ends").alias("e"))).alias("pos", "x"))
    return out.select("part", (F.col("ordinal") + F.col("pos")).alias("ordinal"), F.col("x.b").alias("start"), (F.col("x.e") - F.col("x.b")).alias("n_tokens"), (F.col("pos") < F.col("n")).alias("complete"))


def count_tokens(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Token counts by document: encodes into flat files, finds the end ids in them, and names the documents again."""
    scratch = Scratch(df.sparkSession, "separators")
    written = scratch.write(write_flat(df, tokenizer_path, end_id, scratch.path("parts"), id_col, text_col), "written")
    counted = separator_scan(written.filter("ordinal < 0").select("part", "tokens_path", "n_ids", "width"), end_id, block_ids).hint("merge")  # its size is not known before it runs
    return written.filter("ordinal >= 0").select("part", "ordinal", "doc_id").join(counted, ["part", "ordinal"]).select("doc_id", "n_tokens", "part", "ordinal", "start")
