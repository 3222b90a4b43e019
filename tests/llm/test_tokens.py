from __future__ import annotations

import hashlib
import json
import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from meshlark.llm import byte_bpe, token_files
from meshlark.llm.scratch import Scratch

RANKS, TOKENIZER = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def odd_texts():
    rnd = random.Random(4)
    chars = ["a", "b", "é", "€", "😀", " ", " ", " ", "\n", "\t", "\xa0", "　", "\x1c", "'", "s", "0", "7", ".", "<|endoftext|>", "\x00", "́"]
    texts = ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    return texts + ["", None, " ", "  ", " a", "a ", "a  b", "a   b", "a \n b", "a\n b", "it's we'll don't", "x <|endoftext|> y", "a" * 3000, "ab" * 400, "é" * 300, " ".join(["word"] * 5000), "# # #"]


def rows_of(texts):
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def documents(spark):
    rows = rows_of(odd_texts()) + [(None, "no id"), (3, "again"), (3, "again")]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, Doc_Id int").repartition(5), rows


def test_byte_bpe_equals_tiktoken(documents):
    df, rows = documents
    ranks = byte_bpe.load_ranks(RANKS)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t in rows:
        ids = other.encode_ordinary(t or "")
        want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    got = [tuple(r) for r in byte_bpe.round_trip(df, RANKS, P.PATTERN).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    ids = {(r.doc_id, r.n_tokens): r.ids for r in byte_bpe.encode(df, RANKS, P.PATTERN).collect()}
    assert ids[3, len(other.encode_ordinary("again"))] == other.encode_ordinary("again")


def test_long_pieces_equal_tiktoken():
    rnd, ranks = random.Random(6), byte_bpe.load_ranks(RANKS)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe, letters = byte_bpe.ByteBpe(ranks), [t.decode() for t in ranks if t.isalpha() and t.isascii()]
    kinds = [lambda n: "".join(rnd.choice("ab") for _ in range(n)), lambda n: "a" * n, lambda n: "".join(rnd.choice(letters) for _ in range(n // 4 + 1)), lambda n: "".join(rnd.choice("éèçaÉñ中文") for _ in range(n)), lambda n: "".join(rnd.choice("acgtnesi") for _ in range(n))]
    for i in range(400):
        piece = kinds[i % 5](rnd.choice([2, 3, 9, 100, 700])).encode()
        got = bpe.merge_long(bpe.byte[np.frombuffer(piece, np.uint8)], rnd.choice([4, 32, 512]))
        assert got.tolist() == other._encode_single_piece(piece)
    long = [kind(20_000) for kind in kinds] + [kind(900) for kind in kinds]
    ids, sizes = bpe.encode_pieces(long)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [other._encode_single_piece(x.encode()) for x in long]


def test_token_files(spark, documents):
    df, rows = documents
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = sorted(token_files.token_files(df, TOKENIZER, 2).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows if r[0] is not None)) + [None]
    want, start = {}, 0
    for d, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        start += r.n_tokens


def test_token_part_gives_single_documents(spark, documents):
    df, rows = documents
    scratch = Scratch(spark, "test")
    manifest = scratch.write(token_files.write_indexed(df, TOKENIZER, 2, scratch.path("parts")), "manifest")
    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = dict(rows)
    seen = 0
    for tokens_path, index_path, _ in token_files.with_bases(manifest):
        part = token_files.TokenPart(tokens_path, index_path)
        assert part.ids.dtype == np.uint16 and os.path.exists(token_files.local_path(tokens_path))
        for i in range(part.n_docs):
            if part.known[i] and part.doc_ids[i] != 3:
                assert tokenizer.decode(part[i][:-1].tolist(), skip_special_tokens=False) == (texts[int(part.doc_ids[i])] or "")
                seen += 1
    assert seen > 300


@pytest.mark.parametrize("block", [3, 50, 1 << 20])
def test_separator_scan(spark, documents, block):
    df, rows = documents
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    want = sorted(((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t in rows), key=repr)
    got = token_files.count_tokens(df, TOKENIZER, 50256, block_ids=block).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_separator_scan_of_an_open_end(spark):
    scratch = Scratch(spark, "test")
    path = scratch.path("flat")
    ids = np.array([9, 9, 1, 1, 9, 9, 9, 1, 9], "<u2")
    with token_files.create(path) as f:
        f.write(ids.tobytes())
    with token_files.create(path + "-empty"):
        pass
    files = spark.createDataFrame([(0, path, len(ids), 2), (1, path + "-empty", 0, 2)], "part int, tokens_path string, n_ids long, width int")
    for block in (1, 2, 3, 100):
        got = sorted(token_files.separator_scan(files, 1, block).collect())
        assert [tuple(r) for r in got] == [(0, 0, 0, 2, True), (0, 1, 3, 0, True), (0, 2, 4, 3, True), (0, 3, 8, 1, False)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.token_files(df, TOKENIZER, 2).collect() == []
    assert token_files.count_tokens(df, TOKENIZER, 50256).collect() == []
    assert byte_bpe.round_trip(df, RANKS, P.PATTERN).collect() == []


def stretch_texts():
    rnd = random.Random(8)
    words = ["the", " the", "don't", "'sad", "it's", "x1y2", "3.14", "(a)", "--", "...", "caf\u00e9", "\u00e9t\u00e9", "na\u00efve,", "\u4e2d\u6587", "\u0416\u0443\u043a", "\u096b6", "1\u096b", "\u00b2", "\u201cq\u201d", "\u2014", "a\u0301", "\U0001f600", "\xa0", "\u3000", "\x85", "\x1c", "\x00", "\x7f", "<0xC3>", "\u00c3\u0120\u010a", "<|endoftext|>", "http://a.b/c?d=1", "ZZZ", "''ll"]
    gaps = [" ", " ", " ", " ", "", "  ", "   ", "\n", "\n\n ", "\t", " \r\n"]
    return ["".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randint(0, 90))) for _ in range(1500)] + [chr(c) + "a b" + chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]


@pytest.mark.parametrize("special_as_text", [False, True])
def test_stretches_give_the_ids_of_the_file(special_as_text):
    plain, texts = Tokenizer.from_file(TOKENIZER), stretch_texts() + [t or "" for t in odd_texts()]
    plain.encode_special_tokens = special_as_text
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    encoder = token_files.LibraryEncoder(TOKENIZER, special_as_text)
    ids, sizes = encoder.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    # whole words of a stretch reach the library's model together, and each text goes to the library as it is
    pieces = [p for p, _ in encoder.tokenizer.pre_tokenizer.pre_tokenize_str("one two (three) 4 don't caf\u00e9 five six")]
    assert pieces == ["one two (three) 4", " don", "'t", " caf\u00e9 five six"]


def test_stretches_only_where_no_token_lies_across():
    with open(TOKENIZER, encoding="utf-8") as f:
        file = json.load(f)
    assert token_files.with_stretches(file) is not None
    n = len(file["model"]["vocab"])
    for token in ("a\u0120b", "a1", ".a", "a\u0120", "\u00c3\u00a9.", "\u00a9\u0120", "1\u00c3", "\u0120\u00c3\u00a9\u0120a"):
        across = file | {"model": file["model"] | {"vocab": file["model"]["vocab"] | {token: n}}}
        assert token_files.with_stretches(across) is None, token
    for token in ("\u0120\u0120a", "a'", "a\u00e2\u0122\u0136", "\u00c2\u0142\u0120a", "\u0120\u00c3\u00a9a\u00c3"):  # two spaces, an apostrophe, a dash and a no-break space lie in no stretch
        other = file | {"model": file["model"] | {"vocab": file["model"]["vocab"] | {token: n}}}
        assert token_files.with_stretches(other) is not None, token
    assert token_files.with_stretches(file | {"model": file["model"] | {"dropout": 0.1}}) is None
    assert token_files.with_stretches(file | {"pre_tokenizer": file["pre_tokenizer"] | {"add_prefix_space": True}}) is None
    assert token_files.with_stretches(file | {"pre_tokenizer": None}) is None
    assert token_files.with_stretches(file | {"model": file["model"] | {"vocab": file["model"]["vocab"] | {"<0xC3>": n}}}) is None


def test_library_encoder_takes_other_files_as_they_are(tmp_path):
    with open(TOKENIZER, encoding="utf-8") as f:
        file = json.load(f)
    file["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(file))
    plain, texts = Tokenizer.from_file(str(tmp_path / "t.json")), ["a b", "", "it's"]
    ids, sizes = token_files.LibraryEncoder(str(tmp_path / "t.json"), False).encode(texts)
    assert ids.tolist() == [i for t in texts for i in plain.encode(t, add_special_tokens=False).ids] and sizes.sum() == len(ids)
