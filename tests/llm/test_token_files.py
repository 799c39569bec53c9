"""Huffman-coded token files against the tokenizers library and an exact round trip."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideline.llm import registry
from tideline.llm.common import new_folder, saved
from tideline.llm.huffman import Code, code_lengths
from tideline.llm.token_files import WordEncoder, glued, pack_block, parts_of, read_files, tokenized, unpack_block, write_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, ids binary, start bigint, part int, data binary"


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    return own


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(PATH)


PIECES = ["a", "word", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", " ", " ", "　", "​", "é", "日本", "7", "42",
          "'s", "'", "...", ".", ",&", "€", "ſ", "中", "don't", "_", "\n", "\0", "<|endoftext|>", "🙂", "I'll"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_word_by_word_equals_whole_text(library, encoder, text):
    assert "".join(glued(text)) == text and (not text or "".join(parts_of(text)) == text)
    assert encoder.encode([text], 2)[0].tolist() == library.encode(text, add_special_tokens=False).ids + [2]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_any_text(library, encoder, text):
    assert encoder.encode([text], None)[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_memory_of_words_is_bounded(library):
    small = WordEncoder(PATH, limit=30)
    texts = [f"some words {i} and again some words" for i in range(50)]
    for text in texts:
        assert small.encode([text], None)[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(small.words) < 20


def optimal_bits(counts, limit):
    """Least total bits of a prefix code with limited lengths, by dynamic programming over multisets of lengths."""
    counts = sorted((c for c in counts if c), reverse=True)
    best = {(1, 0): 0}  # free nodes at this depth, symbols placed
    total = None
    for depth in range(1, limit + 1):
        after = {}
        for (free, placed), cost in best.items():
            for here in range(min(2 * free, len(counts) - placed) + 1):
                left = min(2 * free - here, len(counts))
                price = cost + depth * sum(counts[placed : placed + here])
                key = (left, placed + here)
                if placed + here == len(counts):
                    total = price if total is None else min(total, price)
                elif left and price < after.get(key, 10**18):
                    after[key] = price
        best = after
    return total


@pytest.mark.parametrize("limit", [3, 4, 6])
def test_lengths_are_optimal(limit):
    rng = random.Random(limit)
    for _ in range(20):
        counts = np.array([rng.choice([0, 1, 2, 5, 40, 900]) for _ in range(8)])
        lengths = code_lengths(counts, limit)
        used = counts > 0
        assert (lengths[~used] == 0).all() and lengths.max(initial=0) <= limit
        if used.sum() > 1:
            assert sum(2.0 ** -int(x) for x in lengths[used]) == 1
            assert int((counts * lengths).sum()) == optimal_bits(counts.tolist(), limit)


def test_code_limits():
    with pytest.raises(ValueError):
        code_lengths(np.ones(9), 3)
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(sum(fibonacci[-2:]))
    assert code_lengths(np.array(fibonacci), 10).max() == 10
    assert code_lengths(np.array([0, 0, 7]), 5).tolist() == [0, 0, 1]
    assert code_lengths(np.array([], np.int64), 5).tolist() == []


@pytest.mark.parametrize("step", [1, 3, 256])
def test_blocks_round_trip(step):
    rng = np.random.default_rng(step)
    docs = [rng.zipf(1.3, n).clip(max=5000).astype(np.uint32) for n in (0, 1, 2, 255, 256, 257, 1000, 70_000)]
    code = Code(code_lengths(np.bincount(np.concatenate(docs)), 14))
    coded = [code.encode(d, step) for d in docs]
    names = [None, 5, -3, 5, 2**60, 0, None, 1]
    data = pack_block(names, [len(d) for d in docs], [b for b, _ in coded], [m for _, m in coded])
    back, ids = unpack_block(code, data, step)
    assert back == names
    assert all(np.array_equal(a, b) for a, b in zip(ids, docs))
    assert len(unpack_block(code, pack_block([1], [0], [b""], [np.empty(0, np.int64)]), step)[1][0]) == 0
    with pytest.raises(ValueError):
        unpack_block(code, b"none" + data[4:], step)


def documents():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)] + ["Über", "naïve", "日本", " "]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [None, "", " ", "\n\n  x", "<|endoftext|>", "\0a \0", "x" * 5000, prose(30_000)] + [prose(rng.randrange(80)) for _ in range(120)]
    rows = [(3 * i - 50, t, b"\1", 7, 1, b"") for i, t in enumerate(texts)]
    rows += [rows[9]] * 40 + [(None, "no id", b"", 1, 1, b""), (10**15, prose(5), None, 1, 1, None)]
    rng.shuffle(rows)
    return rows


def test_files_against_the_library(spark, library):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    folder = new_folder(spark)
    write_files(saved(tokenized(docs, PATH, 2), "zstd"), folder, step=16, block_ids=700)
    got = read_files(spark, folder).withColumn("crc", F.crc32("ids")).collect()
    at, expected = 0, []
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        expected.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(str, ((r.doc_id, r.start, r.n_tokens, r.crc) for r in got))) == sorted(map(str, expected))
    blocks = spark.read.parquet(f"{folder}/blocks")
    assert blocks.count() > 20
    assert blocks.agg(F.sum("n_ids")).first()[0] == at
    # Files follow each other in the order of doc_id.
    spans = [unpacked_ids(r.data) for r in blocks.orderBy("part", "block").collect()]
    known = [d for span in spans for d in span if d is not None]
    assert known == sorted(known)


def unpacked_ids(data):
    docs = int.from_bytes(data[4:12], "little")
    at = 20 + 8 * docs
    numbers = np.frombuffer(data, "<i8", docs, at + docs).tolist()
    return [n if k else None for n, k in zip(numbers, data[at : at + docs])]


def test_empty_table(spark):
    folder = new_folder(spark)
    write_files(tokenized(spark.createDataFrame([], SCHEMA), PATH, 2), folder)
    assert read_files(spark, folder).collect() == []


def test_query_over_the_shipped_table(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r) for r in registry.op13_token_files(spark, sf_dir).collect()}
    at = 0
    for r in spark.read.parquet(os.path.join(sf_dir, "documents.parquet")).orderBy("doc_id").collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        assert got[r.doc_id] == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
