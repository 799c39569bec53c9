"""Token ids in Huffman-coded files (operator 13).

1. :func:`tokenized` encodes the texts with the tokenizers library, each distinct
   word once while a worker remembers it (:class:`WordEncoder`).
2. The ids' counts over the whole table, one row per id of the vocabulary, give
   one canonical, length-limited Huffman code (:mod:`tideline.llm.huffman`).
3. :func:`write_files` codes every document, from a whole byte on, range-partitions
   the coded rows by ``doc_id`` and writes blocks of whole documents. A block is
   decoded by itself and has a checkpoint, the bit of the stream, for every
   ``STEP``-th id of each document.
4. :func:`read_files` adds up the files' sizes for the place of each document in
   the whole id sequence and decodes the blocks in any task.

File format: the folder ``blocks`` has Parquet files, written and committed by
Spark and so whole after lost executors, with a row per block: ``part`` and
``block`` (together the order), ``first`` (ids before it in its part), ``n_ids``
and ``data``. ``data`` is little-endian: the four bytes ``TLTF``; documents and
checkpoints as unsigned 64-bit numbers; the ids of each document (64 bits each), a
byte each that says whether there is a doc_id, the doc_ids (64 bits), the
checkpoints (64 bits); then the bit stream. The folder ``code`` has one row with the
bits of every id.

Null text is empty: its document has the end id alone. Rows without a doc_id
come first; rows of one doc_id follow each other by a hash of their coded ids. Special
tokens' strings in a text are ordinary text. Other columns are ignored. An
empty table gives no blocks.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import saved, slices
from tideline.llm.huffman import Code, code_lengths

MAX_BITS = 18
STEP = 256
BLOCK_IDS = 1 << 19
_MAGIC = b"TLTF"
BLOCKS = "part int, block bigint, first bigint, n_ids bigint, data binary"


class Vocabulary(dict):
    """Numbers strings in the order in which they are first looked up, and keeps the ids of each.

    Beyond ``limit`` characters it forgets those that were seen once only; if
    the others are too many as well, all.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.chars = 0
        #: Strings without ids yet.
        self.new: list[str] = []
        self.ids = np.empty(0, np.uint32)
        self.first, self.size, self.seen = (np.empty(0, np.int64) for _ in range(3))

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        """The ids of all new strings, one after the other."""
        self.chars += sum(map(len, self.new))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids])
        self.seen = np.concatenate([self.seen, np.zeros(len(size), np.int64)])
        self.new = []

    def count(self, numbers: np.ndarray) -> None:
        self.seen += np.bincount(numbers, minlength=len(self.seen))

    def of(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        return self.ids[np.repeat(self.first[numbers] - stop + size, size) + np.arange(total)]

    def trim(self) -> None:
        if self.chars <= self.limit:
            return
        kept = np.flatnonzero(self.seen > 1)
        words = list(self)
        words, ids, size = [words[k] for k in kept.tolist()], self.of(kept), self.size[kept]
        self.forget()
        if sum(map(len, words)) <= self.limit // 2:
            self.update(zip(words, range(len(words))))
            self.new = words
            self.add(ids, size)


class WordEncoder:
    """Ids of texts by way of their distinct words.

    A text is split at its spaces. Where one stands between two characters that are
    no white space, a pre-tokenizer always starts a piece with it; texts with
    other spaces go to the library cut at the former ones only. New words are cut at
    ASCII punctuation once more, and what is new of that goes to the library. Words and
    parts are remembered up to ``limit`` characters each.
    """

    def __init__(self, path: str, limit: int = 5 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: Words without the space before them; a text's first word has NUL in its place.
        self.words, self.parts = Vocabulary(limit), Vocabulary(limit)

    def _library(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings in a row, and how many each has."""
        made = [e.ids for e in self.tokenizer.encode_batch(strings, add_special_tokens=False)]
        size = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.uint32, int(size.sum())), size

    def _learn(self) -> None:
        """Ids of the words that were looked up for the first time; a word that has to be glued gets none."""
        self.parts.trim()
        parts, counts = [], []
        for word in self.words.new:
            if word.isalnum():
                parts.append(" " + word)
                counts.append(1)
                continue
            spelled = word[1:] if word[:1] == "\0" else " " + word
            loose = len(spelled) < 2 or spelled[-1].isspace() or (spelled[0] == " " and spelled[1].isspace())
            cut = [] if loose else parts_of(spelled)
            parts += cut
            counts.append(len(cut))
        numbers = self.parts.numbers(parts)
        if self.parts.new:
            self.parts.add(*self._library(self.parts.new))
        self.parts.count(numbers)
        length = np.r_[0, np.cumsum(self.parts.size[numbers])][np.cumsum([0, *counts])]
        self.words.add(self.parts.of(numbers), np.diff(length))

    def encode(self, texts: list[str], end: int | None) -> list[np.ndarray]:
        """The ids of each text, with ``end`` appended."""
        self.words.trim()
        numbers = []
        for text in texts:
            words = text.split(" ")
            words[0] = "\0" + words[0]
            numbers.append(self.words.numbers(words) if "\0" not in text else None)
        self._learn()
        self.words.count(np.concatenate([np.empty(0, np.int64), *(at for at in numbers if at is not None)]))
        out = []
        for text, at in zip(texts, numbers):
            if at is None:
                ids, _ = self._library([text])
            elif not self.words.size[at].all():
                ids, _ = self._library(glued(text))
            else:
                ids = self.words.of(at)
            out.append(ids if end is None else np.append(ids, np.uint32(end)))
        return out


def glued(text: str) -> list[str]:
    """The text cut before every space that stands between two characters that are no white space."""
    first, *rest = text.split(" ")
    out = [first]
    for word in rest:
        if not out[-1] or out[-1][-1].isspace() or not word or word[0].isspace():
            out[-1] += " " + word
        else:
            out.append(" " + word)
    return [w for w in out if w]


_PUNCTUATION = r"!-&(-/:-@\[-`{-~"
_PARTS = re.compile(rf" ?[{_PUNCTUATION}]+|\n|[^{_PUNCTUATION}\n]+")


def parts_of(word: str) -> list[str]:
    """A word cut between letters or digits, ASCII punctuation and single line ends; whole where that is not safe."""
    if max(word) >= "\u0250" or "\n\n" in word:
        return [word]
    parts = _PARTS.findall(word)
    for k, part in enumerate(parts):
        # Next to a cut there are letters or digits, or nothing but punctuation or a line end.
        if part[-1].isalnum():
            if not (part[0].isalnum() or (k == 0 and part[0] == " " and part[1].isalnum())):
                return [word]
        elif part != "\n" and not _PARTS.fullmatch(part) or part[-1] not in _CUT:
            return [word]
    return parts


_CUT = set("\n" + "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'"))


def tokenized(docs: DataFrame, tokenizer: str, end: int | None) -> DataFrame:
    """``doc_id, ids``: the ids of every text as unsigned 32-bit numbers, little-endian.

    One more row a task has ``counts`` instead: how often each id occurs in it, 64 bits each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Tasks of one Python worker share what they have learnt.
        memory = sys.modules.setdefault("tideline_worker_memory", ModuleType("tideline_worker_memory"))
        encoder = memory.__dict__.setdefault(tokenizer, None) or WordEncoder(tokenizer)
        memory.__dict__[tokenizer] = encoder
        counts = np.zeros(0, np.int64)
        for batch in slices(batches):
            ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()], end)
            found = np.bincount(np.concatenate(ids) if ids else [], minlength=len(counts))
            found[: len(counts)] += counts
            counts = found
            columns = [batch.column("doc_id"), pa.array([i.tobytes() for i in ids], pa.binary()), pa.nulls(len(ids), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "counts"])
        columns = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "counts"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids binary, counts binary")


def id_counts(rows: DataFrame) -> np.ndarray:
    """How often each id occurs; as long as the largest id asks, so bounded by the vocabulary."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("counts").to_pylist():
                counts = np.frombuffer(data, "<i8")
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "n"])

    each = rows.where("counts is not null").select("counts").mapInArrow(unpack, "id bigint, n bigint")
    found = each.groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, np.int64)
    counts[found["id"]] = found["n"]
    return counts


def pack_block(doc_ids: list[int | None], sizes: list[int], streams: list[bytes], marks: list[np.ndarray]) -> bytes:
    """One block of coded documents; the checkpoints of each count from its own first bit."""
    at = np.cumsum([0, *map(len, streams[:-1])])
    checks = np.concatenate([m + 8 * i for m, i in zip(marks, at)]).astype("<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    head = np.array([len(sizes), len(checks)], "<u8").tobytes()
    return b"".join([_MAGIC, head, np.array(sizes, "<u8").tobytes(), known.tobytes(), numbers.tobytes(), checks.tobytes(), *streams])


def unpack_block(code: Code, data: bytes, step: int) -> tuple[list[int | None], list[np.ndarray]]:
    """The doc_ids and ids of a block's documents."""
    if data[:4] != _MAGIC:
        raise ValueError("not a block of token ids")
    docs, checks = np.frombuffer(data, "<u8", 2, 4).tolist()
    at = 20
    sizes = np.frombuffer(data, "<u8", docs, at).astype(np.int64)
    known = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    numbers = np.frombuffer(data, "<i8", docs, at + 9 * docs)
    marks = np.frombuffer(data, "<u8", checks, at + 17 * docs).astype(np.int64)
    # Every checkpoint stands for ``step`` ids but the last of each document.
    counts = np.full(checks, step)
    some = sizes > 0
    counts[np.cumsum(-(-sizes // step))[some] - 1] = (sizes[some] - 1) % step + 1
    ids = code.decode(data[at + 17 * docs + 8 * checks :], marks, counts)
    return [d if k else None for d, k in zip(numbers.tolist(), known)], np.split(ids, np.cumsum(sizes)[:-1]) if docs else []


def write_files(rows: DataFrame, folder: str, max_bits: int = MAX_BITS, step: int = STEP, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of :func:`tokenized` in ascending ``doc_id`` order. ``rows`` is read twice: it should be stored."""
    spark = rows.sparkSession
    lengths = code_lengths(id_counts(rows), max_bits)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in slices(batches, "ids"):
            ids = [np.frombuffer(b, "<u4") for b in batch.column("ids").to_pylist()]
            coded = [code.encode(i, step) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([m.astype("<u8").tobytes() for _, m in coded], pa.binary()),
                    pa.array([b for b, _ in coded], pa.binary()),
                ],
                ["doc_id", "n", "marks", "stream"],
            )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, first, n, block = [], 0, 0, 0

        def cut() -> pa.RecordBatch:
            values = [[part], [block], [first], [n], [pack_block(*map(list, zip(*held)))]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], ["part", "block", "first", "n_ids", "data"])

        for batch in slices(batches, "stream"):
            for doc, size, stream, marks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "stream", "marks"))):
                if held and n + size > block_ids:
                    yield cut()
                    held, first, n, block = [], first + n, 0, block + 1
                held.append((doc, size, stream, np.frombuffer(marks, "<u8").astype(np.int64)))
                n += size
        if held:
            yield cut()

    coded = rows.where("counts is null").select("doc_id", "ids").mapInArrow(encode, "doc_id bigint, n bigint, marks binary, stream binary")
    # The last key spreads repeated rows over the ranges; it does not change what is written.
    keyed = coded.withColumns({"_hash": F.xxhash64("stream"), "_row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash")
    blocks = ordered.drop("_hash", "_row").mapInArrow(write, BLOCKS)
    blocks.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    spark.createDataFrame([(bytes(lengths), step)], "bits binary, step int").coalesce(1).write.parquet(f"{folder}/code")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document; ``start`` counts the ids before it in all files."""
    stored = spark.read.schema("bits binary, step int").parquet(f"{folder}/code").first()
    lengths, step = np.frombuffer(bytes(stored["bits"]), np.uint8), stored["step"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = blocks.join(parts, "part").select((F.col("base") + F.col("first")).alias("start"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in slices(batches, "data"):
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data").to_pylist()):
                doc_ids, ids = unpack_block(code, data, step)
                sizes = np.array([len(i) for i in ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(start + np.cumsum(sizes) - sizes),
                        pa.array(sizes),
                        pa.array([i.tobytes() for i in ids], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def stored_files(docs: DataFrame, tokenizer: str, end: int | None, folder: str) -> DataFrame:
    """Encode, write and read back."""
    write_files(saved(tokenized(docs, tokenizer, end), "zstd"), folder)
    return read_files(docs.sparkSession, folder)
