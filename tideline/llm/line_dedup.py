"""Line dedup by sharded minimal perfect hashes (operator 6).

A line's key is the line without ASCII white space at its ends and with A-Z
lower-cased. Keys of at least ``MIN_POINTS`` code points that ``MIN_DOCS``
documents or more hold lose all their lines except in the largest ``doc_id``.

1. Each task gathers, per key hash, the documents that hold it, of which it sends
   on the ``MIN_DOCS`` largest: enough to tell whether a line is in that many
   documents. A very common line is a few numbers per task by then.
2. Hashes are dealt to shards of bounded size. A shard is a minimal perfect hash
   over its distinct line hashes with compact arrays by number: a fingerprint,
   the count (which stops at ``MIN_DOCS``), and the last document for the lines that reach it.
3. Documents probe: each task sends the hashes of its lines to their shards in
   packed form, and a shard answers with the lines to drop, per document.
4. The answers, one small value per document, are joined to the texts.

Rows are told apart by ``doc_id`` and a checksum of the text: rows repeated with
one ``doc_id`` count as one document, and the largest keeps its lines in each of
them. Rows without a ``doc_id`` count as no document and keep all lines. Null text is
one empty line.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import WHITE_CHARS, byte_texts, power_of_two, saved, slices, text_bytes
from tideline.llm.perfect_hash import PerfectHash

MIN_POINTS = 20
MIN_DOCS = 3
HASHES_PER_SHARD = 500_000
LINES_PER_CHUNK = 1_000_000
#: Bytes of line hashes that one task probes with, about.
PROBE_BYTES = 8 << 20
_WHITE = WHITE_CHARS.encode()


def line_hashes(text: bytes, min_points: int = MIN_POINTS) -> np.ndarray:
    """The key hash of every line; 0 where the key is too short to count."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(_WHITE)
        if len(key) < min_points or (not key.isascii() and len(key.decode()) < min_points):
            out.append(0)
        else:
            out.append(xxhash.xxh3_64_intdigest(key.lower()) | 1)
    return np.array(out, np.uint64)


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """``doc_id, checksum, line hashes`` of the rows that have a doc_id."""
    for doc, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text"))):
        if doc is not None:
            yield doc, zlib.crc32(text), line_hashes(text)


def _packed(shards: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per shard with its part of each column; the first column holds the hashes."""
    h = columns["h"]
    shift = np.uint64(64 - (shards.bit_length() - 1))
    shard = (h >> shift).astype(np.int32) if shards > 1 else np.zeros(len(h), np.int32)
    order = np.argsort(shard, kind="stable")
    own, first = np.unique(shard[order], return_index=True)
    parts = [order[i:j] for i, j in zip(first, np.r_[first[1:], len(h)])]
    blobs = [pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(own), *blobs], ["shard", *columns])


def _joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    parts = [np.frombuffer(b, kind) for b in table.column(column).to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, kind)


def holders(docs: DataFrame, shards: int) -> DataFrame:
    """``shard, h, doc``: per task, up to ``MIN_DOCS`` of the documents that hold a line, the largest among them."""

    def cut(held: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
        h = np.concatenate([x for x, _ in held])
        doc = np.repeat(np.array([d for _, d in held], np.int64), [len(x) for x, _ in held])
        h, doc = _distinct(h, doc)
        # Places from the end of each run of equal hashes.
        end = np.flatnonzero(np.r_[h[1:] != h[:-1], True])
        back = np.repeat(end, np.diff(np.r_[-1, end])) - np.arange(len(h))
        keep = back < MIN_DOCS
        return _packed(shards, {"h": h[keep], "doc": doc[keep]})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches):
            for doc, _, hashes in _documents(batch):
                held.append((np.unique(hashes[hashes != 0]), doc))
                n += len(held[-1][0])
            if n >= LINES_PER_CHUNK:
                yield cut(held)
                held, n = [], 0
        if n:
            yield cut(held)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(count, "shard int, h binary, doc binary")


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    once = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)]
    return h[once], doc[once]


def line_shards(held: DataFrame) -> DataFrame:
    """``shard, hash, prints, counts, docs``: the perfect hash of each shard and its arrays."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        h, doc = _distinct(_joined(table, "h", np.uint64), _joined(table, "doc", np.int64))
        end = np.flatnonzero(np.r_[h[1:] != h[:-1], True])
        keys, last = h[end], doc[end]
        n = np.minimum(np.diff(np.r_[-1, end]), MIN_DOCS).astype(np.uint8)
        index = PerfectHash.of(keys)
        order = np.argsort(index.numbers(keys))
        n, prints = n[order], (keys[order] >> np.uint64(1)).astype(np.uint16)
        blobs = [index.to_bytes(), prints.tobytes(), n.tobytes(), last[order][n >= MIN_DOCS].tobytes()]
        arrays = [pa.array([key[0].as_py()], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)]
        return pa.table(arrays, ["shard", "hash", "prints", "counts", "docs"])

    return held.groupBy("shard").applyInArrow(build, "shard int, hash binary, prints binary, counts binary, docs binary")


def probes(docs: DataFrame, shards: int) -> DataFrame:
    """``shard, h, doc, mark, line``: per task and shard the line hashes and where they are, packed."""

    def cut(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        sizes = [len(h) for _, _, h in held]
        h = np.concatenate([h for _, _, h in held])
        doc = np.repeat(np.array([d for d, _, _ in held], np.int64), sizes)
        mark = np.repeat(np.array([m for _, m, _ in held], np.uint32), sizes)
        line = np.concatenate([np.arange(n, dtype=np.uint32) for n in sizes])
        real = h != 0
        return _packed(shards, {"h": h[real], "doc": doc[real], "mark": mark[real], "line": line[real]})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches):
            own = list(_documents(batch))
            held += own
            n += sum(len(h) for _, _, h in own)
            if n >= LINES_PER_CHUNK:
                yield cut(held)
                held, n = [], 0
        if n:
            yield cut(held)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        probe, "shard int, h binary, doc binary, mark binary, line binary"
    )


def dropped_lines(asked: DataFrame, shards: DataFrame) -> DataFrame:
    """``doc_id, mark, lines``: the line numbers to drop, packed, as the shards answer.

    The probes of a shard, which a very common line can make many, are dealt to
    several tasks by their size; each gets the shard's arrays.
    """

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("lines", pa.binary())]).empty_table()
        if not left.num_rows or not right.num_rows:
            return empty
        blob = lambda c: right.column(c)[0].as_py()
        index = PerfectHash.from_bytes(blob("hash"))
        prints, counts = np.frombuffer(blob("prints"), np.uint16), np.frombuffer(blob("counts"), np.uint8)
        last, often = np.frombuffer(blob("docs"), np.int64), np.cumsum(counts >= MIN_DOCS) - 1
        h, doc = _joined(left, "h", np.uint64), _joined(left, "doc", np.int64)
        number = index.numbers(h)
        found = np.flatnonzero((number >= 0) & (counts[number] >= MIN_DOCS))
        found = found[prints[number[found]] == (h[found] >> np.uint64(1)).astype(np.uint16)]
        found = found[last[often[number[found]]] != doc[found]]
        if not len(found):
            return empty
        doc, mark, line = doc[found], _joined(left, "mark", np.uint32)[found], _joined(left, "line", np.uint32)[found]
        order = np.lexsort((line, mark, doc))
        doc, mark, line = doc[order], mark[order], line[order]
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])
        lines = [line[i:j].tobytes() for i, j in zip(first, np.r_[first[1:], len(doc)])]
        return pa.table(
            [pa.array(doc[first]), pa.array(mark[first].astype(np.int64)), pa.array(lines, pa.binary())],
            ["doc_id", "mark", "lines"],
        )

    parts = asked.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("h")) / PROBE_BYTES).cast("int").alias("parts"))
    asked = asked.join(parts, "shard").withColumn("part", F.pmod(F.hash("h"), F.greatest("parts", F.lit(1)))).drop("parts")
    shards = shards.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest("parts", F.lit(1)) - 1)))
    by = ["shard", "part"]
    return (
        asked.groupBy(*by)
        .cogroup(shards.drop("parts").groupBy(*by))
        .applyInArrow(answer, "doc_id bigint, mark bigint, lines binary")
    )


def deduplicated_lines(docs: DataFrame, hashes_per_shard: int = HASHES_PER_SHARD) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` (the text that is left) of every row."""
    # A line that counts has MIN_POINTS bytes at least.
    shards = power_of_two(text_bytes(docs) / MIN_POINTS / hashes_per_shard)
    index = saved(line_shards(holders(docs, shards)))
    asked = saved(probes(docs, shards))
    dropped = saved(dropped_lines(asked, index).groupBy("doc_id", "mark").agg(F.collect_list("lines").alias("lines")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("_mark"))
    drops = dropped.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_m"), "lines")
    both = texts.join(
        drops, (F.col("doc_id").cast("bigint") == F.col("_doc")) & (F.col("_mark") == F.col("_m")), "left"
    ).select("doc_id", "text", "lines")

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_lines, n_dropped, kept = [], [], []
            for text, drop in zip(byte_texts(batch.column("text")), batch.column("lines").to_pylist()):
                lines = text.split(b"\n")
                gone = set(np.concatenate([np.frombuffer(x, np.uint32) for x in drop]).tolist()) if drop else ()
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
                kept.append((b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept"],
            )

    return both.mapInArrow(leave, f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept string")

