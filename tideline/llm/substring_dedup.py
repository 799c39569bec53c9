"""Substring dedup by prefix-partitioned suffix trees over words (operator 5).

1. *Prefixes.* All suffixes (one per word that starts a window) are counted by
   the hash of their first 1, 2, 4 and 13 words. A suffix belongs to the group
   of its shortest prefix whose count fits in memory, so rare first words make
   shallow groups and frequent ones are split by longer prefixes; small prefixes share a group.
2. *Subtrees.* Each group is one task: its suffixes, packed per writing task,
   are put in the order of their paths and cut at window depth. A
   node at that depth with two leaves or more is a repeat, and it carries the smallest
   document among its leaves. Deeper nodes lie below such a node, so a maximal
   repeat is the union of the repeats that start at consecutive words.
3. *Marks.* Leaves whose node holds a smaller ``doc_id`` answer with their place;
   the answers of a document are joined to its text, where consecutive windows
   merge into the spans that go.

Suffixes that agree in a whole window cannot be split by any prefix. Where even
the full window's count does not fit, they are aggregated by Spark before the
shuffle (smallest document per window) and joined back, so a passage that a third of all documents
share is no task's burden.

Paths are compared by 64-bit hashes of the window's words. Rows are told apart
by ``doc_id`` and a checksum of the text; rows of one ``doc_id`` do not make each
other's words go, and rows without one lose nothing and remove nothing. Null text has no words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import WordHashes, byte_texts, mixed, power_of_two, saved, signed, slices, text_bytes, windows

WINDOW = 13
DEPTHS = (1, 2, 4)
SUFFIXES_PER_GROUP = 2_000_000
CHUNK = 1_000_000


class Suffixes:
    """The suffixes of a slice of documents: window hash, place and prefix buckets."""

    def __init__(self, batch: pa.RecordBatch, cache: WordHashes, buckets: int, window: int):
        docs = batch.column("doc_id").to_pylist()
        texts = byte_texts(batch.column("text"))
        words = [t.split() if d is not None else [] for d, t in zip(docs, texts)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        hashes = cache.of([w for doc in words for w in doc])
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        full = place + window <= np.repeat(sizes, sizes)
        self.place = place[full].astype(np.uint32)
        self.doc = np.repeat(np.array([d or 0 for d in docs], np.int64), sizes)[full]
        self.mark = np.repeat(np.array([zlib.crc32(t) for t in texts], np.uint32), sizes)[full]
        starts = np.flatnonzero(full)

        def rolled(k: int) -> np.ndarray:
            out = windows(hashes, k, 100 + k)
            return out[starts] if len(starts) else np.empty(0, np.uint64)

        self.path = rolled(window)
        mask = np.uint64(buckets - 1)
        self.buckets = [(rolled(k) & mask).astype(np.int64) for k in DEPTHS if k < window] + [
            (self.path & mask).astype(np.int64)
        ]

    def __len__(self) -> int:
        return len(self.path)

    def groups(self, plan: list[np.ndarray]) -> np.ndarray:
        """The group of the shortest prefix that is not too frequent; -1 if even the whole window is."""
        out = np.full(len(self), -1, np.int64)
        for own, group in zip(self.buckets, plan):
            left = out < 0
            out[left] = group[own[left]]
        return out


def prefix_plan(docs: DataFrame, buckets: int, most: int, window: int = WINDOW) -> list[np.ndarray]:
    """Per depth, the group of each prefix bucket; -1 where a bucket has more than ``most`` suffixes.

    Counted over all documents. Neighbouring small prefixes share a group up to
    about ``most`` suffixes, so that what a document sends to a group stays together.
    """
    depths = len([k for k in DEPTHS if k < window]) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, counts = WordHashes(), np.zeros((depths, buckets), np.int64)
        for batch in slices(batches):
            for depth, own in enumerate(Suffixes(batch, cache, buckets, window).buckets):
                counts[depth] += np.bincount(own, minlength=buckets)
        depth, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(depth.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[depth, bucket])],
            ["depth", "bucket", "n"],
        )

    counts = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(count, "depth int, bucket int, n bigint")
    # A few buckets per group and depth, so the plan is as long as the list of groups.
    rows = counts.groupBy("depth", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((depths, buckets), np.int64)
    n[rows.column("depth").to_numpy(), rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    plan, first, share = [], 0, 1.0
    for own in n:
        over = own > most
        # Of a deeper bucket only the share that no shorter prefix took is expected.
        group = first + (np.cumsum(np.where(over, 0, own)) * share // most).astype(np.int64)
        plan.append(np.where(over, -1, group))
        first = int(group.max()) + 1
        share *= own[over].sum() / max(1, own.sum())
    return plan


def _squeezed(values: np.ndarray) -> bytes:
    """Values in rising stretches as differences, byte plane by byte plane."""
    wide = values.dtype.itemsize
    planes = np.diff(values, prepend=values.dtype.type(0)).view(np.uint8).reshape(-1, wide).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _restored(data: bytes, kind: type) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(wide, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view(kind).reshape(-1), dtype=kind)


def suffix_groups(docs: DataFrame, plan: list[np.ndarray], buckets: int, window: int = WINDOW) -> DataFrame:
    """``grp, path, doc, mark, place``: per writing task and group, its suffixes in packed form."""

    def cut(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        group, *columns = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(group, kind="stable")
        own, first = np.unique(group[order], return_index=True)
        cuts = [order[i:j] for i, j in zip(first, np.r_[first[1:], len(order)])]
        path, doc, mark, place = columns
        blobs = [
            [path[c].tobytes() for c in cuts],
            [_squeezed(doc[c]) for c in cuts],
            [_squeezed(mark[c]) for c in cuts],
            [_squeezed(place[c]) for c in cuts],
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(own), *(pa.array(b, pa.binary()) for b in blobs)], ["grp", "path", "doc", "mark", "place"]
        )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held, n = WordHashes(), [], 0
        for batch in slices(batches):
            s = Suffixes(batch, cache, buckets, window)
            group = s.groups(plan)
            keep = group >= 0
            held.append(tuple(x[keep] for x in (group, s.path, s.doc, s.mark, s.place)))
            n += len(held[-1][0])
            if n >= CHUNK:
                yield cut(held)
                held, n = [], 0
        if n:
            yield cut(held)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        write, "grp bigint, path binary, doc binary, mark binary, place binary"
    )


def subtree_marks(groups: DataFrame, shards: int) -> DataFrame:
    """``doc_id, mark, places``: per document its leaves whose window also starts in a smaller document.

    A subtree answers with one packed row per shard of documents, so that its
    rows do not multiply with the documents it meets; a shard's rows are then
    dealt to the documents.
    """

    def search(key: tuple, table: pa.Table) -> pa.Table:
        blobs = {c: table.column(c).to_pylist() for c in ("path", "doc", "mark", "place")}
        path = np.concatenate([np.frombuffer(b, np.uint64) for b in blobs["path"]])
        # Leaves in the order of their paths; those of one node are neighbours.
        order = np.argsort(path, kind="stable")
        path = path[order]
        node = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
        size = np.diff(np.r_[node, len(path)])
        del path
        doc = np.concatenate([_restored(b, np.int64) for b in blobs["doc"]])[order]
        least = np.repeat(np.minimum.reduceat(doc, node), size)
        later = np.flatnonzero(doc > least)
        doc, order = doc[later], order[later]
        mark = np.concatenate([_restored(b, np.uint32) for b in blobs["mark"]])[order]
        place = np.concatenate([_restored(b, np.uint32) for b in blobs["place"]])[order]
        shard = (mixed(doc.view(np.uint64)) & np.uint64(shards - 1)).astype(np.int32)
        by = np.lexsort((place, mark, doc, shard))
        doc, mark, place = doc[by], mark[by], place[by]
        own, first = np.unique(shard[by], return_index=True)
        cuts = [slice(i, j) for i, j in zip(first, np.r_[first[1:], len(doc)])]
        packed = [pa.array([_squeezed(x[c]) for c in cuts], pa.binary()) for x in (doc, mark, place)]
        return pa.table([pa.array(own), *packed], ["shard", "doc", "mark", "place"])

    def deal(key: tuple, table: pa.Table) -> pa.Table:
        kinds = {"doc": np.int64, "mark": np.uint32, "place": np.uint32}
        doc, mark, place = (
            np.concatenate([_restored(b, kind) for b in table.column(c).to_pylist()]) for c, kind in kinds.items()
        )
        by = np.lexsort((place, mark, doc))
        doc, mark, place = doc[by], mark[by], place[by]
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])
        places = [place[i:j].tobytes() for i, j in zip(first, np.r_[first[1:], len(doc)])]
        return pa.table(
            [pa.array(doc[first]), pa.array(mark[first].astype(np.int64)), pa.array(places, pa.binary())],
            ["doc_id", "mark", "places"],
        )

    answers = groups.groupBy("grp").applyInArrow(search, "shard int, doc binary, mark binary, place binary")
    return answers.groupBy("shard").applyInArrow(deal, "doc_id bigint, mark bigint, places binary")


def frequent_marks(docs: DataFrame, plan: list[np.ndarray], buckets: int, window: int = WINDOW) -> DataFrame:
    """The same for windows too frequent for any group: aggregated per window, then joined back."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches):
            s = Suffixes(batch, cache, buckets, window)
            left = s.groups(plan) < 0
            yield pa.RecordBatch.from_arrays(
                [signed(s.path[left]), pa.array(s.doc[left]), pa.array(s.mark[left].astype(np.int64)), pa.array(s.place[left].astype(np.int64))],
                ["path", "doc_id", "mark", "place"],
            )

    leaves = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        write, "path bigint, doc_id bigint, mark bigint, place bigint"
    )
    least = leaves.groupBy("path").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    later = leaves.join(least, "path").filter("doc_id > least")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [np.array(p, np.uint32).tobytes() for p in batch.column("places").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(places, pa.binary())], ["doc_id", "mark", "places"]
            )

    return (
        later.groupBy("doc_id", "mark")
        .agg(F.collect_list("place").alias("places"))
        .mapInArrow(pack, "doc_id bigint, mark bigint, places binary")
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, most: int = SUFFIXES_PER_GROUP) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the words left, joined by one space) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Words take six bytes or so; more buckets than groups keep most prefixes short.
    buckets = power_of_two(max(16, 4 * text_bytes(docs) / 6 / most))
    plan = prefix_plan(docs, buckets, most, window)
    # A shard answers for about as many suffixes as a group holds.
    marks = subtree_marks(suffix_groups(docs, plan, buckets, window), max(1, buckets // 4))
    if (plan[-1] < 0).any():
        marks = marks.unionByName(frequent_marks(docs, plan, buckets, window))
    marks = saved(marks.groupBy("doc_id", "mark").agg(F.collect_list("places").alias("places")))
    texts = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("_mark"))
    marks = marks.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_m"), "places")
    both = texts.join(
        marks, (F.col("doc_id").cast("bigint") == F.col("_doc")) & (F.col("_mark") == F.col("_m")), "left"
    ).select("doc_id", "text", "places")

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, n_removed, kept = [], [], []
            for text, places in zip(byte_texts(batch.column("text")), batch.column("places").to_pylist()):
                words = text.split()
                n_words.append(len(words))
                if places:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(np.concatenate([np.frombuffer(p, np.uint32) for p in places])).astype(np.int64)
                    # Consecutive windows are one maximal span.
                    edge[at] += 1
                    np.subtract.at(edge, at + window, 1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    words = [words[i] for i in stay.tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return both.mapInArrow(leave, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")
