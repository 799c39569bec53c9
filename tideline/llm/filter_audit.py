"""Audit of the interaction of document filters (operator 11).

Five conditions fail a document: A under 100 words, B under 80% distinct words,
C more than 10% letters A-Z, D one of ``#$%&*|``, E the text of a document with a
smaller doc_id. The audit says, for every order of the five filters and every
value of a column (the part), what each step removes.

1. :func:`local_texts`: each task inserts its texts into a compressed trie, so
   copies within a slice are one text with its smallest id before anything is
   shuffled, and notes conditions A to D as a mask.
2. :func:`boundaries`: a sample of the distinct texts, sorted by Spark, gives range
   boundaries. Each is a text's shortest prefix that sets it apart from the text
   before it: short among different texts, long inside a group that begins alike.
3. :func:`first_holders`: the distinct texts are partitioned by these ranges, sorted
   (Spark spills) and inserted whole into tries of bounded size; a traversal gives
   each text's smallest id over the table. Only that number returns to the slices.
4. The masks are counted per part, with and without the labels, and the 120
   orders are worked out from at most 32 counts a part.

The boundaries decide the size of tasks only, never a result. A text is one row of
a task, so a hot text costs one row a slice.

Null text is empty. A row without a doc_id is no copy and makes none; rows of one
doc_id are no copies of each other. Every row counts by itself. A doc_id's labels
are the larger of repeated ones; a null part is the empty string. Other columns
are ignored. An empty table has no parts and no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import byte_texts, saved, slices
from tideline.llm.radix_trie import RadixTrie, shared

FILTERS = "ABCDE"
#: Distinct text that one trie holds, and the rows of one slice.
TRIE_BYTES = 32 << 20
SLICE_ROWS = 200_000
#: Text that one range should have, and how many ranges there are at most.
RANGE_BYTES = 64 << 20
MAX_RANGES = 16_384
SAMPLES_PER_RANGE = 16

_NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOL = re.compile(rb"[#$%&*|]")


def mask_of(text: bytes) -> int:
    """Conditions A to D as bits 0 to 3."""
    words = text.split()
    capitals = len(text.translate(None, _NOT_CAPITAL))
    points = len(text) if text.isascii() else len(text.translate(None, _CONTINUATION))
    return (
        (len(words) < 100)
        | (100 * len(set(words)) < 80 * len(words)) << 1
        | (100 * capitals > 10 * points) << 2
        | (_SYMBOL.search(text) is not None) << 3
    )


def local_texts(docs: DataFrame, part: Column, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Rows of two kinds: a document (``slice, term, doc_id, part, mask``) or a text (``slice, term, doc_id, text``).

    ``term`` numbers the distinct texts of a slice; a text's ``doc_id`` is its smallest there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        trie, masks, texts, held, rows = RadixTrie(), [], [], 0, 0
        names = ["slice", "term", "doc_id", "part", "mask", "text"]

        def cut() -> Iterator[pa.RecordBatch]:
            least = trie.least()
            for i in range(0, len(texts), 2000):
                own = texts[i : i + 2000]
                n = len(own)
                columns = [
                    pa.array([number] * n, pa.int64()), pa.array(range(i, i + n), pa.int32()), pa.array(least[i : i + n], pa.int64()),
                    pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.array(own, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in slices(batches):
            terms, own_masks = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text"))):
                term = trie.insert(text, doc)
                if term == len(texts):
                    texts.append(text)
                    masks.append(mask_of(text))
                    held += len(text)
                terms.append(term)
                own_masks.append(masks[term])
            n = batch.num_rows
            rows += n
            columns = [
                pa.array([number] * n, pa.int64()), pa.array(terms, pa.int32()), batch.column("doc_id"), batch.column("part"),
                pa.array(own_masks, pa.int32()), pa.nulls(n, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)
            if held > trie_bytes or rows > SLICE_ROWS:
                yield from cut()
                number += 1
                trie, masks, texts, held, rows = RadixTrie(), [], [], 0, 0
        if rows:
            yield from cut()

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), "text")
    return plain.mapInArrow(run, "slice bigint, term int, doc_id bigint, part string, mask int, text binary")


def boundaries(texts: DataFrame, range_bytes: int = RANGE_BYTES) -> list[bytes]:
    """Prefixes at which the ranges of texts begin, sorted; at most ``MAX_RANGES``."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MAX_RANGES, -(-size // range_bytes))
    if ranges < 2:
        return []
    # A text is drawn in proportion to its bytes.
    chance = F.octet_length("text") / F.lit(size / (ranges * SAMPLES_PER_RANGE))
    drawn = saved(texts.where(F.rand(1) < chance).select("text"))
    every = max(2, drawn.count() // ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, k = None, 0
        for batch in slices(batches):
            found = []
            for text in batch.column("text").to_pylist():
                if before is not None and before != text:
                    if k % every == every // 2:
                        found.append(text[: shared(before, text) + 1])
                    k += 1
                before = text
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["prefix"])

    ordered = drawn.repartitionByRange(8, "text").sortWithinPartitions("text")
    return sorted(r.prefix for r in ordered.mapInArrow(run, "prefix binary").collect())


def _front_coded(prefixes: list[bytes]) -> list[tuple[int, bytes]]:
    """Sorted prefixes without what they share with the one before, to send long ones once."""
    common = [shared(a, b) for a, b in zip([b"", *prefixes], prefixes)]
    return [(k, p[k:]) for k, p in zip(common, prefixes)]


def _spelled(coded: list[tuple[int, bytes]]) -> list[bytes]:
    out, before = [], b""
    for k, rest in coded:
        before = before[:k] + rest
        out.append(before)
    return out


def first_holders(texts: DataFrame, starts: list[bytes], trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``slice, term, first``: the smallest doc_id over the table that has the text."""
    coded = _front_coded(starts)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = _spelled(coded)
        for batch in slices(batches):
            ranges = pa.array([bisect_right(spelled, t) for t in batch.column("text").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([ranges, *batch.columns], ["range", *batch.schema.names])

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, rows, held, last = RadixTrie(), [], 0, None

        def cut() -> Iterator[pa.RecordBatch]:
            least = trie.least()
            for i in range(0, len(rows), 100_000):
                own = rows[i : i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s for s, _, _ in own], pa.int64()),
                        pa.array([t for _, t, _ in own], pa.int32()),
                        pa.array([least[k] for _, _, k in own], pa.int64()),
                    ],
                    ["slice", "term", "first"],
                )

        for batch in slices(batches):
            columns = (batch.column(c).to_pylist() for c in ("slice", "term", "doc_id", "text"))
            for piece, term, doc, text in zip(*columns):
                if rows and text != last and (held > trie_bytes or len(rows) >= SLICE_ROWS):
                    yield from cut()
                    trie, rows, held = RadixTrie(), [], 0
                elif len(rows) >= SLICE_ROWS:
                    # Rows of one text come in the order of their ids, so its first is known.
                    yield from cut()
                    rows = []
                held += len(text) if text != last else 0
                rows.append((piece, term, trie.insert(text, doc)))
                last = text
        if rows:
            yield from cut()

    routed = texts.select("slice", "term", "doc_id", "text").mapInArrow(route, "range int, slice bigint, term int, doc_id bigint, text binary")
    ordered = routed.repartition("range").sortWithinPartitions("range", "text", F.asc_nulls_last("doc_id"))
    return ordered.mapInArrow(tries, "slice bigint, term int, first bigint")


def failed_masks(docs: DataFrame, part: Column, trie_bytes: int = TRIE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``doc_id, part, mask``: the conditions that each document fails, A to E as bits 0 to 4."""
    local = saved(local_texts(docs, part, trie_bytes))
    texts = local.where("mask is null")
    first = first_holders(texts, boundaries(texts, range_bytes), trie_bytes)
    own = local.where("mask is not null").drop("text").join(first, ["slice", "term"])
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return own.select("doc_id", "part", (F.col("mask") + 16 * copy).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents, and those labelled of good quality and toxic."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    known = known.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    joined = masks.join(known, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("bad").alias("toxic")
    )


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counts of each mask.

    ``kept`` after the step, ``removed`` here, ``redundant`` (failing here but
    removed before), ``unique_fails`` (failing this filter only), ``good_lost`` and
    ``toxic_lost`` (removed here and labelled so), ``shapley`` (removed by this
    filter, summed over all orders).
    """
    steps = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            steps.append((order, step, before, bit))
            before |= bit
    fields = ("filter_order", "step", "before", "bit")
    fixed = F.array(*(F.struct(*(F.lit(v).alias(f) for v, f in zip(s, fields))) for s in steps))
    each = counts.select("*", F.explode(fixed).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    mask, before, bit = F.col("mask"), F.col("before"), F.col("bit")
    fails, gone = mask.bitwiseAND(bit) > 0, mask.bitwiseAND(before) > 0
    here = fails & ~gone
    # A filter comes first among the ones a document fails in an equal share of all orders.
    share = F.lit(len(steps) // len(FILTERS)) / F.bit_count(mask)
    total = lambda x, when: F.sum(F.when(when, x).otherwise(0)).cast("bigint")
    return each.groupBy("part", "filter_order", F.col("step").cast("int").alias("step")).agg(
        total(F.col("n"), ~fails & ~gone).alias("kept"),
        total(F.col("n"), here).alias("removed"),
        total(F.col("n"), fails & gone).alias("redundant"),
        total(F.col("n"), mask == bit).alias("unique_fails"),
        total(F.col("good"), here).alias("good_lost"),
        total(F.col("toxic"), here).alias("toxic_lost"),
        total(F.col("n") * share.cast("bigint"), fails).alias("shapley"),
    )
