"""Exact dedup by counting quotient filters (operator 7).

1. Every text gets a 64-bit fingerprint and the SHA-256 of its normalised form
   (A-Z lower-cased, null as empty); this small table is saved.
2. Each partition builds counting quotient filters of its fingerprints, one per
   range of fingerprints; the filters of a range are merged by their sorted
   remainders. A text with a million copies is one counted slot per partition.
3. Only fingerprints with a count above one go on to byte verification: their
   texts are read again and grouped by the bytes themselves.
4. The documents are joined to the verified classes by fingerprint and digest.

Rows are told apart by a row number of the saved table, so of rows repeated
with the same ``doc_id`` and text exactly one is kept. A null ``doc_id`` is
smaller than any other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import power_of_two, saved, signed, slices, unsigned
from tideline.llm.quotient_filter import CountingQuotientFilter

PRINTS_PER_FILTER = 500_000


def fingerprint(text: Column, bits: int = 64) -> Column:
    """The upper ``bits`` of a hash that all texts equal up to case share; byte verification tells the rest apart."""
    full = F.xxhash64(F.lower(F.coalesce(text, F.lit(""))))
    return full if bits == 64 else F.shiftleft(F.shiftrightunsigned(full, 64 - bits), 64 - bits)


def _lowered(column: pa.Array) -> pa.Array:
    return pc.fill_null(pc.ascii_lower(column), "")


def digests(docs: DataFrame, bits: int = 64) -> DataFrame:
    """``row, doc_id, fp, sha``: one small row per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = _lowered(batch.column("text")).cast(pa.binary()).to_pylist()
            sha = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("fp"), sha], ["row", "doc_id", "fp", "sha"]
            )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text", fingerprint(F.col("text"), bits).alias("fp")
    )
    return rows.mapInArrow(digest, f"row bigint, doc_id {kind}, fp bigint, sha binary")


def partition_filters(prints: DataFrame, ranges: int) -> DataFrame:
    """``range, filter``: the filters of each partition, one per range of fingerprints that it has."""
    shift = np.uint64(64 - (ranges.bit_length() - 1)) if ranges > 1 else None

    def cut(values: np.ndarray) -> pa.RecordBatch:
        values, counts = np.unique(values, return_counts=True)
        part = (values >> shift).astype(np.int32) if shift is not None else np.zeros(len(values), np.int32)
        own, first = np.unique(part, return_index=True)
        ends = np.r_[first[1:], len(values)]
        blobs = [CountingQuotientFilter.of(values[i:j], counts[i:j]).to_bytes() for i, j in zip(first, ends)]
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(blobs, pa.binary())], ["range", "filter"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(unsigned(batch.column("fp")))
            n += batch.num_rows
            if n >= 4_000_000:
                yield cut(np.concatenate(held))
                held, n = [], 0
        if n:
            yield cut(np.concatenate(held))

    return prints.select("fp").mapInArrow(build, "range int, filter binary")


def merged_filters(filters: DataFrame) -> DataFrame:
    """One filter per range, merged without loss."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        parts = [CountingQuotientFilter.from_bytes(b) for b in table.column("filter").to_pylist()]
        whole = parts[0].merged(*parts[1:]) if len(parts) > 1 else parts[0]
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([whole.to_bytes()], pa.binary())})

    return filters.groupBy("range").applyInArrow(merge, "range int, filter binary")


def repeated_prints(filters: DataFrame) -> DataFrame:
    """``fp, n`` of every fingerprint counted more than once."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("filter").to_pylist():
                prints, counts = CountingQuotientFilter.from_bytes(blob).items()
                more = counts > 1
                yield pa.RecordBatch.from_arrays([signed(prints[more]), signed(counts[more])], ["fp", "n"])

    return filters.mapInArrow(items, "fp bigint, n bigint")


def verified_classes(docs: DataFrame, repeated: DataFrame, bits: int = 64) -> DataFrame:
    """``fp, sha, size``: classes of texts equal byte by byte among the repeated fingerprints."""

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("fp"), _lowered(batch.column("text"))], ["fp", "text"])

    texts = docs.select("text", fingerprint(F.col("text"), bits).alias("fp"))
    texts = texts.join(repeated.select("fp"), "fp", "left_semi").select("fp", "text")
    # Grouping by the text is the byte comparison; copies collapse before the shuffle.
    classes = texts.mapInArrow(lower, "fp bigint, text string").groupBy("fp", "text").agg(F.count("*").alias("size"))
    return classes.select("fp", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "size").filter("size > 1")


def exact_dedup(docs: DataFrame, bits: int = 64, prints_per_filter: int = PRINTS_PER_FILTER) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, fp`` for every row of ``docs``."""
    rows = saved(digests(docs, bits))
    ranges = power_of_two(max(8, rows.count() / prints_per_filter))
    repeated = saved(repeated_prints(merged_filters(partition_filters(rows, ranges))))
    verified = saved(verified_classes(docs, repeated, bits))
    keepers = (
        rows.join(verified.select("fp", "sha"), ["fp", "sha"], "left_semi")
        .groupBy("fp", "sha")
        .agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("n"))
    )
    classes = (
        keepers.join(verified, ["fp", "sha"])
        .select(
            "fp",
            "sha",
            "keep",
            # A class has as many rows as byte verification found copies.
            F.when(F.col("n") == F.col("size"), F.col("n"))
            .otherwise(F.raise_error(F.lit("texts with equal digests differ")).cast("bigint"))
            .alias("n"),
        )
    )
    return rows.join(classes, ["fp", "sha"], "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "fp",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` with their columns; of rows repeated with one ``doc_id`` and text, one."""
    verdict = saved(exact_dedup(docs).select("doc_id", "fp", "kept", "group_size").filter("group_size > 1"))
    drop = verdict.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")).distinct()
    keep = verdict.filter("kept").select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"))
    # Rows that share both doc_id and fingerprint with the one that stays.
    ties = saved(keep.join(drop, [keep["_id"].eqNullSafe(drop["_id"]), keep["_fp"] == drop["_fp"]], "left_semi"))
    match = lambda other: docs["doc_id"].eqNullSafe(other["_id"]) & (fingerprint(docs["text"]) == other["_fp"])
    unique = docs.join(drop, match(drop), "left_anti")
    if ties.isEmpty():
        return unique
    same = docs.join(ties, match(ties), "left_semi")
    key = F.struct("doc_id", F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    one = same.select(F.struct("*").alias("_doc"), key.alias("_key")).dropDuplicates(["_key"]).select("_doc.*")
    return unique.unionByName(one)
