"""Helpers the corpus operators share: stored results and hashed words.

Words are the runs between ASCII white space, ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"\x20\x09-\x0D"
WHITE_CHARS = " \t\n\x0b\x0c\r"

_scratch: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; in local mode, where it is unset, a scratch one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = tempfile.mkdtemp(prefix="run-")
    return _scratch[app]


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def saved(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write a result as a table in the shared folder and read it back.

    Cuts the lineage for good (a lost executor costs nothing that was saved),
    and lets Spark plan later joins by the measured size of the files.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, codec: str = "snappy") -> DataFrame:
    """As ``saved``, but with the rows of a key in one bucket, so that a later grouping by it moves none of them."""
    spark, name = df.sparkSession, f"saved_{uuid.uuid4().hex}"
    # 100,000 is the most buckets Spark allows.
    writer = df.write.option("compression", codec).option("path", new_folder(spark))
    writer.bucketBy(min(max(1, buckets), 100_000), key).saveAsTable(name, format="parquet")
    return spark.table(name)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def power_of_two(least: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, least)))))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``limit`` bytes of text each (a longer text comes alone)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()


def byte_texts(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number of words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that every bit depends on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(k: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{seed}:{j}") | 1 for j in range(k)], np.uint64)


def windows(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of every k consecutive words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, a in enumerate(multipliers(k, seed)):
        out += words[j : j + n] * a
        out ^= out >> np.uint64(29)
    return mixed(out)


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as Spark's bigint, bit for bit."""
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


def unsigned(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
