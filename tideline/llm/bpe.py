"""Byte-level BPE encoding and decoding with Spark's higher-order functions (operator 4).

Encoding, in four steps:

1. *Cut.* Each text is cut by the tokenizer's pattern. Up to ``SLICE`` bytes of text
   become one row: the place of every piece in text order, and the distinct
   pieces that have no id of their own (the others are their id already).
2. *Distinct.* These pieces are made distinct over the whole table, so that
   each is merged once, whatever the number of its copies. They travel as
   compressed blocks, one for each slice and range of hashes, once: of a block
   the numbers of its pieces stay beside the distinct ones.
3. *Fold.* Spark folds the ranked merges over the array of byte ids of each
   distinct piece, one piece a row: the state holds the parts and, between them,
   the rank of every neighbouring pair, each step joins the leftmost pair of the
   lowest rank. The rank map is one constant: rows of right neighbours laid over one
   another in an array, so that a look-up is one read. It is stored once and read by a
   subquery, because a literal's text would stand in every description of the plan.
4. *Restore.* The ids go back to the blocks, the blocks to their slices, and
   each slice puts them in text order. A hot piece counts once a slice.

Decoding looks every id up in a constant array and concatenates the binary
pieces, ``CHUNK`` at a time in ``LEVELS`` levels, so that no long result is copied per id.

The fold looks at all neighbours of a part in every step, so its cost grows with
the square of a piece's length. Pieces over ``LONG`` bytes (no
word is) are merged by a heap instead, with the same result.

Null text counts as empty and has no ids. Unknown ids cannot be decoded and
raise. Repeated rows are encoded alike. Other columns than ``doc_id`` and
``text`` are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import bucketed, power_of_two, saved, slices

SLICE = 8 << 20
#: Pieces without an id, over all slices, that are made distinct in one group.
PIECES_PER_SHARD = 100_000
LONG = 256
#: Bits of an id in a cell of the rank map, and a cell that no row owns.
BITS = 20
EMPTY = 1 << 2 * BITS + 1
#: Added to the parts in the fold's state, above every rank and what stands for none.
PART = 1 << 2 * BITS + 2
#: Pieces of text that are put in order at a time (a longer text comes alone).
BLOCK = 1 << 18
#: Binary pieces that are concatenated at a time, and how often before the rest is.
CHUNK = 16
LEVELS = 5


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tokenizer file: one base64 piece and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def _literal(values: list, kind: str) -> Column:
    """A constant array in the plan."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), kind)


def _constants(df: DataFrame, **values: pa.Array) -> DataFrame:
    """``df`` with constant arrays as columns, by subqueries.

    The driver writes a plan's text anew after each stage and keeps it, so no constant
    should be in it. Spark puts the subquery in the place of a column that is named
    once afterwards; named twice, it would be copied to every row.
    """
    one = {name: pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array) for name, array in values.items()}
    stored = saved(df.sparkSession.createDataFrame(pa.table(one)))
    return df.withColumns({name: stored.select(name).scalar() for name in values})


def pair_rows(ranks: dict[bytes, int]) -> dict[int, dict[int, int]]:
    """For each part its right neighbours, and what both join to."""
    rows: dict[int, dict[int, int]] = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                rows.setdefault(left, {})[right] = rank
    return rows


def reached(ranks: dict[bytes, int]) -> dict[int, dict[int, int]]:
    """The pairs of ``pair_rows`` that merging can meet, at most one for each piece.

    Parts that lie side by side were merged without a look across their outer
    ends, so as in the piece they join to when it stands alone. That piece, merged
    down to two parts, gives the only such pair.
    """
    rows: dict[int, dict[int, int]] = {}
    for piece, rank in ranks.items():
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            pairs = [ranks.get(a + b, EMPTY) for a, b in zip(parts, parts[1:])]
            i = pairs.index(least := min(pairs))
            if least == EMPTY:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2 and parts[0] in ranks and parts[1] in ranks:
            rows.setdefault(ranks[parts[0]], {})[ranks[parts[1]]] = rank
    return rows


def packed(rows: dict[int, dict[int, int]], size: int) -> tuple[list[int], list[int]]:
    """The rows laid over one another in one array, and where each row starts.

    A cell holds the row's number above ``BITS`` bits and the value below, so a
    look-up is one read and an exclusive or: what is left is under ``2**BITS``
    only if the cell is the row's own. Larger rows choose their place first.
    """
    starts = np.zeros(size, np.int64)
    room = 2 * sum(map(len, rows.values()))
    cells = np.full(room + size, EMPTY, np.int64)
    drawn = np.random.default_rng(0)
    for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        rights = np.fromiter(row, np.int64, len(row))
        fits = np.zeros(0, np.int64)
        while not len(fits):
            at = drawn.integers(0, room, 64)
            fits = at[(cells[at[:, None] + rights] == EMPTY).all(axis=1)]
            if not len(fits):
                # Fuller than a row this long can bear: a little more room at the end.
                room += 64
                cells = np.r_[cells, np.full(64, EMPTY, np.int64)]
        starts[left] = fits[0]
        cells[fits[0] + rights] = (left << BITS) | np.fromiter(row.values(), np.int64, len(row))
    return starts.tolist(), cells.tolist()


def _let(value: Column, body) -> Column:
    """Bind a value once inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rank_map(ranks: dict[bytes, int]) -> tuple[pa.Array, pa.Array]:
    """Starts and cells of :func:`packed`; a cell without a row is null, and none follows the last one with."""
    starts, cells = packed(reached(ranks), edge(ranks) + 1)
    short = [None if c == EMPTY else c for c in cells]
    return pa.array(starts, pa.int64()), pa.array(short[: 1 + max((i for i, c in enumerate(short) if c is not None), default=0)], pa.int64())


def encoded_piece(parts: Column, starts: Column, cells: Column) -> Column:
    """The ids of a piece, given as the ids of its bytes between two ``edge(ranks)``; null of null."""
    # Bound once, so that the plan names each array once.
    each = lambda s, c: _folded(parts, s, c)
    return _let(starts, lambda s: _let(cells, lambda c: each(s, c)))


def _folded(parts: Column, starts: Column, cells: Column) -> Column:
    rest = F.lit(1 << 30)

    def rank(a: Column, b: Column) -> Column:
        """The rank of the pair, or a number from ``2**BITS`` to ``PART`` if it has none."""
        return F.coalesce(F.get(cells, F.get(starts, a) + b).bitwiseXOR(F.shiftleft(a, BITS)), F.lit(PART))

    def step(state: Column) -> Column:
        def joined(least: Column) -> Column:
            def rebuilt(k: Column) -> Column:
                """k: 1-based place of the rank of the pair that is joined; the edges are never part of one."""
                before, after = F.get(state, k - 4) - PART, F.get(state, k + 2) - PART
                new = F.array(rank(before, least), least + PART, rank(least, after))
                return F.concat(F.slice(state, F.lit(1), k - 3), new, F.slice(state, k + 3, rest))

            return F.when(least < 1 << BITS, _let(F.array_position(state, least).cast("int"), rebuilt)).otherwise(state)

        return _let(F.array_min(state), joined)

    # Part, rank, part, rank and so on; nothing follows the last edge.
    ranked = lambda x, i: F.array(x + PART, rank(x, F.get(parts, i + 1)))
    return F.aggregate(
        F.slice(parts, F.lit(4), rest),
        F.flatten(F.transform(parts, ranked)),
        lambda state, _: step(state),
        lambda state: F.transform(
            F.filter(F.slice(state, F.lit(3), F.size(state) - 4), lambda _, i: i % 2 == 0), lambda x: x - PART
        ),
    )


def edge(ranks: dict[bytes, int]) -> int:
    """The id that stands before and after a piece; no pair has it."""
    return max(ranks.values(), default=-1) + 1


def byte_parts(pieces: list[bytes], ranks: dict[bytes, int]) -> pa.ListArray:
    """Per piece the ids of its bytes, or its own id where it has one, between two edges; null if longer than ``LONG``."""
    whole = {i: rank for i, p in enumerate(pieces) if (rank := ranks.get(p)) is not None}
    long = np.fromiter((len(p) > LONG for p in pieces), bool, len(pieces))
    taken = [b"\0" if i in whole else b"" if long[i] else p for i, p in enumerate(pieces)]
    sizes = np.fromiter(map(len, taken), np.int64, len(taken))
    ids = np.array([ranks.get(bytes([x]), -1) for x in range(256)], np.int64)
    ends = np.cumsum(np.where(long, 0, sizes + 2))
    flat = np.full(ends[-1] if len(ends) else 0, edge(ranks), np.int64)
    # A piece's bytes go one place after its first edge.
    at = np.arange(sizes.sum()) + np.repeat(ends - 1 - np.cumsum(sizes), sizes)
    flat[at] = ids[np.frombuffer(b"".join(taken), np.uint8)]
    if whole:
        flat[ends[list(whole)] - 2] = list(whole.values())
    if (flat < 0).any():
        raise ValueError("a byte has no id")
    offsets = pa.array(np.r_[0, ends], pa.int32(), mask=np.r_[long, False])
    return pa.ListArray.from_arrays(offsets, pa.array(flat))


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece by a heap of pairs: leftmost of the lowest rank first."""
    if piece in ranks:
        return [ranks[piece]]
    ends = list(range(1, len(piece) + 1))  # end of the part that starts here, 0 once it is joined to an earlier one
    before = list(range(-1, len(piece) - 1))

    def pair(i: int) -> tuple[int, int, int] | None:
        j = ends[i]
        if j >= len(piece):
            return None
        rank = ranks.get(piece[i : ends[j]])
        return None if rank is None else (rank, i, ends[j])

    heap = [x for i in range(len(piece)) if (x := pair(i))]
    heapq.heapify(heap)
    while heap:
        rank, i, end = heapq.heappop(heap)
        if not ends[i] or (now := pair(i)) is None or now != (rank, i, end):
            continue
        j = ends[i]
        ends[i], ends[j] = end, 0
        if end < len(piece):
            before[end] = i
        for k in (before[i], i):
            if k >= 0 and (x := pair(k)):
                heapq.heappush(heap, x)
    out, i = [], 0
    while i < len(piece):
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class _Places(dict):
    """The id of a piece that has one; of the others, in order of appearance, -1, -2 and so on."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.unknown = ranks, []

    def __missing__(self, piece: str) -> int:
        data = piece.encode()
        place = self.ranks.get(data)
        if place is None:
            self.unknown.append(data)
            place = -len(self.unknown)
        self[piece] = place
        return place


def _blob(items: list[bytes]) -> bytes:
    """Byte strings as one compressed value: their number, their sizes, and the bytes."""
    return _joined_blob(np.fromiter(map(len, items), np.int64, len(items)), b"".join(items))


def _joined_blob(sizes: np.ndarray, joined: bytes) -> bytes:
    return zstandard.compress(len(sizes).to_bytes(4, "little") + sizes.astype("<u4").tobytes() + joined, 3)


def _opened(blob: bytes) -> tuple[np.ndarray, bytes]:
    """The sizes and the joined bytes of a blob."""
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    return np.frombuffer(raw, "<u4", n, 4).astype(np.int64), raw[4 + 4 * n :]


def _items(blob: bytes) -> list[bytes]:
    sizes, joined = _opened(blob)
    ends = np.cumsum(sizes)
    return [joined[i:j] for i, j in zip((ends - sizes).tolist(), ends.tolist())]


def _numbers(values: np.ndarray) -> bytes:
    """Whole numbers from 0 to 2**32 - 1, compressed byte by byte plane."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def _from_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _hashes(pieces: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces))


def cut_pieces(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``slice, doc_ids, sizes, at, order, n, pieces``: at most ``SLICE`` bytes of text a row, or one longer text.

    ``pieces`` are the ``n`` distinct ones without an id by order of hash. ``order`` lists them by
    falling frequency; ``at`` holds the pieces in text order, ``2 * id``, or ``2 * i + 1`` for the i-th of ``order``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, number = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32
        places, at, docs, held = _Places(ranks), [], [], 0

        def row() -> pa.RecordBatch:
            by_hash = np.argsort(_hashes(places.unknown), kind="stable")
            place, rank = np.empty(len(by_hash), np.int32), np.empty(len(by_hash), np.int32)
            place[by_hash] = np.arange(len(by_hash), dtype=np.int32)
            codes = np.concatenate(at)
            unknown = codes < 0
            own = -1 - codes[unknown]
            by_count = np.argsort(-np.bincount(own, minlength=len(by_hash)), kind="stable")
            rank[by_count] = np.arange(len(by_hash), dtype=np.int32)
            codes *= 2
            codes[unknown] = 2 * rank[own] + 1
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    one(pa.concat_arrays(docs)),
                    one(pa.array([len(x) for x in at], pa.int32())),
                    pa.array([_numbers(codes)], pa.binary()),
                    pa.array([_numbers(place[by_count])], pa.binary()),
                    pa.array([len(by_hash)], pa.int64()),
                    pa.array([_blob([places.unknown[i] for i in by_hash.tolist()])], pa.binary()),
                ],
                ["slice", "doc_ids", "sizes", "at", "order", "n", "pieces"],
            )

        for batch in slices(batches):
            size = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            if docs and held + size > SLICE:
                yield row()
                places, at, docs, held, number = _Places(ranks), [], [], 0, number + 1
            for text in batch.column("text").to_pylist():
                at.append(np.fromiter(map(places.__getitem__, find(text or "")), np.int32))
            docs.append(batch.column("doc_id"))
            held += size
        if docs:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(
        cut, f"slice bigint, doc_ids array<{kind}>, sizes array<int>, at binary, order binary, n bigint, pieces binary"
    )


def split_pieces(cut: DataFrame, shards: int) -> DataFrame:
    """``slice, shard, pieces``: the pieces of each slice by the upper bits of their hash."""
    shift = np.uint64(64 - (shards.bit_length() - 1))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("slice").to_pylist(), batch.column("pieces").to_pylist()):
                pieces = _items(blob)
                shard = (_hashes(pieces) >> shift).astype(np.int32) if shards > 1 else np.zeros(len(pieces), np.int32)
                own, first = np.unique(shard, return_index=True)
                blobs = [_blob(pieces[i:j]) for i, j in zip(first, [*first[1:], len(pieces)])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(own), pa.int64()), pa.array(own), pa.array(blobs, pa.binary())],
                    ["slice", "shard", "pieces"],
                )

    return cut.select("slice", "pieces").mapInArrow(split, "slice bigint, shard int, pieces binary")


def merged_pieces(pieces: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``shard, i, ids`` for every row ``shard, i, piece``; further columns follow. A null piece has no ids."""
    more = [f for f in pieces.schema if f.name not in ("shard", "i", "piece")]
    names = [f.name for f in more]

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [p or b"" for p in batch.column("piece").to_pylist()]
            parts = byte_parts(own, ranks).cast(pa.list_(pa.int64()))
            by_heap = pa.array([merged(p, ranks) if len(p) > LONG else None for p in own], pa.list_(pa.int64()))
            columns = [batch.column("shard"), batch.column("i"), parts, by_heap, *(batch.column(c) for c in names)]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "i", "parts", "long", *names])

    kinds = ["shard int, i int, parts array<bigint>, long array<bigint>", *(f"{f.name} {f.dataType.simpleString()}" for f in more)]
    starts, cells = rank_map(ranks)
    rows = _constants(pieces.mapInArrow(spelled, ", ".join(kinds)), _starts=starts, _cells=cells)
    ids = F.when(F.col("parts").isNull(), F.col("long")).otherwise(encoded_piece(F.col("parts"), F.col("_starts"), F.col("_cells")))
    return rows.select("shard", "i", ids.cast("array<int>").alias("ids"), *names)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id, ids, data`` of every row of ``docs``: the ids, and the same as little-endian unsigned 32-bit numbers."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # The ids come to the slices, which are large and stay where they are written.
    cut = bucketed(cut_pieces(docs, ranks, pattern), "slice", docs.rdd.getNumPartitions())
    total = cut.agg(F.sum("n")).first()[0] or 0
    # Few bytes make much work here, so the tasks are the session's number and not merged by size.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = split_pieces(cut, power_of_two(total / PIECES_PER_SHARD)).repartition(tasks, "shard")

    def distinct(key: tuple, rows: pa.Table) -> pa.Table:
        """A row for each distinct piece, and one for each block with the numbers of its pieces, as steps."""
        blocks = [_items(b) for b in rows.column("pieces").to_pylist()]
        found = list({p for block in blocks for p in block})
        # Blocks are in order of hash, so most steps are small.
        found = [found[k] for k in np.argsort(_hashes(found)).tolist()]
        number = dict(zip(found, range(len(found))))
        steps = [np.diff(np.fromiter(map(number.__getitem__, b), np.int64, len(b)), prepend=0).astype(np.uint32) for b in blocks]
        own, members = len(found), len(blocks)
        return pa.table(
            {
                "shard": np.full(own + members, key[0].as_py(), np.int32),
                "i": pa.array([*range(own), *[None] * members], pa.int32()),
                "piece": pa.array([*found, *[None] * members], pa.binary()),
                "of": pa.array([*[None] * own, *rows.column("slice").to_pylist()], pa.int64()),
                "steps": pa.array([*[None] * own, *map(_numbers, steps)], pa.binary()),
            }
        )

    pieces = split.groupBy("shard").applyInArrow(distinct, "shard int, i int, piece binary, of bigint, steps binary")
    # As many buckets as tasks, dealt by the same hash: each task writes one, and the answers need no shuffle.
    known = bucketed(merged_pieces(pieces, ranks), "shard", tasks, "zstd")

    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        blocks = rows.filter(pc.is_valid(rows.column("of")))
        lists = _one_array(rows.filter(pc.is_null(rows.column("of"))).sort_by("i").column("ids"))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values, counts = lists.values.to_numpy(zero_copy_only=False).astype("<i4"), np.diff(offsets)
        blobs = []
        for steps in blocks.column("steps").to_pylist():
            own = np.cumsum(_from_numbers(steps), dtype=np.uint32)
            sizes = counts[own]
            ends = np.cumsum(sizes)
            ids = values[np.repeat(offsets[own] - ends + sizes, sizes) + np.arange(sizes.sum())]
            blobs.append(_joined_blob(4 * sizes, ids.tobytes()))
        return pa.table({"of": blocks.column("of"), "shard": blocks.column("shard"), "ids": pa.array(blobs, pa.binary())})

    answers = known.groupBy("shard").applyInArrow(answer, "of bigint, shard int, ids binary")

    def restore(texts: pa.Table, found: pa.Table) -> pa.Table:
        codes = _from_numbers(texts.column("at")[0].as_py())
        order = _from_numbers(texts.column("order")[0].as_py())
        # Shards are ranges of the hash, so one after the other they give the pieces' order.
        blobs = [_opened(b) for b in found.sort_by("shard").column("ids").to_pylist()]
        values = np.frombuffer(b"".join(joined for _, joined in blobs), "<i4")
        counts = np.concatenate([sizes for sizes, _ in blobs] or [np.empty(0, np.int64)]) // 4
        offsets = np.cumsum(counts) - counts

        def block(codes: np.ndarray, tops: np.ndarray, docs: pa.Array) -> pa.Table:
            # A code is an id of its own or leads to a list; both as a stretch of one array.
            unknown = (codes & 1).astype(bool)
            source = order[codes[unknown] >> 1]
            starts, sizes = np.zeros(len(codes), np.int64), np.ones(len(codes), np.int64)
            starts[unknown], sizes[unknown] = offsets[source], counts[source]
            ends = np.cumsum(sizes)
            flat = np.empty(ends[-1] if len(ends) else 0, np.int32)
            flat[(ends - sizes)[~unknown]] = codes[~unknown] >> 1
            spread = np.flatnonzero(np.repeat(unknown, sizes))
            flat[spread] = values[np.repeat((starts - ends + sizes)[unknown], sizes[unknown]) + spread]
            bounds = np.r_[0, ends][np.r_[0, tops]]
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))
            # The same memory, read as bytes.
            ends = pa.array(4 * bounds, pa.int64()).cast(pa.int32()).buffers()[1]
            data = pa.Array.from_buffers(pa.binary(), len(docs), [None, ends, pa.py_buffer(flat.astype("<i4", copy=False))])
            return pa.table({"doc_id": docs, "ids": ids, "data": data})

        docs, tops = texts.column("doc_ids")[0].values, np.cumsum(texts.column("sizes")[0].values.to_numpy(), dtype=np.int64)
        done, start, base = [], 0, 0
        while start < len(tops):
            stop = max(start + 1, int(np.searchsorted(tops, base + BLOCK, side="right")))
            done.append(block(codes[base : tops[stop - 1]], tops[start:stop] - base, docs[start:stop]))
            start, base = stop, int(tops[stop - 1])
        return pa.concat_tables(done)

    texts = cut.select("slice", "doc_ids", "sizes", "at", "order")
    return texts.groupBy("slice").cogroup(answers.groupBy("of")).applyInArrow(restore, f"doc_id {kind}, ids array<int>, data binary")


def _one_array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _chunks(parts: Column, size: Column, none: Column, piece: Callable[[Column], Column] = lambda x: x) -> Column:
    """Every ``CHUNK`` of the ``size`` parts as one, by way of ``piece``; ``none`` fills up the last one."""
    return _let(
        F.concat(parts, F.array_repeat(none, CHUNK)),
        lambda p: F.transform(
            F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(CHUNK)),
            lambda start: F.concat(*(piece(F.get(p, start + k)) for k in range(CHUNK))),
        ),
    )


def pieces_by_id(ranks: dict[bytes, int]) -> list[bytes | None]:
    """The piece of every id up to the last one, and an empty one."""
    pieces: list[bytes | None] = [*[None] * edge(ranks), b""]
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids."""
    pieces = [None if p is None else base64.b64encode(p).decode() for p in pieces_by_id(ranks)]
    return _decoded(ids, _literal(pieces, "array<binary>"), edge(ranks))


def with_decoded(df: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``df`` and, as ``decoded``, the bytes of its ``ids``; the same as :func:`decoded` without its literal."""
    rows = _constants(df, _names=pa.array(pieces_by_id(ranks), pa.binary()))
    return rows.select(*df.columns, _decoded(F.col("ids"), F.col("_names"), edge(ranks)).alias("decoded"))


def _decoded(ids: Column, pieces: Column, last: int) -> Column:
    # An id without a piece gives null, and with it the whole.
    nothing = F.lit(last)

    def joined(pieces: Column) -> Column:
        some = _chunks(ids, F.size(ids), nothing, lambda i: F.get(pieces, i))
        for _ in range(LEVELS - 1):
            some = _let(some, lambda p: _chunks(p, F.size(p), F.lit(b"")))
        return F.aggregate(some, F.lit(b""), lambda done, part: F.concat(done, part))

    none = F.raise_error(F.lit("id without a piece")).cast("binary")
    # The empty piece only fills up; as an id of a text its number has no piece.
    return F.when(F.array_contains(ids, nothing), none).when(ids.isNotNull(), F.coalesce(_let(pieces, joined), none))
