"""Prefix trie over conversations (operator 12).

A node is a distinct sequence of first turns; its members are the conversations
that start with it, the textless root has all of them.

1. Every turn becomes a 128-bit digest of role and text; a conversation is the
   string of its digests. Spark range-partitions and sorts the conversations by
   it, so the members of a node are neighbours, and those of one hot prefix
   spread over many ranges (``conv_id`` is part of the range key).
2. A task cuts its range into blocks of at most ``CELLS`` cells. Per block the
   digests become small numbers in a padded matrix; ``numpy.lexsort`` orders the
   rows, column changes accumulated by OR along the columns mark where the nodes
   of each depth start, and ``reduceat`` aggregates every depth from the deepest up.
3. Only nodes on the paths of a block's first and last row can continue in
   other blocks. These boundary nodes are recombined by a digest of their path:
   counts add up; each one's own leaf and saving is added once, in one block,
   along the path above it. Everything else is final in its block.

A conversation is one row: 20 bytes a turn in one task. The ids that a hot node
ends with are hashed as one stream by one task, 8 bytes each and in bounded
chunks, because SHA-256 has no parallel form.

Rows without a conv_id belong to no conversation. A null turn comes first; equal
turns are ordered by their digests, so repeated rows are repeated turns. Null role
and text are empty. Other columns are ignored. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import saved

#: Cells of one padded matrix; a longer conversation is a block of its own.
CELLS = 2_000_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

BLOCK_SCHEMA = (
    "block bigint, conv_id bigint, depth bigint, parent_conv_id bigint, side int, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string, key binary, parent_key binary, words bigint, ends binary, own boolean"
)

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``conv_id, ids, words``: hexadecimal digest and number of words of every turn, in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        F.col("turn").isNotNull().alias("known"),
        F.coalesce("turn", F.lit(0)).alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    )
    lists = (
        conversations.where("conv_id is not null")
        .groupBy(F.col("conv_id").cast("bigint").alias("conv_id"))
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    )
    return lists.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words"))


def _numbered(paths: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Padded matrix of turn numbers (0: no turn) that sort as the digests do, and the lengths."""
    lengths = np.array([len(p) // 16 for p in paths])
    halves = np.frombuffer(b"".join(paths), ">u8").astype(np.uint64).reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    new = np.ones(len(order), np.int32)
    if len(order):
        new[1:] = (halves[order[1:]] != halves[order[:-1]]).any(axis=1)
    number = np.empty(len(order), np.int32)
    number[order] = np.cumsum(new)
    return _padded(number, lengths), lengths


def _padded(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    matrix = np.zeros((len(lengths), max(int(lengths.max()), 1)), values.dtype)
    first = np.cumsum(lengths) - lengths
    matrix[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(first, lengths)] = values
    return matrix


def _path_keys(path: bytes) -> list[bytes]:
    """A digest of each prefix of a path, the empty one first."""
    h, keys = xxhash.xxh3_128(), []
    for d in range(len(path) // 16 + 1):
        keys.append(h.digest())
        h.update(path[16 * d : 16 * d + 16])
    return keys


def _joined_ids(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def block_nodes(block: int, conv: np.ndarray, paths: list[bytes], words: list[np.ndarray]) -> dict[str, list]:
    """Nodes of one block as columns of ``BLOCK_SCHEMA``; ``key`` is set for boundary nodes only."""
    turns, lengths = _numbered(paths)
    order = np.lexsort((conv, *turns.T[::-1]))
    turns, lengths, conv = turns[order], lengths[order], conv[order]
    counts = _padded(np.concatenate(words) if words else np.empty(0, np.int64), np.array([len(w) for w in words]))[order]
    n, width = turns.shape
    changed = np.ones((n, width), bool)
    changed[1:] = np.logical_or.accumulate(turns[1:] != turns[:-1], axis=1)
    first, last = paths[order[0]], paths[order[-1]]
    keys = _path_keys(first), _path_keys(last)

    out: dict[str, list] = {name.split()[0]: [] for name in BLOCK_SCHEMA.split(", ")}
    leaves, savings = np.zeros(n, np.int64), np.zeros(n, np.int64)
    # The runs of rows with equal prefixes, depth by depth; depth 0 is one run.
    for d in range(int(lengths.max()), -1, -1):
        start = np.flatnonzero(changed[:, d - 1]) if d else np.zeros(1, np.int64)
        real = turns[start, d - 1] > 0 if d else np.ones(1, bool)
        size = np.diff(np.r_[start, n])
        smallest = np.minimum.reduceat(conv, start)
        ending = np.add.reduceat((lengths == d).astype(np.int64), start)
        deeper = changed[:, d] & (turns[:, d] > 0) if d < width else np.zeros(n, bool)
        children = np.add.reduceat(deeper.astype(np.int64), start)
        own_words = counts[start, d - 1] if d else np.zeros(1, np.int64)
        on_first, on_last = np.zeros(len(start), bool), np.zeros(len(start), bool)
        on_first[0], on_last[-1] = len(first) // 16 >= d, len(last) // 16 >= d
        edge = on_first | on_last
        inner = real & ~edge
        leaves[start[inner]] += children[inner] == 0
        savings[start[inner]] += ((size - 1) * own_words)[inner]
        below, saving = np.add.reduceat(leaves, start), np.add.reduceat(savings, start)

        if d:
            up = np.searchsorted(changed[:, d - 2].nonzero()[0], start, side="right") - 1 if d > 1 else np.zeros(len(start), np.int64)
            above = changed[:, d - 2].nonzero()[0] if d > 1 else np.zeros(1, np.int64)
            side = np.where((up == 0) & (len(first) // 16 >= d - 1), 0, np.where((up == len(above) - 1) & (len(last) // 16 >= d - 1), 1, -1))
            parent = np.minimum.reduceat(conv, above)[up]
            at = np.flatnonzero(inner)
            out["block"] += [block] * len(at)
            out["conv_id"] += smallest[at].tolist()
            out["depth"] += [d] * len(at)
            out["parent_conv_id"] += [p if s < 0 else None for p, s in zip(parent[at].tolist(), side[at].tolist())]
            out["side"] += [s if s >= 0 else None for s in side[at].tolist()]
            out["n_convs"] += size[at].tolist()
            out["n_children"] += children[at].tolist()
            out["n_leaves"] += below[at].tolist()
            out["saved_tokens"] += saving[at].tolist()
            out["ends_sha256"] += [
                hashlib.sha256(_joined_ids(conv[s : s + e])).hexdigest() if e else EMPTY_SHA
                for s, e in zip(start[at].tolist(), ending[at].tolist())
            ]
            for name in ("key", "parent_key", "words", "ends", "own"):
                out[name] += [None] * len(at)

        for s, on, path in ((0, on_first, first), (1, on_last, last)):
            if not on.any():
                continue
            run = 0 if s == 0 else len(start) - 1
            own = s == 0 or not on_first[run]
            # Children on a boundary path are counted after the nodes are recombined.
            deep_first, deep_last = bool(on_first[run]) and len(first) // 16 > d, bool(on_last[run]) and len(last) // 16 > d
            at_edge = deep_first + deep_last - (deep_first and deep_last and first[: 16 * d + 16] == last[: 16 * d + 16])
            held = conv[start[run] : start[run] + ending[run]]
            row = {
                "block": block, "conv_id": int(smallest[run]) if own else None, "depth": d, "parent_conv_id": None, "side": s,
                "n_convs": int(size[run]) if own else 0, "n_children": int(children[run]) - at_edge if own else 0,
                "n_leaves": int(below[run]) if own else 0, "saved_tokens": int(saving[run]) if own else 0, "ends_sha256": None,
                "key": keys[s][d], "parent_key": keys[s][d - 1] if d else None, "words": int(own_words[run]),
                "ends": held.tobytes() if own and len(held) else None, "own": own,
            }
            for name, value in row.items():
                out[name].append(value)
    return out


def _blocks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, ARROW[kind]) for name, kind in map(str.split, BLOCK_SCHEMA.split(", "))])
        block = TaskContext.get().partitionId() << 32
        conv, paths, words, width = [], [], [], 0

        def cut() -> Iterator[pa.RecordBatch]:
            columns = block_nodes(block, np.array(conv, np.int64), paths, words)
            made = pa.Table.from_pydict(columns, schema=schema)
            yield from made.to_batches(max_chunksize=100_000)

        for batch in batches:
            lists = batch.column("words")
            offsets, values = lists.offsets.to_pylist(), lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
            ends = zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist(), offsets, offsets[1:])
            for c, path, i, j in ends:
                wider = max(width, len(path) // 16, 1)
                if conv and (len(conv) + 1) * wider > limit:
                    yield from cut()
                    block += 1
                    conv, paths, words, wider = [], [], [], max(len(path) // 16, 1)
                width = wider
                conv.append(c)
                paths.append(path)
                words.append(values[i:j])
        if conv:
            yield from cut()

    return run


def _hashed_ends(chunks: DataFrame) -> DataFrame:
    """``key, ends_sha256``: the ids of one node, in order over its blocks, hashed as one stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for batch in batches:
            done = []
            for k, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                ids = _joined_ids(np.frombuffer(ends, np.int64))
                if k != key:
                    if h is not None:
                        done.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256(ids)
                else:
                    h.update(b"," + ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["key", "ends_sha256"]
            )
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], ["key", "ends_sha256"])

    ordered = chunks.repartition("key").sortWithinPartitions("key", "block")
    return ordered.mapInArrow(run, "key binary, ends_sha256 string")


def _recombined(edges: DataFrame) -> DataFrame:
    """Boundary nodes over all blocks: ``key, conv_id, depth, ...`` as in the result of :func:`prefix_trie`."""
    nodes = (
        edges.where("own")
        .groupBy("key")
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.first("depth").alias("depth"),
            F.first("parent_key").alias("parent_key"),
            F.sum("n_convs").alias("n_convs"),
            F.sum("n_children").alias("inner"),
            F.first("words").alias("words"),
            F.min(F.struct("block", "side")).alias("owner"),
        )
    )
    below = nodes.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("outer"))
    nodes = saved(
        nodes.join(below, "key", "left").select(
            "key", "conv_id", "depth", "parent_key", "n_convs", "owner",
            (F.col("inner") + F.coalesce("outer", F.lit(0))).alias("n_children"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saving"),
        )
    )
    # What a node adds itself counts once, in its owner, for all nodes above it on that path.
    mine = F.col("owner") == F.struct("block", "side")
    upward = Window.partitionBy("block", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    path = edges.select("block", "side", "depth", "key", "n_leaves", "saved_tokens").join(
        nodes.select("key", "owner", "saving", (F.col("n_children") == 0).cast("bigint").alias("leaf")), "key"
    )
    sums = path.select(
        "key",
        (F.col("n_leaves") + F.sum(F.when(mine, F.col("leaf")).otherwise(0)).over(upward)).alias("l"),
        (F.col("saved_tokens") + F.sum(F.when(mine, F.col("saving")).otherwise(0)).over(upward)).alias("s"),
    )
    totals = sums.groupBy("key").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    ends = _hashed_ends(edges.where("ends is not null").select("key", "block", "ends"))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(totals, "key")
        .join(ends, "key", "left")
        .join(parents, "parent_key", "left")
        .select(
            "key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        )
    )


def prefix_trie(lists: DataFrame, cells: int = CELLS) -> DataFrame:
    """Nodes of the trie over ``conv_id, ids, words`` (see :func:`turn_lists`).

    Returns per node ``conv_id`` (its smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` and
    ``saved_tokens`` of its subtree, and ``ends_sha256`` of the conversations
    that end at it.
    """
    paths = saved(lists.select("conv_id", F.unhex(F.array_join("ids", "")).alias("path"), "words"))
    ordered = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    found = saved(ordered.mapInArrow(_blocks(cells), BLOCK_SCHEMA))
    edges = found.where("key is not null")
    boundary = saved(_recombined(edges))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = found.where("key is null")
    # A parent on a boundary path is looked up by block, so a hot parent is no hot key.
    above = edges.select("block", "side", "depth", "key").join(boundary.select("key", F.col("conv_id").alias("_up")), "key")
    above = above.select("block", "side", (F.col("depth") + 1).alias("depth"), "_up")
    under = inner.where("side is not null").join(above, ["block", "side", "depth"])
    return (
        inner.where("side is null")
        .select(columns)
        .unionByName(under.withColumn("parent_conv_id", F.col("_up")).select(columns))
        .unionByName(boundary.select(columns))
    )
