"""N-gram Jaccard join as a grouped prefix join (operator 3).

A document's set holds its distinct 5-word shingles (A-Z lower-cased); fewer
words make one shingle, no words none. Two documents link when their sets have
a Jaccard similarity of at least 0.8. All of it is exact:

1. *Order.* Shingles are counted over all documents. A fixed number of the most
   frequent ones (``FREQUENT``, 8 MB, the only thing that is broadcast) come
   last, by frequency; the rest come first, by hash. Any order is right; this one keeps
   passages that many documents share out of the prefixes.
2. *Groups.* Documents with equal sets become one node. Nodes with the same
   prefix and the same size become one group, which is written out once.
3. *Filter.* Groups that share a prefix shingle are candidates if their sizes,
   the positions, and then the number of prefix shingles they share allow it.
4. *Expand and verify* in two rounds. First each group is compared with the
   center of every shingle (and each member with the first of its group), which is
   linear in the number of copies. Members that are linked by then need no
   further look. Second, for shingles whose groups still fall into several
   components, groups of different components are paired where this shingle can
   be the first one they share: the smaller set then holds it within its first
   ninth, the larger one is at most a quarter larger, and both have enough left
   after it. Every pair that links is met at its first shared shingle, so no
   link between two components is lost; sets that share only common passages, which
   come last, never meet there, and a family of near copies is never expanded
   into all its pairs.

Null text counts as empty; empty documents link with nothing. Repeated rows are
members of one node. Texts of any length are used whole. Other columns of the
input are not read and may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import WordHashes, byte_texts, power_of_two, saved, signed, slices, text_bytes, unsigned, windows
from tideline.llm.components import components

WORDS = 5
#: Similarity as a percentage, so that the comparison is in whole numbers.
PERCENT = 80
#: Shingles that are ordered by frequency; a bound on what is broadcast.
FREQUENT = 1 << 20
BYTES_PER_SHARD = 16 << 20
#: Shingles are counted by so many bits of their hash; a clash only affects the order.
COUNT_BITS = 40
#: Words whose hashes a task remembers.
CACHED_WORDS = 50_000
#: Shingles, and bytes of text, that a task holds while it counts.
COUNT_CHUNK, COUNT_BYTES = 500_000, 1 << 20


def shingle_sets(texts: list[bytes], cache: WordHashes, k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    hashes = cache.of([w for doc in words for w in doc])
    rolled = windows(hashes, k, 1)
    ends, out = np.cumsum(sizes), []
    for n, end in zip(sizes.tolist(), ends.tolist()):
        if n >= k:
            out.append(np.unique(rolled[end - n : end - k + 1]))
        elif n:
            out.append(windows(hashes[end - n : end], n, 10 + n))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _packed(values: np.ndarray) -> bytes:
    """Sorted whole numbers as differences, byte by byte plane."""
    planes = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view("<u8").reshape(-1), dtype=np.uint64)


def frequent_shingles(docs: DataFrame, most: int = FREQUENT) -> np.ndarray:
    """The ``most`` most frequent shingles of all documents (upper hash bits), rarest first."""
    shards = power_of_two(text_bytes(docs) / BYTES_PER_SHARD)
    shift = np.uint64(64 - COUNT_BITS)
    split = np.uint64(COUNT_BITS - (shards.bit_length() - 1))

    def cut(sets: list[np.ndarray]) -> pa.RecordBatch:
        values = np.sort(np.concatenate(sets)) >> shift
        shard = (values >> split).astype(np.int32)
        own, first = np.unique(shard, return_index=True)
        blobs = [_packed(values[i:j]) for i, j in zip(first, np.r_[first[1:], len(values)])]
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(blobs, pa.binary())], ["shard", "hashes"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held, n = WordHashes(CACHED_WORDS), [], 0
        for batch in slices(batches, limit=COUNT_BYTES):
            sets = shingle_sets(byte_texts(batch.column("text")), cache)
            held += sets
            n += sum(map(len, sets))
            if n >= COUNT_CHUNK:
                yield cut(held)
                held, n = [], 0
        if n:
            yield cut(held)

    def often(key: tuple, table: pa.Table) -> pa.Table:
        values = np.sort(np.concatenate([_unpacked(b) for b in table.column("hashes").to_pylist()]), kind="stable")
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        counts = np.diff(np.r_[first, len(values)])
        more = counts > 2
        return pa.table({"h": signed(values[first[more]]), "n": pa.array(counts[more].astype(np.int64))})

    blobs = docs.select("text").mapInArrow(count, "shard int, hashes binary")
    counts = saved(blobs.groupBy("shard").applyInArrow(often, "h bigint, n bigint"))
    # The least count that at most `most` shingles reach, from the counts' histogram.
    size = F.sum("size").over(Window.orderBy(F.desc("n")))
    steps = counts.groupBy("n").agg(F.count("*").alias("size")).withColumn("reach", size)
    least = steps.filter(F.col("reach") <= most).agg(F.min("n")).first()[0]
    if least is None:
        return np.empty(0, np.uint64)
    rows = counts.filter(F.col("n") >= least).toArrow().sort_by([("n", "ascending"), ("h", "ascending")])
    return unsigned(rows.column("h"))


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def digests(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``doc_id, text_hash, n, node, check, gid, prefix``; the prefix is given once per task and group.

    ``node`` and ``check`` hash the whole set, ``gid`` the prefix and the size.
    Prefix shingles are in order; the frequent ones have negative numbers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = np.argsort(frequent)
    hot, rank = frequent[order], order.astype(np.uint64)
    shift, top = np.uint64(64 - COUNT_BITS), np.uint64(1 << 63)

    def keys(sets: np.ndarray) -> np.ndarray:
        out = sets >> np.uint64(1)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, sets >> shift), len(hot) - 1)
            is_hot = hot[at] == sets >> shift
            # Shingles that share the counted bits keep an order of their own.
            out[is_hot] = top | (rank[at[is_hot]] << np.uint64(40)) | (sets[is_hot] & np.uint64((1 << 24) - 1))
        return out

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, known = WordHashes(CACHED_WORDS), set()
        for batch in slices(batches):
            sets = shingle_sets(byte_texts(batch.column("text")), cache)
            flat = keys(np.concatenate(sets)) if sets else np.empty(0, np.uint64)
            sizes = [len(s) for s in sets]
            node, check, gid, prefixes, lengths, at = [], [], [], [], [0], 0
            for s, n in zip(sets, sizes):
                if not n:
                    node.append(None), check.append(None), gid.append(None), lengths.append(lengths[-1])
                    continue
                raw = s.tobytes()
                node.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                check.append(xxhash.xxh64_intdigest(raw) - (1 << 63))
                prefix = np.sort(flat[at : at + n])[: prefix_length(n)]
                at += n
                group = xxhash.xxh3_64_intdigest(prefix.tobytes(), seed=n) - (1 << 63)
                gid.append(group)
                if group in known:
                    lengths.append(lengths[-1])
                    continue
                known.add(group)
                prefixes.append(prefix)
                lengths.append(lengths[-1] + len(prefix))
            values = np.concatenate(prefixes) if prefixes else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(sizes, pa.int64()),
                    pa.array(node, pa.int64()),
                    pa.array(check, pa.int64()),
                    pa.array(gid, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), signed(values)),
                ],
                ["doc_id", "text_hash", "n", "node", "check", "gid", "prefix"],
            )

    return docs.select("doc_id", "text", _text_hash(F.col("text")).alias("text_hash")).mapInArrow(
        digest, f"doc_id {kind}, text_hash bigint, n bigint, node bigint, check bigint, gid bigint, prefix array<bigint>"
    )


def _possible(n: Column, at: Column, m: Column, to: Column) -> Column:
    """Whether sets of sizes n and m that share the shingles at these positions can be similar enough.

    The overlap is at most what comes before both, the shared one, and what comes after both.
    """
    overlap = F.least(at, to) + 1 + F.least(n - at, m - to) - 1
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & ((100 + PERCENT) * overlap >= PERCENT * (n + m))


def _first_possible(n: Column, at: Column, m: Column, to: Column) -> Column:
    """As ``_possible``, where the shingle is the first one in the order that the sets share.

    Nothing before it is shared then, so the overlap is at most what either set has left.
    """
    return (100 + PERCENT) * F.least(n - at, m - to) >= PERCENT * (n + m)


def _band(n: Column) -> Column:
    """Sizes by powers of the largest ratio that two linked sets can have; never falls as n grows."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / PERCENT))).cast("int")


def across_components(posts: DataFrame) -> DataFrame:
    """``gid, comp, g, c``: groups of different components that can link at their first shared shingle.

    ``posts`` holds ``tok, gid, n, at, comp`` and the shingle's largest component, ``main``.
    The smaller set of a pair looks for larger ones by shingle and band of sizes, and takes
    part only where it has enough left to link with a set of its own size. Two groups of ``main`` are not paired.
    """
    small = posts.filter((100 + PERCENT) * (F.col("n") - F.col("at")) >= 2 * PERCENT * F.col("n"))
    reach = F.floor(F.col("n") * 100 / PERCENT)
    small = small.withColumn("band", F.explode(F.sequence(_band(F.col("n")), _band(reach))))
    large = posts.select(
        "tok", F.col("gid").alias("g"), F.col("comp").alias("c"), F.col("n").alias("m"), F.col("at").alias("to"),
        (F.col("comp") == F.col("main")).alias("in_main"), _band(F.col("n")).alias("band"),
    )
    possible = _first_possible(F.col("n"), F.col("at"), F.col("m"), F.col("to"))
    met = (F.col("comp") != F.col("c")) & (F.col("n") <= F.col("m")) & possible
    few = small.filter("comp != main").join(large, ["tok", "band"]).filter(met)
    rest = small.filter("comp = main").join(large.filter("not in_main"), ["tok", "band"]).filter(met)
    return few.unionByName(rest).select("gid", "comp", "g", "c").distinct()


def shared_prefixes(digest: DataFrame) -> DataFrame:
    """``tok, gid, n, at, cgid, cn, cat``: groups at each prefix shingle of two groups or more, and the center there.

    The center is the group that holds the shingle at the first place: of a family of near
    copies the one with the fewest shingles of its own, to which most others link.
    Shingles outside the frequent list are rare, so a window over each is small.
    The frequent ones, which can hold any share of the rows, are aggregated
    before the shuffle and joined back.
    """
    posts = digest.filter(F.size("prefix") > 0).select("gid", "n", F.posexplode("prefix").alias("at", "tok"))
    posts = posts.select("tok", "gid", F.shiftleft("n", 32).bitwiseOR(F.col("at").cast("bigint")).alias("np"))
    low = F.lit((1 << 32) - 1)
    found = {
        "c": F.min(F.struct(F.col("np").bitwiseAND(low).alias("at"), "gid", "np")),
        "lo": F.min("gid"),
        "hi": F.max("gid"),
    }
    each = Window.partitionBy("tok")
    rare = posts.filter("tok >= 0").select("*", *(x.over(each).alias(name) for name, x in found.items()))
    often = posts.filter("tok < 0")
    least = often.groupBy("tok").agg(*(x.alias(name) for name, x in found.items())).filter("lo != hi")
    return (
        rare.filter("lo != hi")
        .unionByName(often.join(least, "tok"))
        .select(
            "tok",
            "gid",
            F.shiftright("np", 32).alias("n"),
            F.col("np").bitwiseAND(low).alias("at"),
            F.col("c.gid").alias("cgid"),
            F.shiftright("c.np", 32).alias("cn"),
            F.col("c.np").bitwiseAND(low).alias("cat"),
        )
    )


def links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of nodes whose sets are similar enough, by their whole sets."""
    wanted = saved(
        pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    )
    ids = saved(nodes.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc").alias("_id")).select("_id").distinct())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes(CACHED_WORDS)
        for batch in slices(batches):
            found = [s for s in shingle_sets(byte_texts(batch.column("text")), cache) if len(s)]
            node = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "items"]
            )

    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    items = texts.select("text").mapInArrow(sets, "node bigint, items binary")
    # Rows repeated with one doc_id give a node twice, which only repeats a link.
    items = items.join(wanted, "node", "left_semi")
    both = (
        pairs.join(items.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
        .join(items.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
        .select("a", "b", "x", "y")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= PERCENT * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(verify, "a bigint, b bigint")


def plausible(pairs: DataFrame, groups: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of groups that share enough of their prefixes.

    Of the two prefixes, the one that ends first in the order lies wholly
    against the other; what is shared beyond it is at most what its set has left. So the
    overlap is at most the shared part of the prefixes and the larger rest.
    """
    one = groups.select(F.col("gid").alias(a), F.col("n").alias("_n"), F.col("prefix").alias("_x"))
    two = groups.select(F.col("gid").alias(b), F.col("n").alias("_m"), F.col("prefix").alias("_y"))
    rest = F.greatest(F.col("_n") - F.size("_x"), F.col("_m") - F.size("_y"))
    overlap = F.size(F.array_intersect("_x", "_y")) + rest
    both = pairs.join(one, a).join(two, b)
    return both.filter((100 + PERCENT) * overlap >= PERCENT * (F.col("_n") + F.col("_m"))).select(*pairs.columns)


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()


def linked_components(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row; the component is named by its smallest ``doc_id``."""
    return _linked(docs, frequent).select("doc_id", "n_shingles", "component_id")


def _linked(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, text_hash, n_shingles, comp, component_id`` for every row; components of one name differ in ``comp``."""
    digest = saved(digests(docs, frequent_shingles(docs, frequent)))
    nodes = saved(
        digest.filter("node is not null")
        .groupBy("node", "gid", "n")
        .agg(F.min("doc_id").alias("doc"), F.min("check").alias("lo"), F.max("check").alias("hi"))
        .withColumn("node", F.when(F.col("lo") == F.col("hi"), F.col("node")).otherwise(F.raise_error(F.lit("set hashes clash")).cast("bigint")))
        .select("node", "gid", "n", "doc")
    )
    shared = saved(shared_prefixes(digest))
    heads = nodes.groupBy("gid").agg(F.min("node").alias("head"))
    # Only groups that share a prefix shingle with another take part in the filter.
    meeting = saved(shared.select("gid").unionByName(shared.select(F.col("cgid").alias("gid"))).distinct())
    groups = saved(
        digest.filter(F.size("prefix") > 0)
        .join(meeting, "gid", "left_semi")
        .groupBy("gid")
        .agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    )

    # Round 1: groups against the center of each shingle, members against the head of their group.
    stars = shared.filter("gid != cgid").filter(_possible(F.col("n"), F.col("at"), F.col("cn"), F.col("cat")))
    stars = plausible(stars.select("gid", "cgid").distinct(), groups, "gid", "cgid")
    stars = stars.join(heads, "gid").join(heads.select(F.col("gid").alias("cgid"), F.col("head").alias("chead")), "cgid")
    inside = nodes.join(heads, "gid").filter("node != head")
    first = saved(
        _pairs(
            stars.select(F.col("head").alias("a"), F.col("chead").alias("b")).unionByName(
                inside.select(F.col("node").alias("a"), F.col("head").alias("b"))
            )
        )
    )
    found = saved(links(docs, nodes, first))
    labels = saved(components(found))

    # Round 2: what still lies in several components at one shingle.
    member = saved(
        nodes.join(labels, "node", "left").select("node", "gid", "n", "doc", F.coalesce("label", "node").alias("comp"))
    )
    # The members of a group share its prefix, so groups that are one component and alone at a shingle are done.
    mixed_groups = member.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi")
    sides = member.select("gid", "comp").distinct()
    posts = shared.select("tok", "gid", "n", "at").distinct().join(sides, "gid")
    per = posts.groupBy("tok", "comp").agg(F.count("*").alias("size"))
    most = per.groupBy("tok").agg(
        F.max_by("comp", F.struct("size", "comp")).alias("main"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    )
    open_posts = saved(posts.join(most.filter("lo != hi").select("tok", "main"), "tok"))
    across = across_components(open_posts)
    across = plausible(across, groups, "gid", "g")
    within = (
        sides.join(mixed_groups.select("gid"), "gid", "left_semi").join(
            sides.join(mixed_groups.select("gid"), "gid", "left_semi").select("gid", F.col("comp").alias("c")), "gid"
        )
    ).filter("comp < c").select("gid", "comp", F.col("gid").alias("g"), "c")
    left = member.select("gid", "comp", F.col("node").alias("a"))
    right = member.select(F.col("gid").alias("g"), F.col("comp").alias("c"), F.col("node").alias("b"))
    rest = across.unionByName(within).join(left, ["gid", "comp"]).join(right, ["g", "c"])
    second = saved(_pairs(rest.select("a", "b")).join(first, ["a", "b"], "left_anti"))
    if not second.isEmpty():
        more = saved(found.unionByName(links(docs, nodes, second)))
        labels = saved(components(more))
        member = nodes.join(labels, "node", "left").select("node", "doc", F.coalesce("label", "node").alias("comp"))

    names = member.groupBy("comp").agg(F.min("doc").alias("component_id"))
    named = member.join(names, "comp").select("node", "comp", "component_id")
    return digest.select("doc_id", "text_hash", "n", "node").join(named, "node", "left").select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        "comp",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, the smallest ``doc_id``, with all columns; a null ``doc_id`` stays.

    Rows are judged by ``doc_id`` and text, so different texts under one id do not take each other along; of
    those in one component the smallest text hash stays. Rows repeated with id and text stay together.
    """
    found = saved(_linked(docs))
    first = F.min("text_hash").over(Window.partitionBy("doc_id", "comp"))
    twins = found.filter("doc_id = component_id and comp is not null").withColumn("first", first).filter("text_hash != first")
    drop = found.filter("doc_id != component_id").select("doc_id", "text_hash").unionByName(twins.select("doc_id", "text_hash"))
    drop = saved(drop.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    return docs.join(drop, (docs["doc_id"] == drop["_id"]) & (_text_hash(docs["text"]) == drop["_hash"]), "left_anti")
