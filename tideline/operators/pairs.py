"""Pairwise moment sums of many series: the work behind every covariance.

Joining a panel with itself on the date would emit one row per pair and day.
Instead series are hashed into blocks, each packed into one row with a small
matrix, and every two blocks meet once, in a join without a key: what is moved
is the packed panel, once. A block pair is multiplied by one task over all its
days, ``CHUNK_DAYS`` at a time, so its sums are final: no row of a pair is
shuffled, and nothing grows with the square of the panel but the result. Where only
one figure a pair is asked for, it leaves Python as a matrix too, whose cells
Spark lists as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ASSETS = 512
#: Smaller panels are dealt into so many blocks, if these are not smaller than the second figure.
LEAST_BLOCKS, LEAST_ASSETS = 8, 128
CHUNK_DAYS = 366
#: Blocks of either side that a task meets, about.
SIDE_BLOCKS = 2
#: Pairs in a row that leaves Python, about.
SLAB_CELLS = 8192


def moment_name(p: int, q: int) -> str:
    """Column holding the sum of ``x**p * y**q``."""
    return f"x{p}y{q}"


def block_count(n_assets: int) -> int:
    """Blocks for that many series."""
    return max(1, -(-n_assets // BLOCK_ASSETS), min(LEAST_BLOCKS, n_assets // LEAST_ASSETS))


def _packing(group_columns: Sequence[str], centred: bool) -> Callable:
    """One row per block: its assets, its days and the values as a matrix; self-contained like ``_block_products``."""
    group_columns = list(group_columns)

    def pack(key, rows):
        import numpy as np
        import pyarrow as pa

        def flat(name, kind):
            lists = rows.column(name).combine_chunks()
            return lists.flatten().to_numpy(zero_copy_only=False).astype(kind)

        assets = rows.column("asset").to_pylist()
        names = sorted(set(assets), key=lambda x: (x is None, x))
        place = {name: row for row, name in enumerate(names)}
        sizes = np.array([len(x) for x in rows.column("days").combine_chunks()])
        days, at = np.unique(flat("days", np.int64), return_inverse=True)
        row, xs = np.repeat([place[x] for x in assets], sizes), flat("xs", float)
        if centred:
            xs -= (np.bincount(row, xs) / np.bincount(row))[row]
        values, known = np.zeros((len(names), len(days))), np.zeros((len(names), len(days)), bool)
        values[row, at], known[row, at] = xs, True
        weight = np.ones(len(days))
        if "ws" in rows.column_names:
            weight[at] = flat("ws", float)
        blobs = [x.tobytes() for x in (days, weight, values, np.packbits(known))]
        out = {name: pa.array([k.as_py()], k.type) for name, k in zip([*group_columns, "blk"], key)}
        out["names"] = pa.array([names], pa.list_(pa.string()))
        return pa.table(out | {name: pa.array([b], pa.binary()) for name, b in zip(("days", "weight", "xs", "known"), blobs)})

    return pack


def _block_products(
    powers: Sequence[tuple[int, int]],
    group_columns: Sequence[str],
    estimate: Callable | None = None,
    chunk: int = CHUNK_DAYS,
    slab: int = SLAB_CELLS,
) -> Callable:
    """Matrix products of two blocks; self-contained so that executors need no import of this package.

    Without an estimate a row is a pair with its sums. With one it is a slab:
    some assets of a block, the assets of the other that share a day with each
    of them, and the figures of all these pairs as one list.
    """
    powers, group_columns = list(powers), list(group_columns)
    out_columns = ["i", "j", *(f"x{p}y{q}" for p, q in powers)] if estimate is None else ["names", "names_r", "values"]

    def multiply(batches):
        import numpy as np
        import pyarrow as pa

        def block(row, side):
            days = np.frombuffer(row[f"days{side}"].as_buffer(), np.int64)
            shape = len(row[f"names{side}"]), len(days)
            known = np.unpackbits(np.frombuffer(row[f"known{side}"].as_buffer(), np.uint8), count=shape[0] * shape[1])
            weight = np.frombuffer(row[f"weight{side}"].as_buffer())
            return days, weight, np.frombuffer(row[f"xs{side}"].as_buffer()).reshape(shape), known.reshape(shape)

        def spans(at):
            """Pieces of the days; a run of days is a slice, which copies nothing."""
            for start in range(0, len(at), chunk):
                i = at[start : start + chunk]
                yield slice(i[0], i[-1] + 1) if i[-1] - i[0] == len(i) - 1 else i

        def raised(x, p):
            return x if p == 1 else x**p

        def products(row):
            days, weight, left, left_known = block(row, "")
            other_days, _, right, right_known = block(row, "_r")
            _, at, other_at = np.intersect1d(days, other_days, assume_unique=True, return_indices=True)
            shared, sums = 0.0, dict.fromkeys(powers, 0.0)
            # On days that all series of both blocks have, a sum of one side's powers needs no matrix product.
            whole = left_known.all(0)[at] & right_known.all(0)[other_at]
            for i, j in zip(spans(at[whole]), spans(other_at[whole])):
                x, y, w = left[:, i], right[:, j], weight[i]
                shared += len(w)
                a = {p: raised(x, p) for p in {p for p, _ in powers if p}}
                b = {q: raised(y, q) for q in {q for _, q in powers if q}}
                weighted = {p: a[p] if (w == 1).all() else a[p] * w for p in a}
                for p, q in powers:
                    if p and q:
                        sums[p, q] += weighted[p] @ b[q].T
                    elif p:
                        sums[p, q] += (a[p] @ w)[:, None]
                    else:
                        sums[p, q] += b[q] @ w if q else w.sum()
            for i, j in zip(spans(at[~whole]), spans(other_at[~whole])):
                x, y, w = left[:, i], right[:, j], weight[i]
                has_x, has_y = left_known[:, i].astype(float), right_known[:, j].astype(float)
                both = has_x @ has_y.T
                shared = shared + both
                a = {p: raised(x, p) * has_x * w for p in {p for p, _ in powers}}
                b = {q: raised(y, q) * has_y for q in {q for _, q in powers}}
                for p, q in powers:
                    sums[p, q] = sums[p, q] + (a[p] @ b[q].T if p or q or not (w == 1).all() else both)
            shape = len(left), len(right)
            return np.broadcast_to(shared, shape), {x: np.broadcast_to(sums[x], shape) for x in powers}

        def listed(offsets, values):
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], offsets]).astype(np.int32)), values)

        def slabs(names, other_names, kept, value, missing):
            """Rows of the matrix in order; a slab ends where other columns are kept than in the row before."""
            cut = np.zeros(len(names), bool)
            cut[:: max(1, slab // len(other_names))] = True
            cut[1:] |= (kept[1:] != kept[:-1]).any(1)
            first = np.flatnonzero(cut)
            height, width = np.diff([*first, len(names)]), kept[first].sum(1)
            others = other_names.take(pa.array(np.nonzero(kept[first])[1]))
            values = pa.array(value[kept], mask=missing[kept] if missing.any() else None, from_pandas=False)
            return listed(np.cumsum(height), names), listed(np.cumsum(width), others), listed(np.cumsum(height * width), values)

        def found(row):
            """Columns of the pairs, batch by batch."""
            names, other_names = (pa.array(row[x].as_py(), pa.string()) for x in ("names", "names_r"))
            shared, sums = products(row)
            same = row["blk"].as_py() == row["blk_r"].as_py()
            kept = shared > 0  # pairs that share no day carry nothing
            if estimate is None:
                # One triangle inside a block.
                kept = np.triu(kept) if same else kept
                i, j = np.nonzero(kept)
                yield [names.take(pa.array(i)), other_names.take(pa.array(j)), *(pa.array(sums[x][kept]) for x in powers)]
                return
            with np.errstate(all="ignore"):
                value, missing = estimate(sums)
            if same:
                below = np.tri(len(names), k=-1, dtype=bool)
                value, missing = (np.where(below, x.T, x) for x in (value, missing))
            else:
                yield slabs(other_names, names, kept.T, value.T, missing.T)
            yield slabs(names, other_names, kept, value, missing)

        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: column[k] for name, column in zip(batch.schema.names, batch.columns)}
                for columns in found(row):
                    out = [pa.array([row[c].as_py()] * len(columns[0]), batch.schema.field(c).type) for c in group_columns]
                    yield pa.RecordBatch.from_arrays([*out, *columns], [*group_columns, *out_columns])

    return multiply


def _pairs(
    series: DataFrame,
    powers: Sequence[tuple[int, int]],
    estimate: Callable | None,
    value: str,
    keys: Sequence[str],
    weight: str | None,
    n_blocks: int | None,
    centred: bool,
) -> DataFrame:
    """Pairs of series as rows: ``keys, i, j`` and the moments or the estimate made of them."""
    powers = list(dict.fromkeys(powers))
    known = series.where(F.col(value).isNotNull())
    if n_blocks is None:
        n_blocks = block_count(series.agg(F.count_distinct("asset")).first()[0])
    lists = [F.collect_list("n").alias("days"), F.collect_list(F.col(value).cast("double")).alias("xs")]
    if weight:
        known = known.where(F.col(weight).isNotNull())
        lists.append(F.collect_list(F.col(weight).cast("double")).alias("ws"))
    packets = (
        known.withColumn("chunk", F.floor(F.col("n") / CHUNK_DAYS).cast("int"))
        .groupBy(*keys, "asset", "chunk")
        .agg(*lists)
        .withColumn("blk", F.pmod(F.xxhash64("asset"), F.lit(n_blocks)).cast("int"))
        .drop("chunk")
    )
    fields = [packets.schema[k] for k in keys]
    strings = T.ArrayType(T.StringType())
    blobs = [T.StructField(name, T.BinaryType()) for name in ("days", "weight", "xs", "known")]
    block = [T.StructField("blk", T.IntegerType()), T.StructField("names", strings), *blobs]
    blocks = packets.groupBy(*keys, "blk").applyInArrow(_packing(keys, centred), T.StructType(fields + block))
    # The join reads a side again for each part of the other, so both are one shuffle after the packing. Python
    # is given all pairs of a task at once, up to 64 MB, so parts of few blocks keep the executors small.
    left = blocks.repartition(-(-n_blocks // SIDE_BLOCKS))
    right = left.select(*(F.col(c).alias(f"{c}_r") for c in blocks.columns))
    # Round a circle every block meets the half that follows it, so that all have as many partners.
    ahead = F.pmod(F.col("blk_r") - F.col("blk"), F.lit(n_blocks))
    met = (2 * ahead < n_blocks) | ((2 * ahead == n_blocks) & (F.col("blk") < F.col("blk_r")))
    for k in keys:
        # Inside a condition the keys do not deal out the rows, which would put all blocks of a key in one task.
        met = F.when(met, F.col(k).eqNullSafe(F.col(f"{k}_r"))).otherwise(False)
    pairs = left.join(right, met)
    if estimate is None:
        columns = [T.StructField("i", T.StringType()), T.StructField("j", T.StringType())]
        columns += [T.StructField(moment_name(p, q), T.DoubleType()) for p, q in powers]
        return pairs.mapInArrow(_block_products(powers, keys), T.StructType(fields + columns))
    columns = [T.StructField("names", strings), T.StructField("names_r", strings), T.StructField("values", T.ArrayType(T.DoubleType()))]
    slabs = pairs.mapInArrow(_block_products(powers, keys, estimate), T.StructType(fields + columns))
    return (
        slabs.select(*keys, "names_r", "values", F.posexplode("names").alias("_row", "i"))
        .select(*keys, "names_r", "values", "_row", "i", F.posexplode("names_r").alias("_column", "j"))
        .select(*keys, "i", "j", F.col("values")[F.col("_row") * F.size("names_r") + F.col("_column")].alias("value"))
    )


def pair_moments(
    series: DataFrame,
    powers: Sequence[tuple[int, int]],
    value: str = "r",
    keys: Sequence[str] = (),
    weight: str | None = None,
    n_blocks: int | None = None,
) -> DataFrame:
    """Sums of ``w * x**p * y**q`` over the days two series share.

    ``series`` has ``asset, n, <value>`` and the grouping ``keys``; the optional
    weight must depend on the day only. Returns ``keys, i, j, x<p>y<q> ...`` with
    each unordered pair once. ``n_blocks`` defaults to what :func:`block_count`
    gives, which costs a job that counts the assets; give it where that count is
    known.
    """
    return _pairs(series, powers, None, value, keys, weight, n_blocks, False)


def pair_estimates(
    series: DataFrame,
    powers: Sequence[tuple[int, int]],
    estimate: Callable,
    value: str = "r",
    keys: Sequence[str] = (),
    n_blocks: int | None = None,
    centred: bool = False,
) -> DataFrame:
    """One figure per pair from its moments: ``keys, i, j, value``, as (i, j) and as (j, i).

    ``estimate`` takes the matrices of sums by power and returns the matrix of
    figures and a matrix that is true where there is none; the figure must not
    depend on which series comes first. It runs on the executors and so has to
    be a local function. With ``centred`` each series is first reduced by its
    own mean. Otherwise like :func:`pair_moments`.
    """
    return _pairs(series, powers, estimate, value, keys, None, n_blocks, centred)


def both_triangles(moments: DataFrame, powers: Sequence[tuple[int, int]], keys: Sequence[str] = ()) -> DataFrame:
    """Mirror one row per unordered pair into (i, j) and (j, i) with x and y swapped."""
    names = [(moment_name(p, q), moment_name(q, p)) for p, q in dict.fromkeys(powers)]

    def side(a: str, b: str, flip: bool) -> str:
        sums = "".join(f", '{name}', {swapped if flip else name}" for name, swapped in names)
        return f"named_struct('i', {a}, 'j', {b}{sums})"

    kept, mirrored = side("i", "j", False), side("j", "i", True)
    return moments.selectExpr(*keys, f"inline(if(i = j, array({kept}), array({kept}, {mirrored})))")
