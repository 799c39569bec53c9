"""Mixing sources to target weights (operator 1).

The leaves of a tree, domain - language - source, hold documents; a leaf can
give its tokens at most ``max_epochs`` times. The token budget runs down the
tree: a node shares its budget among its children by weight, but no child gets
more than its subtree can give. What a child cannot take goes to its siblings
by weight; only when all siblings are full does the node as a whole take less,
which leaves the rest to its own siblings one level up. Per level this is one
water filling, in closed form with running sums, in whole tokens.

A leaf then takes whole epochs, and of one more epoch a prefix of its tokens:
its documents in the order of a seeded hash, and of the one that passes the rest
the first tokens, so that a leaf gives its quota to the token, however long its
documents are. The cut is found from sums per range of the hash, so a leaf with
a third of all rows is never sorted in one task; what a document needs to know
is one row per leaf.

Null text has no tokens. Null and empty names are one branch. An empty leaf
gets nothing. Rows of one id, or without one, are ordered by their text. Rows
repeated with id and text count as often as they occur and are taken alike: if
the cut falls on k of them, each gives the same part, and fewer than k tokens
of the quota are left.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import WHITE, saved

#: Documents per hash range that are ordered together, about.
DOCS_PER_RANGE = 1000


@dataclass(frozen=True)
class Mix:
    """``weights[k]`` gives the weight of a name at level k of the tree; other names weigh 1."""

    weights: tuple[dict[str, int], ...] = ({}, {}, {})
    #: Share of all tokens that is given out, in percent.
    budget_percent: int = 100
    max_epochs: int = 4
    seed: int = 1
    levels: tuple[str, ...] = field(default=("_d0", "_d1", "_d2"))


def _weight(of: dict[str, int], name: str) -> Column:
    out = F.lit(1)
    for key, value in of.items():
        out = F.when(F.col(name) == key, value).otherwise(out)
    return out.cast("decimal(38,0)")


def tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("bigint")


def keyed(docs: DataFrame, path: list[Column], mix: Mix) -> DataFrame:
    """``docs`` as ``_doc`` with the names of the path beside it."""
    names = [F.coalesce(p.cast("string"), F.lit("")).alias(n) for p, n in zip(path, mix.levels)]
    return docs.select(F.struct("*").alias("_doc"), *names)


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def first_tokens(text: Column, n: Column) -> Column:
    """The start of a text up to the end of its n-th token, white space as it is."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[{WHITE}]*[^{WHITE}]+"), F.lit(0)), F.lit(1), n), "")


def _order(mix: Mix, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), doc_id.cast("string")).cast("binary"))


def _filled(children: DataFrame, parent: list[str], name: str, weights: dict[str, int]) -> DataFrame:
    """``children(parent..., name, cap, budget of the parent)`` with what each child gets as ``quota``."""
    w = _weight(weights, name)
    rows = children.withColumn("w", w).withColumn("ratio", F.col("cap").cast("double") / F.col("w").cast("double"))
    by = Window.partitionBy(*parent)
    up_to = by.orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    rows = rows.withColumn("before", F.coalesce(F.sum("cap").over(up_to), zero)).withColumn(
        "w_left", F.sum("w").over(by) - F.coalesce(F.sum("w").over(up_to), zero)
    )
    # A child is full if its share of what the smaller ones leave is no less than it can give.
    rows = rows.withColumn("full", F.col("cap") * F.col("w_left") <= F.col("w") * (F.col("budget") - F.col("before")))
    left = F.col("budget") - F.min(F.when(~F.col("full"), F.col("before"))).over(by)
    share = F.max(F.when(~F.col("full"), F.col("w_left"))).over(by)
    return rows.withColumn("left", left).withColumn("share", share).withColumn(
        "quota",
        F.when(F.col("full"), F.col("cap").cast("bigint")).otherwise(F.expr("cast(floor(`left` * w / share) as bigint)")),
    )


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves(path..., size, docs)`` with the tokens each leaf gives as ``quota``."""
    d0, d1, d2 = mix.levels
    leaves = leaves.withColumn("cap", (F.col("size") * mix.max_epochs).cast("decimal(18,0)"))
    total = F.floor(F.sum("size") * mix.budget_percent / 100).cast("decimal(18,0)").alias("budget")
    root = leaves.agg(total).withColumn("_root", F.lit(0))
    given, above = root, ["_root"]
    for depth, name in enumerate(mix.levels):
        own = [d0, d1, d2][: depth + 1]
        caps = leaves.withColumn("_root", F.lit(0)).groupBy("_root", *own).agg(F.sum("cap").cast("decimal(18,0)").alias("cap"))
        filled = _filled(caps.join(given.select("budget", *above), above), above, name, mix.weights[depth])
        given = filled.select("_root", *own, F.col("quota").cast("decimal(18,0)").alias("budget"))
        above = ["_root", *own]
    return leaves.join(given.drop("_root"), list(mix.levels)).withColumn("quota", F.col("budget").cast("bigint"))


def measured(docs: DataFrame, path: list[Column], mix: Mix) -> DataFrame:
    """``path..., doc_id, n_tokens, text_hash`` of every row; the only pass over the texts that the plan needs."""
    text = F.col("_doc.text")
    return keyed(docs, path, mix).select(
        *mix.levels, F.col("_doc.doc_id").alias("doc_id"), tokens(text).alias("n_tokens"), _text_hash(text).alias("text_hash")
    )


def leaf_plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """``path..., quota, epochs, rest, cut, part``: whole epochs of each leaf, and of the partial one the document
    at the cut with the tokens it gives."""
    names = list(mix.levels)
    leaves = saved(rows.groupBy(*names).agg(F.sum("n_tokens").alias("size"), F.count("*").alias("docs")))
    size = F.col("size")
    plan = saved(
        budgets(leaves, mix).select(
            *names,
            "quota",
            F.when(size > 0, F.expr("quota div size")).otherwise(F.lit(0)).cast("int").alias("epochs"),
            F.when(size > 0, F.expr("quota % size")).otherwise(F.lit(0)).alias("rest"),
            F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("docs") / DOCS_PER_RANGE))).cast("int").alias("digits"),
        )
    )
    placed = rows.join(plan.filter("rest > 0"), names).withColumn("place", _order(mix, F.col("epochs"), F.col("doc_id")))
    placed = placed.withColumn("range", F.expr("substr(place, 1, digits)"))
    sums = placed.groupBy(*names, "range", "rest").agg(F.sum("n_tokens").alias("n"))
    up_to = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0)))
    # The running total passes the rest inside this range; all ranges before it fit.
    open_range = sums.filter("before <= rest and before + n > rest").select(*names, "range", "before")
    key = ["place", "doc_id", "text_hash"]
    within = Window.partitionBy(*names).orderBy(*key).rangeBetween(Window.unboundedPreceding, 0)
    alike = Window.partitionBy(*names).orderBy(*key).rangeBetween(0, 0)
    inside = placed.join(open_range, [*names, "range"]).withColumn("total", F.col("before") + F.sum("n_tokens").over(within))
    inside = inside.withColumn("part", F.expr("rest - total") + F.sum("n_tokens").over(alike)).withColumn("copies", F.count("*").over(alike))
    # The first document that does not fit gives what is left; everything before it fits.
    first = inside.filter("total > rest").groupBy(*names).agg(F.min(F.struct(*key, "part", "copies")).alias("first"))
    cut = first.select(
        *names, F.struct(*[F.col(f"first.{k}").alias(k) for k in key]).alias("cut"), F.expr("first.part div first.copies").alias("part")
    )
    return saved(plan.join(cut, names, "left").select(*names, "quota", "epochs", "rest", "cut", "part"))


def taken(rows: DataFrame, plan: DataFrame, doc_id: Column, text_hash: Column, mix: Mix) -> DataFrame:
    """``rows`` (with the path's columns), ``_whole``, the times each one is taken, and ``_part``, the tokens taken beyond that."""
    names = list(mix.levels)
    place = _order(mix, F.col("epochs"), doc_id).alias("place")
    here = F.struct(place, doc_id.alias("doc_id"), text_hash.alias("text_hash"))
    more = (F.col("rest") > 0) & (F.col("cut").isNull() | (here < F.col("cut")))
    part = F.when((F.col("rest") > 0) & (here == F.col("cut")), F.col("part")).otherwise(F.lit(0)).cast("bigint")
    out = rows.join(plan, names).withColumns({"_whole": F.col("epochs") + more.cast("int"), "_part": part})
    return out.drop("quota", "epochs", "rest", "cut", "part")


def assigned(docs: DataFrame, path: list[Column], mix: Mix) -> DataFrame:
    """``path..., doc_id, n_tokens, _whole, _part, _epochs`` of every row.

    ``_epochs`` is the times a row is taken with its part as a fraction, rounded down at nine digits.
    """
    rows = saved(measured(docs, path, mix))
    fraction = F.when(F.col("_part") > 0, F.expr("_part * 1000000000L div n_tokens")).otherwise(F.lit(0))
    epochs = (F.col("_whole") * F.lit(1_000_000_000).cast("bigint") + fraction).cast("decimal(20,0)")
    return (
        taken(rows, leaf_plan(rows, mix), F.col("doc_id"), F.col("text_hash"), mix)
        .withColumn("_epochs", (epochs * F.expr("0.000000001BD")).cast("decimal(20,9)"))
        .drop("text_hash")
    )


def mixed(docs: DataFrame, path: list[Column], mix: Mix) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken, with their columns.

    A part is a row of its own with the first tokens as its text, and their characters as ``n_chars`` if there is such a column.
    """
    plan = leaf_plan(saved(measured(docs, path, mix)), mix)
    rows = taken(keyed(docs, path, mix), plan, F.col("_doc.doc_id"), _text_hash(F.col("_doc.text")), mix)
    rows = rows.filter("_whole > 0 or _part > 0")
    copies = F.sequence(F.lit(1), F.col("_whole") + (F.col("_part") > 0).cast("int"))
    rows = rows.withColumn("_copy", F.explode(copies)).withColumn("_cut", F.col("_copy") > F.col("_whole"))
    start = first_tokens(F.col("_doc.text"), F.col("_part").cast("int"))
    out = {c: F.col(f"_doc.`{c}`") for c in docs.columns}
    out["text"] = F.when(F.col("_cut"), start).otherwise(out["text"])
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("_cut"), F.length(start).cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return rows.select(*[value.alias(c) for c, value in out.items()])
