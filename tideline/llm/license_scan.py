"""License scans (operator 10), DataFrame functions only.

A text is looked at in blocks, its lines. A block is normalised (runs of
anything but ASCII letters and digits become one blank, A-Z lower-cased) and
compared to each license template by the Dice coefficient of the multisets of
neighbouring word pairs, ``2 * common / (pairs of the block + pairs of the template)``.

The coefficient of multisets of sizes a and b is at most ``2 * min(a, b) / (a + b)``,
so a block can only reach the threshold t with templates of ``a * t / (2 - t)``
to ``a * (2 - t) / t`` pairs. Blocks outside the bounds of all templates, the
bulk of a corpus, are dropped by their word count alone; the others are only
compared with the templates within their bounds.

The templates are a parameter: a short list that is part of the plan, so nothing
is joined or shuffled. Null and empty texts have no matches; long texts are
scanned whole; repeated rows match alike; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The license statements that are looked for, as people write them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This work is subject to the terms of the Mozilla Public License, version 2.0."),
    ("reserved", "All rights reserved."),
)
#: Least Dice coefficient, in percent.
PERCENT = 80


def _counted(template: str) -> Counter:
    words = re.sub("[^0-9A-Za-z]+", " ", template).lower().split()
    return Counter(zip(words, words[1:]))


def size_bounds(size: int, percent: int = PERCENT) -> tuple[int, int]:
    """Least and most pairs of a block that can reach the threshold with a template of ``size`` pairs."""
    return -(-size * percent // (200 - percent)), size * (200 - percent) // percent


def _let(value: Column, body) -> Column:
    """Bind a value once inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pairs(block: Column) -> Column:
    """The block's word pairs, each with the number of equal ones before it, so that a set holds the multiset."""
    words = F.split(F.btrim(F.lower(F.regexp_replace(block, "[^0-9A-Za-z]+", " "))), " ")

    def numbered(pairs: Column) -> Column:
        return F.transform(
            pairs,
            lambda x, i: F.concat_ws(" ", x, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda y: y == x)).cast("string")),
        )

    def paired(w: Column) -> Column:
        return F.transform(F.slice(w, F.lit(2), F.size(w)), lambda x, i: F.concat_ws(" ", F.get(w, i), x))

    return _let(words, lambda w: _let(paired(w), numbered))


def matches(text: Column, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = PERCENT) -> Column:
    """``array<struct<line, license, percent>>``: the best template of every line that reaches the threshold.

    ``line`` counts from 1, ``percent`` is the coefficient rounded down; of equal ones the first template wins.
    """
    counted = [(name, _counted(t)) for name, t in templates]
    sizes = [sum(c.values()) for _, c in counted]
    low = min(size_bounds(s, percent)[0] for s in sizes)
    high = max(size_bounds(s, percent)[1] for s in sizes)

    def scored(pairs: Column, k: int) -> Column:
        least, most = size_bounds(sizes[k], percent)
        wanted = F.array(*[F.lit(f"{a} {b} {i}") for (a, b), n in counted[k][1].items() for i in range(n)])
        share = 200 * F.size(F.array_intersect(pairs, wanted)) / (F.size(pairs) + sizes[k])
        found = F.struct(share.alias("share"), F.lit(-k).alias("order"), F.lit(counted[k][0]).alias("license"))
        return F.when(F.size(pairs).between(least, most), found)

    def best(line: Column) -> Column:
        found = _let(_pairs(line["text"]), lambda p: F.array_max(F.array(*[scored(p, k) for k in range(len(sizes))])))
        return F.struct(line["at"].alias("line"), found["license"].alias("license"), found["share"].alias("share"))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct((i + 1).alias("at"), x.alias("text")))
    # Words of a block are its pairs and one more.
    near = F.filter(lines, lambda x: F.regexp_count(x["text"], F.lit("[0-9A-Za-z]+")).between(low + 1, high + 1))
    hits = F.filter(F.transform(near, best), lambda x: x["share"] >= percent)
    return F.transform(
        hits,
        lambda x: F.struct(x["line"].alias("line"), x["license"].alias("license"), F.floor(x["share"]).cast("int").alias("percent")),
    )


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """``doc_id, found`` of every row."""
    return docs.select("doc_id", matches(F.col("text"), templates, percent).alias("found"))
