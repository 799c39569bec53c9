"""Quality rules as a short-circuit cascade (operator 9), DataFrame functions only.

A rule is a measure of the text and a limit. The cost of each rule and the
share it rejects are estimated on a sample; the rules then run in the order of
rejection per cost, and each one only sees what the earlier ones kept. The
order changes the time, never the verdict.

Null text counts as empty: no words, so it fails the first base rule. Texts of
any length are measured whole. Repeated rows are judged alike; extra columns,
whatever their names, pass through untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import WHITE, WHITE_CHARS, saved

SAMPLE_ROWS = 2000

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_100_WORDS = 30
MAX_DUP_LINES_PERCENT = 30
MIN_CHARS_PER_10_WORDS, MAX_CHARS_PER_10_WORDS = 20, 150


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{WHITE}]+")).cast("bigint")


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return (F.length(text) - F.regexp_count(text, F.lit(f"[{WHITE}]"))).cast("bigint")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint")


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE_CHARS)) != "")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def n_repeat_words(text: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more.

    The windows are sorted by hash, so equal ones become neighbours; the starts
    of those, back in text order, cover up to three words each. Sorting keeps
    the cost at n log n for texts of any length.
    """
    trimmed = F.btrim(text, F.lit(WHITE_CHARS))
    words = F.when(trimmed != "", F.split(trimmed, f"[{WHITE}]+")).otherwise(F.array().cast("array<string>"))

    def hashed(w: Column) -> Column:
        each = F.transform(
            w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("at"))
        )
        return F.sort_array(F.slice(each, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))))

    def starts(s: Column) -> Column:
        twice = F.filter(
            s,
            lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False))
            | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(twice, lambda x: x["at"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    return let(words, lambda w: let(hashed(w), lambda s: let(starts(s), covered))).cast("bigint")


@dataclass(frozen=True)
class Rule:
    """``rejects`` judges a text by measures, which are given as functions of their name."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]
    base: bool = False


MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_lines": lambda text: F.size(_lines(text)),
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
}

RULES = [
    Rule("few_words", lambda m: m("n_words") < MIN_WORDS, base=True),
    Rule("repeats", lambda m: 100 * m("n_repeat_words") > MAX_REPEAT_PERCENT * m("n_words"), base=True),
    Rule("symbols", lambda m: 100 * m("n_symbols") > MAX_SYMBOLS_PER_100_WORDS * m("n_words")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > MAX_DUP_LINES_PERCENT * m("n_lines")),
    Rule(
        "word_length",
        lambda m: (10 * m("word_chars") < MIN_CHARS_PER_10_WORDS * m("n_words"))
        | (10 * m("word_chars") > MAX_CHARS_PER_10_WORDS * m("n_words")),
    ),
]


def _of(text: Column) -> Callable[[str], Column]:
    return lambda name: MEASURES[name](text)


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def rejected(rules: list[Rule], measure: Callable[[str], Column]) -> Column:
    """Whether any rule rejects; CASE stops at the first that does."""
    out = F.when(rules[0].rejects(measure), True)
    for rule in rules[1:]:
        out = out.when(rule.rejects(measure), True)
    return out.otherwise(False)


def ordered(docs: DataFrame, rules: list[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second of cost, measured on a sample of about ``rows`` documents."""
    total = docs.count()
    if not total:
        return list(rules)
    sample = saved(docs.select(_text().alias("text")).sample(min(1.0, rows / total), 7))
    gain = {}
    for rule in rules:
        start = time.perf_counter()
        share = sample.agg(F.avg(rule.rejects(_of(F.col("text"))).cast("int"))).first()[0] or 0.0
        gain[rule.name] = share / (time.perf_counter() - start)
    return sorted(rules, key=lambda r: -gain[r.name])


def passed(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The documents that no rule rejects, with their columns; a measure is only taken while no rule has rejected."""
    return docs.filter(~rejected(ordered(docs) if rules is None else rules, _of(_text())))


def judged(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """All measures of every document and the verdict.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.
    """
    rules = ordered(docs) if rules is None else rules
    measured = docs.select("doc_id", *(f(_text()).alias(name) for name, f in MEASURES.items()))
    base = [r for r in rules if r.base]
    return measured.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        rejected(base, F.col).alias("base_failed"),
        (~rejected(rules, F.col)).alias("kept"),
    )
