"""A corpus pipeline over ``documents``: rules, exact and near copies, mixing, tokens.

Every stage works on all rows that the one before it kept; all but the last
return the columns of ``documents``. Null texts fail the quality rules, so later
stages see none. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import exact_dedup, mixing, ngram_join, quality_rules, registry
from tideline.llm.common import saved

#: Copies were just removed, so no document is taken twice.
MIX = replace(registry.MIX, max_epochs=1)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that a quality rule rejects go."""
    return quality_rules.passed(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of equal texts the row with the largest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near copies the smallest doc_id stays."""
    return ngram_join.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents are drawn until each source has its share of the budget."""
    return mixing.mixed(docs, registry.mix_path(docs), MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: ids of every text, and what they decode to."""
    return registry.bpe_digests(docs)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing", mix),
    ("byte-level BPE", tokens),
]

#: The folded merges of the last stage have no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
