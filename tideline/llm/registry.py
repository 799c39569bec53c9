"""The registered queries of the corpus operators over the shipped tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import (
    bpe,
    conversation_trie,
    exact_dedup,
    filter_audit,
    license_scan,
    line_dedup,
    mixing,
    ngram_join,
    quality_ranking,
    quality_rules,
    secret_scan,
    substring_dedup,
    token_files,
)
from tideline.llm.common import new_folder

#: The four domains that sources are dealt to by number, and the weights of the mix.
DOMAINS = ("web", "reference", "forum", "news")
MIX = mixing.Mix(
    weights=({"web": 3, "reference": 4, "forum": 1, "news": 2}, {"en": 6, "de": 2, "fr": 2, "es": 1}, {}),
    budget_percent=90,
    max_epochs=4,
    seed=1,
)
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain(source: Column) -> Column:
    number = F.coalesce(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("bigint"), F.lit(0))
    return F.get(F.array(*map(F.lit, DOMAINS)), F.pmod(number, F.lit(len(DOMAINS))).cast("int"))


def mix_path(docs: DataFrame) -> list[Column]:
    return [domain(docs["source"]), docs["lang"], docs["source"]]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d, lang, source = MIX.levels
    return mixing.assigned(docs, mix_path(docs), MIX).select(
        "doc_id",
        F.col(d).alias("domain"),
        F.col(lang).alias("lang"),
        F.col(source).alias("source"),
        "n_tokens",
        F.col("_whole").cast("bigint").alias("epochs"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["kind"].isin(*secret_scan.BASE))
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint")
    counts = [count(kind).alias(f"n_{kind}") for kind in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_components(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Ids of every text and of the bytes they decode to."""
    ranks = bpe.load_ranks(public_tokenizers.path(TOKENIZER))
    ids = bpe.with_decoded(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return ids.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2("data", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.deduplicated_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("fp")


def op8_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    spelled = F.transform(
        "found", lambda x: F.concat_ws(":", x["line"].cast("string"), x["license"], x["percent"].cast("string"))
    )
    return found.select("doc_id", F.size("found").cast("bigint").alias("n_found"), F.array_join(spelled, ",").alias("found"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    masks = filter_audit.failed_masks(docs, docs["lang"])
    return filter_audit.audit(filter_audit.mask_counts(masks, table(spark, sf_dir, "labels")))


def shared_heads(lists: DataFrame) -> DataFrame:
    """The conversations of the query: each one's first turns are replaced by those of its family's head.

    A conversation ``c`` takes the first ``crc32(c) % 4`` turns of conversation
    ``c - c % 20`` and goes on with its own turns after as many.
    """
    heads = lists.where("conv_id % 20 = 0").select(
        F.col("conv_id").alias("_head"), F.slice("ids", 1, 3).alias("_ids"), F.slice("words", 1, 3).alias("_words")
    )
    h = F.expr("cast(crc32(cast(cast(conv_id as string) as binary)) % 4 as int)")
    joined = lists.withColumns({"_head": F.expr("conv_id - conv_id % 20"), "_h": h}).join(heads, "_head", "left")

    def rebuilt(name: str) -> Column:
        head = F.when(F.col(f"_{name}").isNull(), F.slice(name, 1, 0)).otherwise(F.slice(f"_{name}", F.lit(1), F.col("_h")))
        own = F.slice(name, F.col("_h") + 1, F.greatest(F.size(name) - F.col("_h"), F.lit(0)))
        return F.concat(head, own).alias(name)

    return joined.select("conv_id", rebuilt("ids"), rebuilt("words"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = conversation_trie.turn_lists(table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(shared_heads(lists))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all documents, each one ended by id 2, as they read back."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    back = token_files.stored_files(table(spark, sf_dir, "documents"), tokenizer, 2, new_folder(spark))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_secret_scan,
        op3_ngram_join,
        op4_bpe,
        op5_substring_dedup,
        op6_line_dedup,
        op7_exact_dedup,
        op8_quality_ranking,
        op9_quality_rules,
        op10_license_scan,
        op11_filter_audit,
        op12_conversation_trie,
        op13_token_files,
    )
}
