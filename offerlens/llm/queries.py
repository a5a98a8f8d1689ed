"""One query per operator, over whole tables."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm import (
    bpe,
    chat,
    collocation,
    decontaminate,
    html_text,
    near_dup,
    quality,
    repetition,
    spelling,
    suffix_tree,
    token_budget,
    toxicity,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents")).drop("spans", "longest_repeat")


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, _ = warc.archive_pages(table(spark, sf_dir, "pages"))
    return headers.select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to"
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pairs = bpe.byte_pairs(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.digests(pairs)


def op5_token_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_budget.token_budgets(table(spark, sf_dir, "documents"), path, limit=2048)


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(table(spark, sf_dir, "pages"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = suffix_tree.fold(F.col("doc_id"), 5, 1)
    training = F.col("doc_id").isNotNull() & ~held_out
    scored = suffix_tree.scores(table(spark, sf_dir, "documents"), training)
    return scored.withColumn("held_out", held_out)


def op9_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapsed_chats(table(spark, sf_dir, "conversations"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), changed=spelling.misprint)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_repetition,
        op2_revisits,
        op3_toxicity,
        op4_byte_pairs,
        op5_token_budgets,
        op6_main_text,
        op7_near_duplicates,
        op8_suffix_tree,
        op9_templates,
        op10_chats,
        op11_spelling,
        op12_collocations,
        op13_quality,
    )
}
