"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

The documents of the tables pass through all stages; a stage works on all rows that its predecessor
kept. A filtering stage returns the columns of its input, whatever they are.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from offerlens.llm import bpe, decontaminate, near_dup, repetition, toxicity
from offerlens.sources.scratch import ensure_scratch, materialise
from offerlens.sources.shipping import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_scratch(spark)
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.keep_clean(docs, _table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the repeat rules reject go."""
    ship_package(spark)
    return repetition.keep_varied(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words and 80 percent, stays."""
    ensure_scratch(spark)
    ship_package(spark)
    return near_dup.keep_one_of_each(docs, NEAR)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_uncontaminated(docs, _table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the packed ids, and the SHA-256 of the ids and of the decoded text."""
    ship_package(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.byte_pairs(docs, path, public_tokenizers.PATTERN, REMEMBERED), "ids")


#: Five words and 80 percent; 24 bands of 4 rows miss a link with a probability below 1 in 100,000,
#: and fewer than 52 of their 96 coordinates are equal less than once in 10 million links.
NEAR = near_dup.Sketch(width=5, percent=80, bands=24, rows=4, least_equal=52)

#: Pieces that a worker of the token stage remembers, a quarter of what it would alone: four stages
#: have filled the executor's memory before it.
REMEMBERED = bpe.REMEMBERED // 4

STAGES = [
    ("toxicity", toxic_texts),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("token_ids", token_ids),
]

#: Classifier and tokenizer stages have no SQL form; tests compare the run with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
