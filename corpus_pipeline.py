"""The corpus pipeline: documents to token ids in five stages, each one operator of measurekit.llm.

Every stage is a function of (spark, docs, sf_dir) whose rows are written as Parquet under `spark.checkpoint.dir` and read again as
the next one's docs, so a lost executor costs one stage's work at most. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measurekit.llm import bpe, langid, mixing, near_dup, suffix_dedup
from measurekit.llm.shared import Scratch, tune


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents without a letter, or far from every language learned from the corpus, go."""
    return langid.keep_identified(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of near duplicates stays."""
    return near_dup.keep_one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: passages of 200 bytes or more that stand anywhere else are cut out of the texts."""
    return suffix_dedup.drop_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents repeated or left out so that the words of each source come near its target."""
    return mixing.mix_sources(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the documents with their token ids (little-endian unsigned 32-bit) and the number of these; text is the decoded ids."""
    out = bpe.encode_documents(docs, bpe.default_vocabulary())
    ids, decoded = out.columns[-2:]
    text = F.when(F.col("text").isNotNull(), F.col(decoded)).alias("text")
    return out.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns], (F.length(ids) / 4).cast("long").alias("n_tokens"), F.col(ids).alias("token_ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each),
    ("suffix_array_dedup", without_repeats),
    ("source_mixing", mixed),
    ("bpe_tokens", tokenized),
]

# Language models, set similarity, maximal repeats and BPE are not expressible in SQL: tests/llm holds run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    scratch = Scratch(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
