"""A corpus pipeline over documents: toxicity, quality rules, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of documents. Rows without id stay in
filtering stages, which judge each row by its text alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldstream.llm import bpe, mixing, near_dup, quality, toxicity
from fieldstream.llm.common import forget_all, settled, table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of any severity above clean stays below one half."""
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the repetition limits."""
    return quality.keep(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of near copies (five words, similarity of 0.8)."""
    return near_dup.keep(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, shuffled within output shards."""
    return mixing.mix(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mixture."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", tokens_stage),
]

#: A fitted model and a seeded draw decide what stays; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents below sf_dir; a stage's input and scratch tables go when it is done."""
    docs, since = table(spark, sf_dir, "documents"), len(written)
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
        forget_all(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
