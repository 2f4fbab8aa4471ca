"""A corpus pipeline: grade documents, keep one of each near-duplicate group, cut repeated passages, pack.

run() applies STAGES to documents; each stage takes (spark, docs, sf_dir) and
gets what the stage before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronograph.llm import ngram_join, packing, quality, suffix_dedup
from kronograph.llm.common import read, written
from kronograph.llm.queries import BYTE_BPE


def grade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return ngram_join.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words and more that occur elsewhere too; n_chars follows the text."""
    return suffix_dedup.remove_repeats(docs, window=suffix_dedup.PASSAGE, unit="words").withColumn("n_chars", F.length("text").cast("bigint"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packing.pack(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [("quality classifier", grade), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeats), ("packing", pack)]

#: Neither the classifier nor byte-level BPE can be expressed in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
