"""Corpus pipeline over documents: known language, no repeated lines, one of each group of near copies, no benchmark
passages, then token ids. Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its
rows are written as Parquet and read again for the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinsift.llm import bpe, decontaminate, langid, linededup, simhash
from kinsift.llm.common import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without a letter, or that no language's code shortens, go."""
    return langid.in_known_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; documents of which no line is left go."""
    return linededup.without_repeats(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of linked fingerprints."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every document that is left: the number of token ids, and digests of the ids and of what they decode to."""
    return bpe.round_trip_digests(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", copies), ("decontamination", benchmark), ("bpe", tokens)]

#: Stages go beyond SQL: a trained model, tries of fingerprints, a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage on the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k + 1}-{name}")
    return docs
