"""Corpus preparation: five stages over the documents table, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumendex.llm import common, decontaminate, langid, mixing, neardup, spans


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or of no confidently known language go."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: SimHash links, checked at Jaccard >= 0.8 on five-word shingles, and exactly the rest."""
    return neardup.keep_one(docs)


def drop_repeated_sentences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of any non-first repeated span go; a document left without sentences goes."""
    return spans.rewrite(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, common.load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies by source towards square-root-of-size weights, globally shuffled."""
    return mixing.mix(docs, mixing.temperature_weights(docs))


STAGES = [
    ("language_id", identify_language), ("near_dedup", drop_near_duplicates), ("substring_dedup", drop_repeated_sentences),
    ("decontaminate", drop_benchmark_leaks), ("mix_sources", mix_sources),
]

#: SQL has no XXH64 fingerprints, trained classifiers or content-defined sentence cuts; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", release=True)
    return docs
