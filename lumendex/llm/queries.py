"""Registered queries of the ten operators, with their production parameters, and oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumendex.llm import chat, decontaminate, langid, licenses, mixing, simhash, spans, suffix, topk, toxicity
from lumendex.llm.common import load


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(load(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.corpus_paths(load(spark, sf_dir, "documents")), keep=["doc_id"])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.temperature_weights(docs))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_chat(chat.with_probe(load(spark, sf_dir, "conversations"))))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.dedup(load(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup(load(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_simhash, op3_toxicity, op4_langid, op5_licenses, op6_mixing, op7_topk, op8_chat, op9_suffix, op10_spans, pipeline,
)}

ORACLES = {"op1_decontaminate": decontaminate.ORACLE, "op6_mixing": mixing.ORACLE, "op7_topk": topk.ORACLE, "op8_chat": chat.ORACLE, "op9_suffix": suffix.ORACLE, "op10_spans": spans.ORACLE}
