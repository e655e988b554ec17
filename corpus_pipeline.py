"""Documents to packed training sequences: five stages, each one of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseframe.llm import exact, mixing, njoin, packing, toxicity
from pulseframe.llm.common import cut, tokenizer


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays: the smallest doc_id."""
    groups = njoin.near_groups(docs.select("doc_id", "text"), words=5, percent=80)
    others = groups.filter("doc_id <> component_id").select("doc_id")
    return docs.join(others.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of their sources uses them."""
    return mixing.mix(docs, keep=True).select("row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 4096 tokens."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", clean), ("exact dedup", copies), ("n-gram Jaccard join", near_copies), ("mixing", mixture), ("packing", sequences)]

#: Learned scores can't be expressed in SQL; tests/llm/test_packing_mixing.py compares every stage and run() with plain Python by full rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
