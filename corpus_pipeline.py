"""A corpus pipeline of five stages, each one operator: quality, exact copies, near copies, the mix of sources, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, exact_dedup, mixing, near_dedup, quality
from textloom.storage import materialise, scratch


# Each stage keeps the columns of its documents, whatever their names, and gives an empty table for an empty one.


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null and empty texts are scored as any other, rows that repeat an id each on their own."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each distinct text; null and empty texts are one text, and repeated rows and null ids are judged row by row."""
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more. Texts without words and rows without an id stay."""
    return near_dedup.without_near_duplicates(docs, shingle=5, numerator=80, denominator=100, bands=32, rows=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is a source of its own, documents without words add nothing to its size."""
    return mixing.mixed_documents(docs)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding them; a null text has none. A text that doesn't come back stops the job."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", keep_good), ("exact", drop_copies), ("near", drop_near_copies), ("mix", mix_sources), ("bpe", to_ids)]

#: The classifier and the signatures can't be said in SQL; tests/llm hold the stages exact and near against brute force, of the others only their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; each result is written as Parquet and read again, and what a stage wrote besides is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            made.remove(docs.stored_at)
    return STAGES[-1][1](spark, docs, sf_dir)
