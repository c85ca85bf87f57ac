"""Raw documents to packed training sequences: five stages over the operators of storyloom.llm.

Every stage takes (spark, docs, sf_dir) and all rows that the one before kept. The first four return the columns of
documents; the last returns a row for each piece of each packed sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import langid, mixing, neardup, packing, quality
from storyloom.llm.common import materialize
from storyloom.tables import drop, scratch


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier names; those that it rejects go."""
    return langid.keep_named(docs, langid.fit(docs.select("doc_id", "text", "lang")))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return neardup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2,048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("language id", identify), ("quality rules", good), ("near duplicates", distinct), ("source mix", mixed), ("packing", packed)]

#: No stage but the mix could be written in SQL: a trained classifier, signatures, tokens and a packing plan decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over all documents, each written and read again. When a stage is written, what it wrote on its way and the
    stage before are deleted, so the shared folder holds one stage at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, kept = docs, []
        with scratch(kept):
            docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
            kept.append(docs)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
