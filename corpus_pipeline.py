"""A corpus pipeline: each stage works on all documents that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from obsgrain.llm import bpe, bytecnn, exact, mixing, nearcopies
from obsgrain.llm.common import discard, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which language identification finds a language; null and empty texts and those without letters (`und`) go.

    A document's own language is learned from, but not looked at when it is judged; if there is none at all, letters decide.
    Rows without an id and repeated rows are judged like any other; a table without rows gives none.
    """
    return bytecnn.keep_known(docs, bytecnn.train(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, told apart by place: also of rows without an id and of repeated rows."""
    return exact.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies; rows without an id stay; of repeated rows one stays."""
    return nearcopies.keep_one(docs, nearcopies.near_copies(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as its source's budget takes it; null is a source of its own, texts without words weigh nothing."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests, its language and its source; a null or empty text has no tokens."""
    return bpe.bpe(docs, with_ids=True, keep=("lang", "source"))


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("tokens", tokens)]

#: The stages learn and sample, which SQL does not express; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again, and deleted when the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        path = scratch(spark, f"stage-{name}")
        out.write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
