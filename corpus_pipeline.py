"""Corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, benchmark decontamination, byte-level BPE.

Each stage reads what its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferrymass.checkpoints import sweep, written
from ferrymass.llm import byte_bpe, decontam, exact_dedup, ngram_join, quality
from ferrymass.llm.store import persist


def _good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts, the document with the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def _apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of near copies connect, the one with the smallest id."""
    return ngram_join.drop_near_copies(docs)


def _clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and of the bytes they decode to."""
    return byte_bpe.digests(docs)


STAGES = [("quality classifier", _good), ("exact dedup", _distinct), ("n-gram Jaccard join", _apart), ("benchmark decontamination", _clean), ("byte-level BPE", _tokens)]

#: A trained classifier and shingle components of text are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's output is written and reread as the next one's input, and the tables in between go.

    Null texts count as empty and a row goes by its own id and text, so null and
    shared ids lose nothing; rows that repeat both stay or go together. Texts of
    any length go through whole, and columns whatever their names. Ties go as each
    stage's operator says; empty documents give no rows.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for k, (_, stage) in enumerate(STAGES):
        docs = persist(stage(spark, docs, sf_dir), f"pipeline-{k}")
        sweep(spark, docs, before)
    return docs
