"""Corpus pipeline: quality, repeated lines, near-duplicates, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept, written
as Parquet and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepane.llm.decontaminate import decontaminate
from tidepane.llm.jaccard import keep_one
from tidepane.llm.line_chunks import run_dedup
from tidepane.llm.pieces import sampled_encodings
from tidepane.llm.quality import keep_good
from tidepane.llm.tables import load
from tidepane.sources.shared import stage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, load(spark, sf_dir, "labels"))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of two lines or more go but for their first occurrence; ``n_chars`` follows the text."""
    kept = run_dedup(docs)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else kept


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8."""
    return keep_one(docs, n=5, num=80, den=100)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontaminate(docs, load(spark, sf_dir, "benchmark"), remove="documents")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document: piece ids, log probability, inclusion score."""
    return sampled_encodings(docs)


STAGES = [
    ("quality", good_documents),
    ("line_dedup", unrepeated_lines),
    ("jaccard", one_of_each),
    ("decontamination", uncontaminated),
    ("pieces", encoded),
]

#: The classifier, the sampling and the hashes that place chunk boundaries have no form in SQL; the
#: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
