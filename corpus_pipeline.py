"""The document pipeline: STAGES one after another over ``documents``.

Each stage is (spark, docs, sf_dir) -> DataFrame, works on all that its
predecessor kept, and its result is written as Parquet before the next one reads
it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesaudit.llm.decontaminate import drop_leaks
from salesaudit.llm.exact import drop_copies
from salesaudit.llm.language import keep_identified
from salesaudit.llm.neardup import drop_near_copies
from salesaudit.llm.packing import pack
from salesaudit.llm.queries import table, vocabulary
from salesaudit.llm.shared import saved


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Profiles are learned from all documents with a language."""
    return keep_identified(docs, F.lit(True))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id: five words, similarity 0.8."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 2048 tokens."""
    placed = pack(docs, vocabulary())
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

# Learned profiles, sketches, alignments and a tokenizer: SQL cannot express the stages.
# tests/llm/test_pipeline.py holds run() against a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
