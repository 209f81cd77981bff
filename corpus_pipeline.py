"""Corpus cleaning pipeline: toxicity, near-dedup, substring dedup, decontamination, packing.

Each stage reads what the one before kept; all but the last return the columns of ``documents``.
Stages that reject documents leave the others untouched; substring dedup cuts repeated passages out of
the text and keeps the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reachkit.llm import common as c
from reachkit.llm import decontaminate, neardup, packing, substring, toxicity
from reachkit.llm.catalog import tokenizer


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that score at least 0.3 for toxicity (learned from ``labels``)."""
    return toxicity.remove_toxic(docs, c.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the smallest id, of each group of near copies (five-word shingles, 0.8)."""
    return neardup.keep_one(docs, shingle=5, threshold=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every passage of 50 or more words that an earlier document has too."""
    return substring.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents of which 5 % of the words or more lie in 13-word windows of ``benchmark``."""
    return decontaminate.decontaminate(docs, c.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the kept documents into sequences of 1024 tokens: one row per piece."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", toxic), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("decontamination", decontamination), ("packing", pack)]
ORACLE_SQL = None  # the toxicity model has no SQL form; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and reread as the next one's input."""
    docs = c.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = c.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
