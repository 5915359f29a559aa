"""Cleaning of a document corpus in stages; each stage's result is written and read by the next.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the
last return the columns of ``documents``; the last returns the packed token pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoscope.llm import op2_packing, op3_minmax_dedup, op6_line_dedup, op7_decontaminate, op9_quality
from cargoscope.llm.registry import table, tokenizer_file
from cargoscope.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return op9_quality.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or one edit away from an earlier one go; ``n_chars`` follows the text."""
    cleaned = op6_line_dedup.dedup_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return op3_minmax_dedup.keep_one(docs, percent=80).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return op7_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in as few sequences as possible.

    The executors' memory is full from the stages before, so workers remember fewer words.
    """
    file = tokenizer_file("byte_bpe_50k.json")
    return op2_packing.pack(docs, file, end_id=0, capacity=2048, slice_bytes=1 << 20, words=150_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can neither grow the forest nor encode tokens; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
