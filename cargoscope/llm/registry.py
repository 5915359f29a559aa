"""Queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cargoscope.llm import (
    op1_token_store,
    op2_packing,
    op3_minmax_dedup,
    op4_repeats,
    op5_language,
    op6_line_dedup,
    op7_decontaminate,
    op8_token_counts,
    op9_quality,
    op10_chat,
    op11_prefix_trie,
    op12_spelling,
    op13_mixing,
)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_CHECKS: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = fn
        if sql is not None:
            _CHECKS[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_CHECKS)


@query("op1_token_store")
def token_store(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return op1_token_store.document_index(spark, docs, tokenizer_file("word_bpe_49k.json"), end_id=1)


@query("op2_packing")
def packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return op2_packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, capacity=2048)


@query("op3_minmax_dedup")
def minmax_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return op3_minmax_dedup.near_duplicates(table(spark, folder, "documents"), percent=85)


@query("op8_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return op8_token_counts.token_counts(table(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op10_chat")
def chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = op10_chat.with_probe(table(spark, folder, "conversations"))
    return op10_chat.format_chats(turns, full=False).drop("formatted", "loss_spans")


@query("op4_repeats")
def repeats(spark: SparkSession, folder: str) -> DataFrame:
    return op4_repeats.remove_repeats(table(spark, folder, "documents"), full=False)


@query("op5_language")
def language(spark: SparkSession, folder: str) -> DataFrame:
    return op5_language.identify(table(spark, folder, "documents"))


@query("op6_line_dedup", sql=op6_line_dedup.lines_sql("documents"))
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return op6_line_dedup.dedup_lines(docs)


@query("op7_decontaminate", sql=op7_decontaminate.contamination_sql("documents"))
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = (table(spark, folder, name) for name in ("documents", "benchmark"))
    return op7_decontaminate.contamination(docs, benchmark)


@query("op9_quality")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = (table(spark, folder, name) for name in ("documents", "labels"))
    return op9_quality.quality(docs, labels)


@query("op11_prefix_trie")
def prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = op11_prefix_trie.rebuilt(table(spark, folder, "conversations"), heads=4, apart=20)
    return op11_prefix_trie.prefix_trie(turns)


@query("op12_spelling")
def spelling(spark: SparkSession, folder: str) -> DataFrame:
    return op12_spelling.spelling_variants(table(spark, folder, "documents"))


@query("op13_mixing", sql=op13_mixing.mixing_sql("documents"))
def mixing(spark: SparkSession, folder: str) -> DataFrame:
    return op13_mixing.mix(table(spark, folder, "documents"))
