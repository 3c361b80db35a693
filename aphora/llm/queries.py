"""The registered queries of this folder: each operator over its whole table, with its statement in SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from aphora.llm import divergence, language, leaks, mixing, near, packing, pages, quality, repeats, shards, spelling, subwords, vantage
from aphora.llm.tables import table

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.removed_words(table(spark, folder, "documents", "doc_id", "text"))


def op2(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents", "doc_id", "text"), tokenizer_path())


def op3(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.contamination(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text")).drop("row")


def op4(spark: SparkSession, folder: str) -> DataFrame:
    return shards.shard_documents(table(spark, folder, "documents", "doc_id", "text"))


def op5(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_classes(table(spark, folder, "documents", "doc_id", "text"))


def op6(spark: SparkSession, folder: str) -> DataFrame:
    return pages.main_text(table(spark, folder, "pages", "page_id", "url", "html"))


def op7(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.score_corpus(table(spark, folder, "documents", "doc_id", "text"))


def op8(spark: SparkSession, folder: str) -> DataFrame:
    return quality.grade_corpus(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "labels", "doc_id", "quality"))


def op9(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify_corpus(table(spark, folder, "documents", "doc_id", "text", "lang"))


def op10(spark: SparkSession, folder: str) -> DataFrame:
    return vantage.search_table(table(spark, folder, "embeddings", "vec_id", "embedding"))


def op11(spark: SparkSession, folder: str) -> DataFrame:
    return subwords.encode_corpus(table(spark, folder, "documents", "doc_id", "text"), tokenizer_path(PIECES))


def op12(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents", "text", "lang", "source"))


def op13(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents", "doc_id", "text"))


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": Query(op1),
    "op2_packing": Query(op2),
    "op3_decontamination": Query(op3, leaks.SQL),
    "op4_sharding": Query(op4),
    "op5_minhash_dedup": Query(op5),
    "op6_html_extraction": Query(op6),
    "op7_lm_scoring": Query(op7),
    "op8_quality": Query(op8),
    "op9_language_id": Query(op9),
    "op10_vantage_search": Query(op10, vantage.SQL),
    "op11_sentencepiece": Query(op11),
    "op12_source_divergence": Query(op12, divergence.SQL),
    "op13_spelling_variants": Query(op13),
}
