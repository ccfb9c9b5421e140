"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .chat import chat_report
from .chat import oracle_sql as chat_sql
from .common import small_batches
from .common import table as plain_table
from .decontaminate import decontamination_report
from .embeddings import cosine_components
from .embeddings import oracle_sql as cosine_sql
from .html_extract import extract_main_text
from .jaccard import jaccard_components
from .jaccard import oracle_sql as jaccard_sql
from .language import language_report
from .licences import oracle_sql as licence_sql
from .licences import scan_licences
from .packing import pack_documents
from .toxicity import toxicity_report
from .warc import archive_report
from .warc import oracle_sql as archive_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return plain_table(spark, sf_dir, name)


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_html_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(table(spark, sf_dir, "pages"))


def op6_language_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op7_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_chat_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_report(table(spark, sf_dir, "conversations"))


def op10_embedding_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_components(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_warc_revisits": archive_sql(),
        "op7_licence_digests": licence_sql(),
        "op8_ngram_jaccard": jaccard_sql(),
        "op9_chat_prefixes": chat_sql(),
        "op10_embedding_lsh": cosine_sql(),
    }
