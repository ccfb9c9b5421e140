"""A training-data pipeline of five stages over ``documents``; part of the training-data subpackage.

Each stage gets what its predecessor kept.  All but the last return the columns
of ``documents``: language identification and toxicity drop the documents that
they reject, the n-gram Jaccard join keeps the smallest doc_id of each group,
decontamination drops documents that hold a benchmark item, and packing returns
one row per piece with its place.  Rows with a null doc_id cannot be grouped or
matched and stay; an empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectora.llm.common import crc_mod, small_batches, table, written
from sectora.llm.decontaminate import leaked_items
from sectora.llm.jaccard import jaccard_components
from sectora.llm.language import UNDETERMINED, identify_language, train_language_model
from sectora.llm.packing import pack_documents
from sectora.llm.toxicity import THRESHOLD, score_toxicity, train_toxicity_index

NEAR_WORDS = 5
NEAR_PERCENT = 80
SURE = 0.1
TOKENIZER = "word_bpe_49k.json"


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not use."""
    while name in docs.columns:
        name = "_" + name
    return name


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids`` (one column)."""
    gone = written(ids.toDF("gone_id").where("gone_id IS NOT NULL").distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null, empty or without a letter, and those that the network
    takes for no learned language: its best score is hardly above chance (SURE of the way to certainty).

    Where no row names a language, only the letter counts.
    """
    small_batches(spark)
    model = train_language_model(docs, crc_mod("doc_id", 3) != 1)
    if not model.classes:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    chance = 1 / len(model.classes)
    pred, score = _free(docs, "lang_pred"), _free(docs, "lang_score")
    known = (F.col(pred) != UNDETERMINED) & (F.col(score) >= chance + SURE * (1 - chance))
    return identify_language(docs, model, pred=pred, score=score).where(known).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of THRESHOLD or more."""
    small_batches(spark)
    index = train_toxicity_index(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    score = _free(docs, "toxicity")
    return score_toxicity(docs, index, score=score, evidence=None).where(F.col(score) < THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates, once if its row is repeated.

    Rows that share a doc_id but not a text are judged one by one.
    """
    small_batches(spark)
    groups = written(jaccard_components(docs, NEAR_WORDS, NEAR_PERCENT, with_hash=True), "groups")
    gone = written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), "gone")
    mark = _free(docs, "text_hash")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    kept = marked.join(gone, (marked["doc_id"] == gone["gone_id"]) & (marked[mark] == gone["gone_hash"]), "left_anti").select(*docs.columns)
    repeated = written(groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")), "again")
    if not repeated.limit(1).count():
        return kept
    once = kept.join(repeated, kept["doc_id"] == repeated["again"], "left_semi").dropDuplicates(["doc_id"])
    return _without(kept, repeated).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, also with other names, numbers or units."""
    return _without(docs, leaked_items(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The stages learn, search and tokenise: no SQL states them; tests compare them, stage by stage, with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
