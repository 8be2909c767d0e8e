"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import chat, fingerprints, jaccard, mixing, neardup, packing, pages, quality, toxicity, warc
from factloom.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.chunk_pages(table(spark, sf_dir, "pages"))


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(table(spark, sf_dir, "embeddings"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.similar_classes(table(spark, sf_dir, "documents"))


def op6_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.own_text(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_packing, op2_warc_chunks, op3_chat_rotation, op4_embedding_neardup, op5_fingerprints, op6_page_differencing, op7_toxicity, op8_ngram_jaccard, op9_mixing, op10_quality]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_chunks": warc.chunk_pages_sql(), "op3_chat_rotation": chat.ROTATE_SQL, "op4_embedding_neardup": neardup.CLASSES_SQL, "op8_ngram_jaccard": jaccard.CLASSES_SQL, "op9_mixing": mixing.MIX_SQL}
