"""Corpus pipeline: from raw documents to packed training windows.

Stages, each a function (spark, docs, sf_dir) -> DataFrame over all that the one before it kept:
quality classifier (rejected documents go), toxicity (rejected documents go), n-gram Jaccard join (one document of each
group stays), mixing to target weights (chosen documents, once per epoch), packing into windows.  All but the last
return the columns of `documents`.  Every stage's result is written as Parquet in the shared folder and read again, so a
lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import jaccard, mixing, packing, quality, toxicity
from factloom.llm.common import table
from factloom.storage import shared_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.select_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("ngram_jaccard", jaccard_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL can't express the two classifiers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
