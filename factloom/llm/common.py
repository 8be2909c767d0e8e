"""Shared column expressions of the training-data operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates tokens, everywhere in this subpackage.
WHITE = " \\t\\n\\r\\f"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of white-space separated tokens; 0 for null, empty and blank texts.

    A token starts where a solid character follows the start or white space, so counting tokens is counting the
    pieces of a split after trimming; both run inside whole-stage code.
    """
    core = F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")
    return F.when(F.coalesce(F.length(core), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(core, f"[{WHITE}]+"))).cast("long")


WORD_COUNT_SQL = (
    "CASE WHEN length(coalesce(trim({0}, chr(32)||chr(9)||chr(10)||chr(13)||chr(12)), '')) = 0 THEN 0 ELSE "
    "len(string_split_regex(trim({0}, chr(32)||chr(9)||chr(10)||chr(13)||chr(12)), '[ \\t\\n\\r\\f]+')) END"
)


def partitions_for(total: float, each: float) -> int:
    """How many groups hold `total` units when one should hold about `each`; never less than one."""
    return max(1, math.ceil((total or 0) / each))


#: Largest table of ids and small numbers that is broadcast; counted before, and joined by a shuffle beyond it.
BROADCAST_BYTES = 48 << 20


def small_side(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """df (a written table) with a broadcast hint if its rows fit BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
