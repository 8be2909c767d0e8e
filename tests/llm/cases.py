"""Awkward tables: nulls everywhere, empty and very long texts, ties, repeated rows, extra columns with clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
#: Names that operators use inside.
CLASHES = "key bucket home part shard score epoch place id rep component block other tokens n row gram level window_id n_tokens rest before inside quality toxic keeper partner lines host path count vec i j a b a_ _gone _doc_id blank who said turns".split()


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abdeghiklmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(n))


def docs(spark: SparkSession) -> DataFrame:
    base, long = words(1, 120), words(2, 60_000)
    near = base.replace(base.split()[50], "changed", 1)
    rows = [
        (1, base, "en", "src0", 1), (2, None, "en", "src1", None), (3, "", None, "src0", 0), (4, " \n\t ", "de", None, 4), (None, words(3, 80), "en", "src2", 9), (5, long, "fr", "src3", 7),
        (6, base, "en", "src1", 1), (6, base, "en", "src1", 1), (7, near, None, None, None), (8, "one", "en", "src0", 3), (9, words(4, 200), "es", "src9", 3), (10, long + " end", "fr", "src3", 7), (None, None, None, None, None), (11, "Ünïcödé 漢字 🙂 " * 30, "xx", "src0", 2),
    ]
    return spark.createDataFrame(rows, DOCS)


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 1, 0), (9, 0, 1), (8, None, None), (None, 1, 1), (99, 0, 0), (1, 1, 0), (11, 0, 0), (5, 1, 0)], LABELS)


def clashing(df: DataFrame) -> DataFrame:
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in have])
