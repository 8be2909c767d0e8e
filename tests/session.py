"""One local session for all tests, and the comparison of a query with its SQL on DuckDB."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def local_session() -> SparkSession:
    conf = {
        "spark.master": f"local[{os.environ.get('TEST_CPUS', '4')}]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(f"{sf_dir}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    if isinstance(x, float):
        return None if x != x else round(x, 9)
    if isinstance(x, (bytearray, memoryview)):
        return bytes(x)
    return x


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None) if len(frame) else frame
    return sorted((tuple(_plain(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


def same_as_sql(df: DataFrame, sql: str, sf_dir: str) -> None:
    """Equal columns and equal bags of rows."""
    got = df.toPandas()
    want = duck(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
