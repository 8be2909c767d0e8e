"""Queries on public-API records made from the part table."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import schemas
from factloom.functions.typestrings import TypeParser
from factloom.operators import api as A
from factloom.views import ctes, frame

#: Type strings and their structured forms, by hand.
CASES = [
    ("string", '"string"'), ("number[]", '{"list": "float64"}'), ("Promise<boolean | undefined>", '{"nullable": "boolean"}'), ("ReadonlyArray<Date>", '{"list": "string"}'), ("Map<string, number>", '"Json"'), ('"a" | "b"', '"string"'),
    ("net.Server", '{"foreign": {"name": "net.Server", "rustPath": "net::Server"}}'), ("(code: number, why?: string) => void", '{"callback": {"params": ["float64", "string"]}}'), ("() => Promise<void>", '"Json"'), ("Uint8Array | null", '{"nullable": "bytes"}'),
    ("Readonly<string[]>", '{"list": "string"}'), ("T extends string ? 1 : 2", '"Json"'), ("((x: bigint) => void) | undefined", '{"nullable": {"callback": {"params": ["int64"]}}}'), ("Brand | Size", '{"union": "BrandOrSizeUnion"}'), ("true | false", '"boolean"'), ("42", '"float64"'),
]


@F.pandas_udf(T.StringType())
def parsed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: json.dumps(TypeParser().parse(s)[0]))


def type_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "SELECT p_partkey AS k FROM {part}")
    text = F.element_at(F.array(*[F.lit(c) for c, _ in CASES]), (F.col("k") % len(CASES) + 1).cast("int"))
    return rows.select("k", text.alias("text")).select("k", "text", parsed("text").alias("structured"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per brand, a module per size class, an item per part; items in the order of part keys."""
    rows = frame(spark, sf_dir, "SELECT p_partkey AS k, p_brand AS b, p_size % 4 AS m FROM {part}")
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("function", "interface", "const", "typeAlias", "class", "method")]), (F.col("k") % 6 + 1).cast("int"))
    kind_text = F.element_at(F.array(*[F.lit(c) for c, _ in CASES]), (F.col("k") % len(CASES) + 1).cast("int"))
    item = F.to_json(F.struct(
        kinds.alias("kind"), F.concat(F.lit("i"), "k").alias("id"), F.concat(F.lit("Name"), (F.col("k") * 7 % 1000).cast("string")).alias("name"), F.lit("public").alias("visibility"),
        F.struct(F.array(F.struct(F.lit("x").alias("name"), kind_text.alias("ty"), F.lit(False).alias("optional"))).alias("params"), F.when(F.col("k") % 2 == 0, F.lit("Promise<string>")).otherwise(F.lit("void")).alias("returnType"), F.lit(False).alias("isAsync"), F.concat(F.lit("Name"), ((F.col("k") - 1) * 7 % 1000).cast("string")).alias("receiver")).alias("signature"),
        F.array(F.struct(F.lit("f").alias("name"), kind_text.alias("ty"), (F.col("k") % 3 == 0).alias("optional"))).alias("fields"), F.when(F.col("k") % 12 < 6, F.lit('"x" | "y"')).otherwise(F.lit("Name1 | Name8")).alias("aliasTarget"),
        F.when(F.col("k") % 4 == 0, F.lit("any")).otherwise(F.lit("number")).alias("constType"), F.lit("7").alias("constValue"),
    ))
    modules = rows.withColumn("item", item).groupBy("b", "m").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda s: s["item"]).alias("items"))
    text = F.concat(F.lit('{"path":"m'), F.col("m").cast("string"), F.lit('","items":['), F.array_join("items", ","), F.lit("]}"))
    package = modules.groupBy("b").agg(F.array_join(F.sort_array(F.collect_list(text), False), ",").alias("modules"))
    doc = F.concat(F.lit('{"package":{"name":"'), "b", F.lit('","language":"typescript","root":"."},"fidelity":{"source":"s","complete":true,"notes":[]},"modules":['), "modules", F.lit("]}"))
    return package.select(F.from_json(doc, schemas.struct(schemas.API_REPORT)).alias("r")).select("r.*")


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.normalize_reports(reports(spark, sf_dir)).select(F.col("package.name").alias("package"), F.posexplode("modules").alias("module_no", "m"))
    return out.select("package", "module_no", F.col("m.path").alias("module"), F.posexplode("m.items").alias("item_no", "i")).select("package", "module_no", "module", "item_no", "i.kind", "i.name", "i.id")


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.structured_surface(A.api_items(reports(spark, sf_dir)))


_TEXT = ", ".join("'" + a.replace("'", "''") + "'" for a, _ in CASES)
_FORM = ", ".join("'" + b.replace("'", "''") + "'" for _, b in CASES)
QUERIES = {"api_type_strings": type_strings, "api_normalized": normalized, "api_structured": surface}
SQL = {
    "api_type_strings": ctes(f"SELECT p_partkey AS k, [{_TEXT}][p_partkey % {len(CASES)} + 1] AS text, [{_FORM}][p_partkey % {len(CASES)} + 1] AS structured FROM {{part}}"),
    "api_normalized": ctes("""
WITH i AS (SELECT p_brand AS package, 'm' || p_size % 4 AS module, ['function', 'interface', 'const', 'typeAlias', 'class', 'method'][p_partkey % 6 + 1] AS kind, 'Name' || p_partkey * 7 % 1000 AS name, 'i' || p_partkey AS id, p_partkey AS k FROM {part})
SELECT package, CAST(dense_rank() OVER (PARTITION BY package ORDER BY module) - 1 AS INTEGER) AS module_no, module, CAST(row_number() OVER (PARTITION BY package, module ORDER BY kind, name, k) - 1 AS INTEGER) AS item_no, kind, name, id FROM i"""),
}
