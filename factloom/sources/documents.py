"""JSON documents of extractors as tables, and results as JSON."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schemas


def _documents(spark: SparkSession, paths: str | list[str], ddl: str) -> DataFrame:
    return spark.read.schema(schemas.struct(ddl)).json(paths, multiLine=True)


def read_facts(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(definitions, edges, roots) of facts documents; paths may be globs, so shards of a package are read together.

    Missing arrays are empty; a missing resolution is 'call', missing flags are false.  Of definitions with one id the
    last counts (by file name, then place in the document).
    """
    docs = _documents(spark, paths, schemas.FACTS_DOC).withColumn("_file", F.col("_metadata.file_path"))
    defs = docs.select("_file", F.posexplode("definitions").alias("_at", "d")).select("_file", "_at", "d.*")
    last = defs.groupBy("id").agg(F.max_by(F.struct(*[c for c in defs.columns if c != "id"]), F.struct("_file", "_at")).alias("d")).select("id", "d.*").drop("_file", "_at")
    edges = docs.select(F.explode("edges").alias("e")).select("e.*")
    roots = docs.select(F.explode("effect_roots").alias("r")).select("r.*")
    return (
        last.withColumn("is_component", F.coalesce("is_component", F.lit(False))),
        edges.withColumn("resolution", F.coalesce("resolution", F.lit("call"))).withColumn("seam", F.coalesce("seam", F.lit(False))),
        roots,
    )


def read_bodies(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _documents(spark, paths, f"functions array<struct<{schemas.BODY}>>").select(F.explode("functions").alias("f")).select("f.*")


def read_signatures(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Signatures with their document's extractor; unsigned 64-bit shingles keep their bits as signed numbers."""
    wide = schemas.SIGNATURE.replace("shingles array<bigint>", "shingles array<decimal(20,0)>")
    docs = _documents(spark, paths, f"language string, extractor string, signatures array<struct<{wide}>>")
    rows = docs.select("extractor", F.explode("signatures").alias("s")).select("extractor", "s.*")
    half, whole = F.lit("9223372036854775808").cast("decimal(20,0)"), F.lit("18446744073709551616").cast("decimal(21,0)")
    signed = F.transform("shingles", lambda x: F.when(x >= half, x - whole).otherwise(x).cast("bigint"))
    empty = F.create_map().cast("map<string,string>")
    return rows.withColumn("shingles", signed).withColumn("features", F.coalesce("features", empty))


def read_api(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _documents(spark, paths, schemas.API_REPORT)


def read_graph(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(symbols, edges, files, file_edges) of graph documents."""
    node = "id:string,display:string,file:string,language:string,line_start:int,line_end:int,loc:int,external:boolean,fan_in:bigint,fan_out:bigint,is_leaf:boolean,effect_roots:array<string>,external_packages:array<string>,scc:string"
    edge = "`from`:string,`to`:string,kind:string,resolution:string,provenance:string,evidence_file:string,evidence_line:int"
    file = "path:string,symbol_count:bigint,loc:bigint,fan_in:bigint,effect_roots:array<string>,external_packages:array<string>"
    docs = _documents(spark, paths, f"symbols array<struct<{node}>>, edges array<struct<{edge}>>, files array<struct<{file}>>, file_edges array<struct<`from`:string,`to`:string,call_edge_count:bigint,has_unknown:boolean>>")
    one = lambda c: docs.select(F.explode(c).alias("x")).select("x.*")
    return one("symbols"), one("edges").withColumnsRenamed({"from": "caller", "to": "callee"}), one("files"), one("file_edges")


def read_plan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Plan groups."""
    group = "id:string,reason:string,files:array<string>,loc:bigint,symbol_count:bigint,wave:int,depends_on:array<string>,unlocks:array<string>,external_packages:array<string>,effect_roots:array<string>,has_unknown_edges:boolean"
    return _documents(spark, paths, f"groups array<struct<{group}>>").select(F.explode("groups").alias("g")).select("g.*")


def read_native(spark: SparkSession, path: str, package: str) -> DataFrame:
    """Files (path) that a conformance manifest calls native for a package."""
    docs = _documents(spark, path, "modules array<struct<package:string,src:string,status:string>>")
    rows = docs.select(F.explode("modules").alias("m")).select("m.*")
    return rows.filter((F.col("package") == package) & (F.col("status") == "native")).select(F.col("src").alias("file")).distinct()


def write_document(path: str | Path, version_key: str, **parts: DataFrame | object) -> None:
    """One JSON document with the given parts: tables as arrays of rows, other values as they are. For results that people read."""
    body: dict[str, object] = {version_key: 1}
    for name, part in parts.items():
        body[name] = [json.loads(r[0]) for r in part.select(F.to_json(F.struct("*"))).collect()] if isinstance(part, DataFrame) else part
    Path(path).write_text(json.dumps(body, indent=2, ensure_ascii=False) + "\n")


def write_rows(df: DataFrame, path: str) -> None:
    """Any number of rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def cached(spark: SparkSession, folder: str, name: str, build) -> DataFrame:  # noqa: ANN001
    """The Parquet table folder/name, built once."""
    path = f"{folder.rstrip('/')}/{name}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


