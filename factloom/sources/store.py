"""The durable fact base: Parquet tables in one folder, one version per write.

Definitions are upserted by id (the newest row wins); edges, roots and summaries belong to a snapshot and replace the
earlier ones of the same snapshot, so loading a project again doesn't double its edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schemas
from factloom.storage import exists

ARROW = "->"


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _exists(self, name: str) -> bool:
        return exists(self.spark, self._path(name))

    def insert_facts(self, definitions: DataFrame, edges: DataFrame, roots: DataFrame, snapshot: str = "main", version: int | None = None) -> None:
        """version orders writes of definitions: of rows with one id the highest version counts. By default a write is newer than all before."""
        if version is None:
            version = self._newest() + 1
        definitions.withColumn("version", F.lit(version)).write.mode("append").parquet(self._path("definitions"))
        for name, df in (("edges", edges), ("roots", roots)):
            df.write.mode("overwrite").parquet(f"{self._path(name)}/snapshot={snapshot}")

    def _newest(self) -> int:
        if not self._exists("definitions"):
            return -1
        found = self.spark.read.schema("version int").parquet(self._path("definitions")).agg(F.max("version")).first()[0]
        return -1 if found is None else found

    def definitions(self) -> DataFrame:
        if not self._exists("definitions"):
            return self.spark.createDataFrame([], schemas.DEFINITIONS)
        rows = self.spark.read.schema(f"{schemas.DEFINITIONS}, version int").parquet(self._path("definitions"))
        own = [c for c in rows.columns if c not in ("id", "version")]
        return rows.groupBy("id").agg(F.max_by(F.struct(*own), "version").alias("d")).select("id", "d.*")

    def _snapshots(self, name: str, ddl: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(f"{ddl}, snapshot string").parquet(self._path(name)).drop("snapshot")

    def edges(self) -> DataFrame:
        return self._snapshots("edges", schemas.EDGES)

    def roots(self) -> DataFrame:
        return self._snapshots("roots", schemas.ROOTS)

    def load_facts(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.definitions(), self.edges(), self.roots()

    def write_summaries(self, summaries: DataFrame) -> None:
        """Replaces all summaries; a path is stored as text."""
        summaries.select("symbol", "effect", F.array_join("path", ARROW).alias("evidence_path")).write.mode("overwrite").parquet(self._path("summaries"))

    def summaries(self) -> DataFrame:
        rows = self.spark.read.schema(schemas.SUMMARIES).parquet(self._path("summaries"))
        empty = F.array().cast("array<string>")
        return rows.select("symbol", "effect", F.when(F.col("evidence_path") == "", empty).otherwise(F.split("evidence_path", ARROW)).alias("path"))
