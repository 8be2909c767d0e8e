"""Where lineage is cut: tables in the folder that all executors share.

Iterative plans (fixpoints, components) must not recompute their whole history, and must survive the loss of an
executor.  Intermediate tables are therefore written to the folder the cluster names in ``spark.checkpoint.dir``.
Where that setting is absent, a session on one machine (``local`` masters: tests, bench) gets a temporary folder; any
other session gets an error, since a folder of the driver's machine isn't there for the executors.

An application writes below one folder of its own.  ``forget`` deletes a table that later ones replace (the rounds of a
loop), and ``forget_all`` the whole folder, which also happens when the driver's Python ends: a result is a lazy plan
over these tables, so they must live until it has been read.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_cleaned: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)  # Spark has no public call to delete a path of any file system
    at.getFileSystem(spark._jsparkSession.sparkContext().hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sparkContext().hadoopConfiguration()).exists(at)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the session's ``spark.checkpoint.dir`` (or a fresh local one in local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    own = f"{named.rstrip('/')}/factloom-{spark.conf.get('spark.app.id')}"
    if own not in _cleaned:
        _cleaned.add(own)
        atexit.register(_at_exit, spark, own)
    return own


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session is gone; nothing can be deleted any more
        pass


def shared_table(df: DataFrame, name: str = "t", **options: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and return a scan of it (short lineage, survives executors)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that shared_table() returned and that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t.shared_path)


def forget_all(spark: SparkSession) -> None:
    """Delete every table that this application wrote; results that haven't been read are lost."""
    _delete(spark, shared_dir(spark))
