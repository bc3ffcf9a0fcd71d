"""Intermediate tables in the folder all executors share.

A staged table cuts lineage and survives the loss of any executor: it is an ordinary Parquet table under the folder that
``spark.checkpoint.dir`` names. Only in local mode, where all tasks share one machine, is a temporary folder made if that
setting is missing; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Folders written by this process, for clear_staged().
_written: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted by clear_staged()."""
    folder = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    _written[folder] = spark
    return f"{folder}/{name}"


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df once and return a scan of what was written."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_in = path.rpartition("/")[0]  # for unstage()
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    _written.pop(folder, None)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        if folder := getattr(t, "_staged_in", None):
            _delete(t.sparkSession, folder)


def clear_staged(spark: SparkSession) -> None:
    """Delete all that this process has staged in the session; to be called when no result is read any more."""
    for folder in [f for f, s in _written.items() if s is spark]:
        _delete(spark, folder)
