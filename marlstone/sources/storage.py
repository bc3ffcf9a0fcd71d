"""Tables at rest: by path or in the catalogue, always read in the format they were written in."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from marlstone.session import Config


def write_path(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read_path(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def write_table(df: DataFrame, name: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).saveAsTable(name)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def create_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{name}`")


def list_tables(spark: SparkSession, schema: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(schema))


def materialize(spark: SparkSession, name: str, make: Callable[[], DataFrame], refresh: bool = False, config: Config | None = None) -> DataFrame:
    """The stored table of that name; it is made and written first if it is missing, was not written to its end, or is to be refreshed."""
    config = config or Config()
    path = config.table(name)
    marks = {"delta": "_delta_log", "iceberg": "metadata"}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{marks.get(config.table_format, '_SUCCESS')}")
    there = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop)
    if refresh or not there:
        write_path(make(), path, config.table_format)
    return read_path(spark, path, config.table_format)


def union_all(*frames: DataFrame, allow_missing: bool = False) -> DataFrame:
    """All rows of all frames, columns matched by name, repeats kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)
