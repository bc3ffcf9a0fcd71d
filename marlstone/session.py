"""Session, configuration and path handling."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Config:
    """Where raw files and tables live; every field can come from the environment."""

    raw_root: str = field(default_factory=lambda: os.environ.get("MARLSTONE_RAW", "data/raw"))
    table_root: str = field(default_factory=lambda: os.environ.get("MARLSTONE_TABLES", "data/tables"))
    table_format: str = field(default_factory=lambda: os.environ.get("MARLSTONE_FORMAT", "parquet"))

    def raw(self, name: str) -> str:
        return f"{self.raw_root.rstrip('/')}/{name}"

    def table(self, name: str) -> str:
        return f"{self.table_root.rstrip('/')}/{name}"


class Workspace:
    """A session with its paths. A session given from outside is used as it is and never stopped."""

    def __init__(self, spark: SparkSession | None = None, config: Config | None = None, app: str = "marlstone", **conf: str):
        self.config = config or Config()
        self._owned = spark is None and SparkSession.getActiveSession() is None
        if spark is None:
            builder = SparkSession.builder.appName(app)
            defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"}
            spark = builder.config(map=defaults | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
        self.spark = spark

    def path(self, name: str) -> str:
        return self.config.table(name)

    def close(self) -> None:
        if self._owned:
            self.spark.stop()

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def sample(self, name: str, n: int = 10_000, *order: str) -> DataFrame:
        """The first n rows of a stored table, by the given columns if there are any."""
        df = self.spark.read.format(self.config.table_format).load(self.path(name))
        return (df.orderBy(*order) if order else df).limit(n)
