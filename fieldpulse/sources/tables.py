"""Reading the raw input tables.

One parquet file (or folder) per table under a base directory. Reads are lazy
and schema-on-read from the parquet footer; column pruning and filter pushdown
reach the scan because every operator downstream is declarative.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table_path(base_dir: str, name: str) -> str:
    return os.path.join(base_dir, f"{name}.parquet")


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(base_dir, name))


class RawTables:
    """Lazy accessor: ``RawTables(spark, dir).orders`` is a DataFrame (resolved once)."""

    def __init__(self, spark: SparkSession, base_dir: str):
        self.spark = spark
        self.base_dir = base_dir
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW_TABLES:
            if name not in self._frames:
                self._frames[name] = read_table(self.spark, self.base_dir, name)
            return self._frames[name]
        raise AttributeError(name)

    def register_views(self, names: tuple[str, ...] = RAW_TABLES) -> None:
        for name in names:
            read_table(self.spark, self.base_dir, name).createOrReplaceTempView(name)
