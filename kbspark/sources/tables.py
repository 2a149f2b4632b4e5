"""Scans of the input tables (O-01)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def table_glob(sf_dir: str, name: str) -> str:
    """A glob that matches one table only, be it a single file or a folder of part files: a stream
    takes a glob of either form, but neither a plain file nor a name filter that part files fit."""
    return os.path.join(sf_dir, f"{name}.parque[t]")


def read_table(spark: SparkSession, sf_dir: str, name: str, schema=None) -> DataFrame:
    """Parquet scan of one input table.

    Callers select only the columns they use; Catalyst prunes the ``ReadSchema`` to them and
    pushes comparisons on plain columns into the scan as ``PushedFilters``.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(table_path(sf_dir, name))


def register_views(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> None:
    """Register the input tables as temp views for ``spark.sql`` users."""
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)
