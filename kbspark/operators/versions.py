"""Versioned folders: a table is replaced by writing a new folder and then naming it.

``base/pointer`` is an append-only table of (seq, folder); the reader takes the row of greatest seq.
A new version is written whole under ``base/v-<id>`` before its pointer row is appended, so a job
killed at any point leaves the last named version as it was, and a version may be computed from
the one that it replaces.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_POINTER = "seq long, folder string"


def current(spark: SparkSession, base: str) -> str | None:
    """The folder of the newest named version, if there is one."""
    try:
        row = spark.read.schema(_POINTER).parquet(f"{base}/pointer").orderBy(F.desc("seq"), F.desc("folder")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return f"{base}/{row.folder}" if row else None


def new_folder(base: str) -> str:
    return f"{base}/v-{uuid.uuid4().hex}"


def name(spark: SparkSession, base: str, folder: str) -> None:
    """Make ``folder`` (under ``base``, wholly written) the current version."""
    last = 0
    if current(spark, base):
        last = spark.read.schema(_POINTER).parquet(f"{base}/pointer").agg(F.max("seq")).first()[0]
    spark.createDataFrame([(last + 1, folder[len(base) + 1:])], _POINTER).coalesce(1).write.mode("append").parquet(f"{base}/pointer")


def replace(df: DataFrame, base: str) -> str:
    folder = new_folder(base)
    df.write.parquet(folder)
    name(df.sparkSession, base, folder)
    return folder
