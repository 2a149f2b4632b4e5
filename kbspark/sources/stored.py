"""Derived tables kept for a session: written once, read by every query that needs them.

A knowledge base holds its chunks and vectors as tables; queries read them. ``stored`` writes such
a table under the shared scratch folder the first time it is asked for and gives its folder from
then on, as long as the files that it is made from are the same (names, sizes, modification times).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kbspark.session import scratch_path

_FOLDERS: dict[tuple, str] = {}


def files_mark(df: DataFrame) -> tuple:
    """Number and combined hash of the files that a scan reads."""
    m = "_metadata."
    files = df.select(m + "file_path", m + "file_size", m + "file_modification_time").distinct()
    return tuple(files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time"))).first())


def stored(spark: SparkSession, name: str, inputs: list[DataFrame], build: Callable[[str], None]) -> str:
    """The folder of table ``name`` made from ``inputs`` (plain scans); ``build`` writes it if need be."""
    key = (spark.sparkContext.applicationId, name, *[files_mark(df) for df in inputs])
    if key not in _FOLDERS:
        path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
        build(path)
        _FOLDERS[key] = path
    return _FOLDERS[key]
