"""Vector index as a Parquet vector table (O-06, O-28, O-57, O-79).

* ``l2_topk``: exact k nearest vectors per question by Euclidean distance; blank question text →
  no result for that question. Questions go to the tasks in blocks of bounded bytes, each task
  keeps its k nearest, and only rows within a bound found beforehand are shuffled (``nearest.py``).
* ``update_index``: the conditional create / append / read decision of the index component. A
  rebuild writes a new folder and names it last, so it may read the index that it replaces and a
  killed one loses nothing; appends skip vector ids already present (anti join), so a retried
  append is harmless.

The stored approximate index (O-58) is in ``ivf.py``.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from kbspark.operators import versions
from kbspark.operators.nearest import blocks_of, nearest


def l2_topk(index: DataFrame, queries: DataFrame, k: int = 4, id_col: str = "vec_id", vec_col: str = "embedding",
            query_vec: str = "query_vector", query_text: str | None = "question") -> DataFrame:
    """(query_id, id, l2_distance, rank): the k nearest vectors of each question, ties by id (a
    number or a string). Vectors of another length than the question's, null ones and null ids match
    nothing."""
    q = queries
    if query_text:
        q = q.where(F.length(F.trim(F.col(query_text))) > 0)
    vectors = index.select(id_col, F.col(vec_col).cast("array<double>").alias("_v")).where(f"`{id_col}` IS NOT NULL")
    blocks = blocks_of(q, query_vec)
    if not blocks:
        return vectors.limit(0).crossJoin(q.select("query_id").limit(0)).select(
            "query_id", id_col, F.lit(0.0).alias("l2_distance"), F.lit(0).alias("rank"))
    return nearest(vectors, blocks, k, "l2", id_col).withColumnRenamed("distance", "l2_distance")


@dataclass
class IndexDecision:
    action: str  # "append", "read", "create"
    reason: str


def decide(exists: bool, force_rebuild: bool, has_data: bool, search_query: str | None,
           has_directory: bool = True) -> IndexDecision:
    """The decision table (O-79)."""
    if not has_directory:
        raise ValueError("persist directory is required")
    if exists and not force_rebuild:
        if has_data and not (search_query or "").strip():
            return IndexDecision("append", "existing index, new data, no search query")
        return IndexDecision("read", "existing index")
    if not has_data:
        raise ValueError("no data provided for index creation")
    return IndexDecision("create", "missing index or rebuild requested")


def update_index(spark: SparkSession, directory: str | None, name: str, data: DataFrame | None,
                 search_query: str | None = None, force_rebuild: bool = False, id_col: str = "vec_id") -> DataFrame:
    """Create, append to or read the vector table ``directory/name`` and return its contents."""
    base = os.path.join(directory or "", name)
    folder = versions.current(spark, base) if directory else None
    d = decide(folder is not None, force_rebuild, data is not None, search_query, has_directory=bool(directory))
    if d.action == "create":
        folder = versions.replace(data, base)
    elif d.action == "append":
        current = spark.read.parquet(folder).select(id_col)
        data.join(current, id_col, "left_anti").write.mode("append").parquet(folder)
    return spark.read.parquet(folder)
