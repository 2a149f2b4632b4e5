"""Multi-vector chunk retrieval (O-12, O-21, O-22, O-29, O-30, O-32, O-35..O-37, O-50, O-55).

A whole table of questions in one job: COMPLETED vectors of the chunks that the asker may read →
cosine distance to the question → the ``top_k`` chunks per question by best distance (tie: chunk
id) → of these the average and count of the first ``subchunk_top_k`` vectors → blended score →
``score >= threshold`` applied *after* the top-k.

The top chunks are found by tasks that read each vector once and decide access per candidate
(``scoped.py``): neither (asker, document) nor (question, vector) rows exist. Only the questions ×
top_k winners meet their vectors again, by chunk id, for their statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kbspark.functions.vectors import DIST_DIGITS, dot, norm, unit
from kbspark.operators.joins import bounded_broadcast
from kbspark.operators.scoped import Scope, nearest_chunks
from kbspark.session import materialize


def prepare_vectors(embeddings: DataFrame, status: str | None = "COMPLETED", keep: DataFrame | None = None) -> DataFrame:
    """COMPLETED vectors (filter pushed into the scan), normalised once per row; with ``keep`` (chunk_id
    and more) those of its chunks, one row per row of ``keep`` and vector, with its columns."""
    e = embeddings
    if status is not None:
        e = e.where(F.col("status") == status)
    v = F.col("vector").cast("array<double>")
    more = []
    if keep is not None:
        more = [c for c in keep.columns if c != "chunk_id"]
        e = e.select("embedding_id", "chunk_id", "subchunk_idx", "vector").join(keep, "chunk_id")
    return e.select("embedding_id", "chunk_id", "subchunk_idx", unit(v).alias("_u"), (norm(v) > 0).alias("_nz"), *more)


def prepare_questions(questions: DataFrame, vector_col: str = "query_vector") -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    return questions.select("query_id", unit(v).alias("_q"), (norm(v) > 0).alias("_qnz"))


def _distance() -> F.Column:
    raw = F.when(F.col("_nz") & F.col("_qnz"), F.lit(1.0) - dot("_u", "_q")).otherwise(F.lit(1.0))
    return F.round(raw, DIST_DIGITS)


def pair_distances(pairs: DataFrame, questions: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(query_id, chunk_id, document_id, embedding_id, subchunk_idx, dist) of given (query_id, chunk_id) rows."""
    small = bounded_broadcast(pairs)   # else both tables would be shuffled to find a few rows
    places = chunks.select("chunk_id", "document_id").join(pairs if small is None else small, "chunk_id")
    if small is not None:
        found = materialize(places)
        small = bounded_broadcast(found)   # more rows than pairs only where chunk ids repeat
        places = found if small is None else small
    # the vectors of these chunks only are normalised
    d = prepare_vectors(embeddings, keep=places).join(prepare_questions(questions), "query_id")
    return d.select("query_id", "chunk_id", "document_id", "embedding_id", "subchunk_idx", _distance().alias("dist"))


def chunk_stats(dists: DataFrame, subchunk_top_k: int = 3) -> DataFrame:
    """Per (question, chunk): best distance, average and count over the ``subchunk_top_k``
    nearest vectors (rank ties broken by sub-chunk index, then vector id)."""
    w = Window.partitionBy("query_id", "chunk_id").orderBy("dist", "subchunk_idx", "embedding_id")
    ranked = dists.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= subchunk_top_k)
    return (ranked.groupBy("query_id", "chunk_id", "document_id")
            .agg(F.min("dist").alias("best_distance"),
                 F.round(F.avg("dist"), DIST_DIGITS).alias("avg_distance"),
                 F.count(F.lit(1)).alias("match_count")))


def blended_score(subchunk_top_k: int = 3) -> F.Column:
    """0.6·(1−best) + 0.3·(1−avg) + 0.1·(match_count / subchunk_top_k); avg falls back to best."""
    best = F.col("best_distance")
    avg = F.coalesce(F.col("avg_distance"), best)
    return F.round(F.lit(0.6) * (F.lit(1.0) - best) + F.lit(0.3) * (F.lit(1.0) - avg)
                   + F.lit(0.1) * (F.col("match_count") / F.lit(float(subchunk_top_k))), 6)


def top_chunks(stats: DataFrame, top_k: int = 20) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("best_distance", "chunk_id")
    return (stats.withColumn("chunk_rank", F.row_number().over(w))
            .where(F.col("chunk_rank") <= top_k))


def attach_chunk_details(top: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add chunk_idx and chunk_text to top-k rows. How many those are depends on the questions: they are
    written and counted, and as long as they can be broadcast no chunk text is shuffled."""
    top = materialize(top)
    small = bounded_broadcast(top)
    return chunks.select("chunk_id", "chunk_idx", "chunk_text").join(top if small is None else small, "chunk_id")


def top_stats(questions: DataFrame, chunks: DataFrame, embeddings: DataFrame, scope: Scope | None = None, top_k: int = 20,
              subchunk_top_k: int = 3) -> DataFrame:
    """The top chunks per question with their statistics and rank; among all chunks without a ``scope``."""
    ready = embeddings.where(F.col("status") == "COMPLETED")
    winners = materialize(nearest_chunks(questions, chunks, ready, scope, top_k))   # questions x top_k ids
    return top_chunks(chunk_stats(pair_distances(winners, questions, chunks, embeddings), subchunk_top_k), top_k)


def retrieve(questions: DataFrame, chunks: DataFrame, embeddings: DataFrame, scope: Scope | None = None, top_k: int = 20,
             subchunk_top_k: int = 3, score_threshold: float | None = None) -> DataFrame:
    """Top chunks per question with their blended score; threshold applied after the top-k."""
    scored = top_stats(questions, chunks, embeddings, scope, top_k, subchunk_top_k).withColumn("score", blended_score(subchunk_top_k))
    if score_threshold is not None:
        scored = scored.where(F.col("score") >= F.lit(score_threshold))
    return attach_chunk_details(scored, chunks)
