"""Per-document context assembly and request building (O-14, O-16, O-38, O-47, O-56, O-68).

Retrieved chunks are grouped by (question, document); documents keep the order in which
they first appear in the ranking (their best chunk's rank) and chunks inside a document are
ordered by ``chunk_idx``. Every group holds at most ``top_k`` chunks, so the ordered
``collect_list`` inside a group is bounded by the retrieval limit, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kbspark.functions.text import render_template

# ---------------------------------------------------------------------------------------------
# The task line of a per-document request.
# ---------------------------------------------------------------------------------------------
REQUEST_TASK = "Analyze document for relevant information"
# ---------------------------------------------------------------------------------------------


def context_by_document(chunks: DataFrame) -> DataFrame:
    """(query_id, document_id, doc_rank, n_chunks, chunks: array<struct<chunk_idx, chunk_id, chunk_text>>)."""
    per_doc = (chunks.groupBy("query_id", "document_id")
               .agg(F.min("chunk_rank").alias("_first"),
                    F.array_sort(F.collect_list(F.struct(
                        F.coalesce(F.col("chunk_idx"), F.lit(0)).alias("chunk_idx"),
                        F.col("chunk_id"), F.col("chunk_text")))).alias("chunks")))
    w = Window.partitionBy("query_id").orderBy("_first")
    return (per_doc.withColumn("doc_rank", F.row_number().over(w).cast("bigint"))
            .select("query_id", "document_id", "doc_rank", F.size("chunks").cast("bigint").alias("n_chunks"),
                    "chunks"))


def context_json(chunks_col: Column) -> Column:
    """``[{chunk_id, chunk_text}, …]`` as JSON (non-ASCII kept as is)."""
    return F.to_json(F.transform(chunks_col, lambda c: F.struct(c["chunk_id"].alias("chunk_id"),
                                                                 c["chunk_text"].alias("chunk_text"))))


def used_ids(context: DataFrame) -> DataFrame:
    """Per question: used documents in rank order, used chunk ids in document order then
    chunk order (O-47)."""
    rows = context.select("query_id", "doc_rank", "document_id", F.explode("chunks").alias("c"))
    return (rows.groupBy("query_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("doc_rank", "document_id"))),
                                          lambda x: x["document_id"].cast("string")), ",").alias("used_documents"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
                     "doc_rank", F.col("c.chunk_idx").alias("chunk_idx"), F.col("c.chunk_id").alias("chunk_id")))),
                     lambda x: x["chunk_id"].cast("string")), ",").alias("used_chunks")))


def request_json(question: Column, chunks_col: Column, previous_facts: Column, previous_answer: Column,
                 dialog_history: Column) -> Column:
    """The per-document request document (O-68)."""
    ctx = F.transform(chunks_col, lambda c: F.struct(c["chunk_id"].alias("chunk_id"),
                                                     c["chunk_text"].alias("chunk_text")))
    return F.to_json(F.struct(F.lit(REQUEST_TASK).alias("task"), question.alias("question"),
                              ctx.alias("document_context"), previous_facts.alias("previous_facts"),
                              previous_answer.alias("previous_answer"), dialog_history.alias("dialog_history")))


def render_prompt(template: str, **values: Column) -> Column:
    """Fill a prompt template's ``{name}`` placeholders from columns (O-16)."""
    return render_template(template, values)
