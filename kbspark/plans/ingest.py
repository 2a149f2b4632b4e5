"""Document ingestion job (O-02, O-03, O-07, O-09, O-49, O-70, O-71, O-83, O-89, O-90).

requests → validate (per-row error isolation) → sentence chunks → token sub-chunks → vectors
→ three tables. The whole chain is narrow (``posexplode`` per row), so the only cost centres
are the text functions and the embedder, and a long document lives in one task only.

Ids are hashes of natural keys (request id, chunk index, sub-chunk index) and every table is
written partitioned by ``batch_id`` with dynamic partition overwrite: re-running a batch (a
retried job, a replayed stream epoch) replaces exactly that batch, never duplicates it.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, functions as F, types as T

from kbspark import schema as S
from kbspark.operators import chunking
from kbspark.operators.chunking import stable_id
from kbspark.operators.embed import DEFAULT_DIM, DEFAULT_MODEL_NAME, embed

# ---------------------------------------------------------------------------------------------
# Error texts of rejected requests and the scopes recorded with chunks/vectors.
# ---------------------------------------------------------------------------------------------
ERR_PUBLIC_UNAPPROVED = "Public documents must be approved"
ERR_TITLE_MISSING = "title is required"
ERR_TITLE_TOO_LONG = "title is longer than 512 characters"
ERR_SOURCE_TYPE = "unknown source type"
ERR_ACCESS_LEVEL = "unknown access level"
CHUNK_SCOPE = "sentence"
EMBEDDING_SCOPE = "sentence"
# ---------------------------------------------------------------------------------------------


def validate(requests: DataFrame) -> DataFrame:
    """Adds is_approved (= access_level is RESTRICTED), status ('success' / 'failed'), error and
    document_id (NULL for failed rows). The first failing rule wins."""
    lvl, title = F.col("access_level"), F.col("title")
    approved = lvl == "RESTRICTED"
    error: Column = (F.when(~F.coalesce(lvl.isin(*S.ACCESS_LEVELS), F.lit(False)), F.lit(ERR_ACCESS_LEVEL))
                     .when((lvl == "PUBLIC") & ~approved, F.lit(ERR_PUBLIC_UNAPPROVED))
                     .when(title.isNull() | (F.trim(title) == ""), F.lit(ERR_TITLE_MISSING))
                     .when(F.length(title) > S.TITLE_MAX, F.lit(ERR_TITLE_TOO_LONG))
                     .when(~F.coalesce(F.col("source_type").isin(*S.SOURCE_TYPES), F.lit(False)), F.lit(ERR_SOURCE_TYPE)))
    return (requests.withColumn("is_approved", approved).withColumn("error", error)
            .withColumn("status", F.when(F.col("error").isNull(), F.lit("success")).otherwise(F.lit("failed")))
            .withColumn("document_uid", F.when(F.col("error").isNull(), stable_id("request_id"))))


def build(requests: DataFrame, as_of: str | None = None):
    """(responses, documents, chunks) DataFrames for one batch of requests
    (request_id, text, title, source_type, access_level, company_id, owner_id)."""
    v = validate(requests)
    stamp = _stamp(as_of)
    responses = v.select("request_id", "document_uid", "title", "status", "error")
    ok = v.where(F.col("status") == "success")
    documents = ok.select(F.col("document_uid").alias("document_id"), "request_id", "company_id", "owner_id",
                          "source_type", "title", "access_level", F.lit(False).alias("is_hot"), "is_approved",
                          stamp.alias("created_at"), stamp.alias("updated_at"))
    ch = chunking.sentence_chunks(ok.select(F.col("document_uid").alias("document_id"), "text"))
    chunks = ch.select(stable_id("document_id", "chunk_idx").alias("chunk_id"), "document_id", "chunk_idx",
                       "chunk_text", F.lit(CHUNK_SCOPE).alias("chunk_scope"), F.lit(False).alias("is_hot"),
                       "overlap", stamp.alias("created_at"))
    return responses, documents, chunks


def _stamp(as_of: str | None) -> Column:
    return F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()


def build_embeddings(chunks: DataFrame, model=DEFAULT_MODEL_NAME, dim: int = DEFAULT_DIM,
                     as_of: str | None = None) -> DataFrame:
    """Token windows of the chunks and their vectors. A window that the model cannot embed
    (``embed.isolated_embedding``) is a FAILED row with its attempts and error and no vector."""
    sub = chunking.token_subchunks(chunks, key_cols=("chunk_id", "document_id", "chunk_idx"))
    model_name = model if isinstance(model, str) else getattr(model, "__name__", "user-model")
    made = sub.withColumn("_made", embed(F.col("subchunk_text"), model, dim))
    if isinstance(made.schema["_made"].dataType, T.StructType):
        vector, attempts, error = (F.col(f"_made.{c}") for c in ("vector", "attempts", "error_message"))
    else:
        vector, attempts, error = F.col("_made"), F.lit(0), F.lit(None).cast("string")
    return made.select(
        stable_id("document_id", "chunk_idx", "subchunk_idx").alias("embedding_id"), "chunk_id", "subchunk_idx",
        vector.alias("vector"), F.lit(EMBEDDING_SCOPE).alias("embedding_scope"),
        F.lit(model_name).alias("embedding_model"), F.lit(chunking.SUBCHUNK_OVERLAP_TOKENS).alias("overlap"),
        F.when(error.isNull(), F.lit("COMPLETED")).otherwise(F.lit("FAILED")).alias("status"),
        attempts.alias("attempts"), error.alias("error_message"),
        _stamp(as_of).alias("created_at"))


def write_batch(tables: dict[str, DataFrame], out_dir: str, batch_id: int | str) -> None:
    """Write each table under ``out_dir/<name>`` partition ``batch_id``, replacing that
    partition only (dynamic partition overwrite)."""
    for name, df in tables.items():
        (df.withColumn("batch_id", F.lit(str(batch_id)))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(os.path.join(out_dir, name)))


def ingest_batch(requests: DataFrame, out_dir: str, batch_id: int | str, model=DEFAULT_MODEL_NAME,
                 dim: int = DEFAULT_DIM, as_of: str | None = None) -> None:
    """Write one batch. Chunks are written first and the vectors are built from the written
    chunk rows, so sentence splitting runs once per document and the vector stage restarts
    from files, not from the raw text, if it is retried."""
    responses, documents, chunks = build(requests, as_of)
    write_batch({"responses": responses, "documents": documents, "chunks": chunks}, out_dir, batch_id)
    spark = requests.sparkSession
    schema = T.StructType([*chunks.schema.fields, T.StructField("batch_id", T.StringType())])
    written = (spark.read.schema(schema).parquet(os.path.join(out_dir, "chunks"))
               .where(F.col("batch_id") == str(batch_id)).drop("batch_id"))
    write_batch({"embeddings": build_embeddings(written, model, dim, as_of)}, out_dir, batch_id)


def ingest_summary(spark, out_dir: str) -> DataFrame:
    """Per ingested document: number of chunks and vectors written (all batches)."""
    docs = spark.read.parquet(os.path.join(out_dir, "documents")).select("document_id", "request_id")
    ch = spark.read.parquet(os.path.join(out_dir, "chunks")).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_chunks"))
    em = (spark.read.parquet(os.path.join(out_dir, "embeddings")).select("chunk_id")
          .join(spark.read.parquet(os.path.join(out_dir, "chunks")).select("chunk_id", "document_id"), "chunk_id")
          .groupBy("document_id").agg(F.count(F.lit(1)).alias("n_vectors")))
    return (docs.join(ch, "document_id", "left").join(em, "document_id", "left")
            .select(F.col("request_id").alias("doc_id"), F.coalesce(F.col("n_chunks"), F.lit(0)).alias("n_chunks"),
                    F.coalesce(F.col("n_vectors"), F.lit(0)).alias("n_vectors")))


def requests_from_documents(docs: DataFrame) -> DataFrame:
    """Driver ``documents`` rows as ingest requests (ids and labels derived from doc_id)."""
    d = F.col("doc_id")
    return docs.select(
        d.alias("request_id"), "text", F.concat(F.lit("doc "), d.cast("string")).alias("title"),
        F.element_at(F.array(*[F.lit(x) for x in S.SOURCE_TYPES]), (d % 5 + 1).cast("int")).alias("source_type"),
        F.element_at(F.array(F.lit("PUBLIC"), F.lit("INTERNAL"), F.lit("RESTRICTED")), (d % 3 + 1).cast("int"))
        .alias("access_level"),
        (d % 7).alias("company_id"), F.when(d % 11 == 0, F.lit(None).cast("bigint")).otherwise(d % 50).alias("owner_id"))
