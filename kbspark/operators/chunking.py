"""Document → sentence chunks → token sub-chunks (O-10, O-27, O-51, O-52, O-63, O-71, O-72, O-95).

Everything here is narrow: one input row explodes into its chunks with ``posexplode`` and
each chunk into its sub-chunks, so no shuffle happens and a long document only ever lives in
the task that reads it. Ids are content-independent hashes of the natural key
(document id, chunk index, sub-chunk index), so re-running a job yields the same ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from kbspark.functions import text as tx

CHUNK_SIZE_SENTENCES = 5
CHUNK_OVERLAP_SENTENCES = 2
MAX_EMBEDDING_TOKENS = 256
SPECIAL_TOKENS = 2
SUBCHUNK_OVERLAP_TOKENS = 32


def stable_id(*parts) -> Column:
    """Deterministic, retry-safe id: sha-256 of the '|'-joined natural key (O-71)."""
    return F.sha2(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]), 256)


def sentence_chunks(docs: DataFrame, text_col: str = "text", id_col: str = "document_id",
                    size: int = CHUNK_SIZE_SENTENCES, overlap: int = CHUNK_OVERLAP_SENTENCES,
                    splitter: Callable[[Column], Column] = tx.split_sentences) -> DataFrame:
    """One row per chunk: (id_col, chunk_idx, n_sentences, chunk_text, overlap).

    ``splitter`` is the pluggable sentence splitter (Column → array<string>). A document with
    no sentences yields no chunk rows.
    """
    sents = splitter(F.col(text_col))
    exploded = docs.select(F.col(id_col), F.posexplode(tx.sentence_windows(sents, size, overlap))
                           .alias("chunk_idx", "sentences"))
    return exploded.select(
        id_col,
        F.col("chunk_idx").cast("bigint").alias("chunk_idx"),
        F.size("sentences").alias("n_sentences"),
        F.array_join("sentences", " ").alias("chunk_text"),
        F.lit(overlap).alias("overlap"),
    )


def token_subchunks(chunks: DataFrame, text_col: str = "chunk_text", key_cols=("document_id", "chunk_idx"),
                    max_tokens: int = MAX_EMBEDDING_TOKENS, special_tokens: int = SPECIAL_TOKENS,
                    overlap: int = SUBCHUNK_OVERLAP_TOKENS,
                    tokenizer: Callable[[Column], Column] = tx.token_units) -> DataFrame:
    """One row per non-blank token window of a chunk:
    (*key_cols, subchunk_idx, token_start, n_tokens, subchunk_text)."""
    if tokenizer is tx.token_units:
        wins = tx.token_windows_of_text(F.col(text_col), max_tokens, special_tokens, overlap)
    else:
        wins = tx.token_windows(tokenizer(F.col(text_col)), max_tokens, special_tokens, overlap)
    exploded = chunks.select(*key_cols, F.posexplode(wins).alias("subchunk_idx", "w"))
    return exploded.select(*key_cols,
                           F.col("subchunk_idx").cast("bigint").alias("subchunk_idx"),
                           F.col("w.token_start").alias("token_start"),
                           F.col("w.n_tokens").alias("n_tokens"),
                           F.col("w.text").alias("subchunk_text"))


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """The metadata record of a chunk: {document_id as text, is_hot, position = chunk_idx} (O-10)."""
    return chunks.select(
        stable_id("document_id", "chunk_idx").alias("chunk_uid"),
        F.col("document_id").cast("string").alias("document_id"),
        F.coalesce(F.col("is_hot"), F.lit(False)).alias("is_hot") if "is_hot" in chunks.columns
        else F.lit(False).alias("is_hot"),
        F.col("chunk_idx").alias("position"),
    )
