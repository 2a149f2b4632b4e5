"""Incremental ingestion with Structured Streaming (O-02, O-03 streaming form).

New request files landing in a folder are picked up by ``readStream``; each micro-batch runs
the same batch job (``plans.ingest.ingest_batch``) through ``foreachBatch`` with stream id and
epoch as ``batch_id``, so several streams and batch jobs may share a folder. Because the batch job overwrites exactly its own ``batch_id`` partition, a
replayed epoch after a failure rewrites the same rows — the sink is idempotent and the result
equals the batch job's. ``trigger(availableNow=True)`` drains what is there and stops.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, types as T

from kbspark.plans import ingest
from kbspark.session import checkpoint_dir
from kbspark.streaming.drain import drain

DOCUMENTS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def run_ingest_stream(spark: SparkSession, landing: str, out_dir: str, checkpoint: str | None = None,
                      max_files_per_trigger: int | None = None, as_of: str | None = None,
                      file_glob: str | None = None) -> None:
    """Drain the request files under the folder ``landing`` (optionally only names matching
    ``file_glob``) into the ingest tables under ``out_dir``."""
    reader = spark.readStream.schema(DOCUMENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    stream = reader.parquet(landing)

    def each(batch: DataFrame, stream_id: str, epoch: int) -> None:
        ingest.ingest_batch(ingest.requests_from_documents(batch), out_dir, f"{stream_id}-{epoch}", as_of=as_of)

    ckpt = checkpoint or os.path.join(checkpoint_dir(spark), "ingest-stream-" + os.path.basename(out_dir.rstrip("/")))
    drain(stream.writeStream.option("checkpointLocation", ckpt), each)
