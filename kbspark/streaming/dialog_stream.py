"""Dialog memory as a stream (O-80 / O-53, streaming form): an append-only log of turns.

Turns arrive as files. The state is the set of (conversation, turn) numbers that the memory has, one
small key per turn and none of its text (``dropDuplicates``), so a turn costs the same whether its
conversation has ten turns or a million, a long conversation is spread over all state partitions,
and nothing is ever rewritten: each epoch appends its new turns to the log, in a ``stream`` and
``epoch`` partition of its own with dynamic overwrite, so a replayed epoch rewrites the same rows
and another stream's rows stay. A turn number that comes again is the turn that is there already.
Histories are read from the log.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kbspark.operators.dialog import dialog_history
from kbspark.session import checkpoint_dir
from kbspark.streaming.drain import drain

CONVERSATION_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
])


def run_dialog_stream(spark: SparkSession, landing: str, out_dir: str, file_glob: str | None = None,
                      checkpoint: str | None = None, max_files_per_trigger: int | None = None) -> None:
    """Append the turns of all files that have arrived under ``landing`` to the log at ``out_dir``."""
    reader = spark.readStream.schema(CONVERSATION_SCHEMA)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    turns = reader.parquet(landing).dropDuplicates(["conv_id", "turn"])

    def sink(batch: DataFrame, stream_id: str, epoch: int) -> None:
        (batch.withColumn("stream", F.lit(stream_id)).withColumn("epoch", F.lit(epoch)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("stream", "epoch").parquet(out_dir))

    ckpt = checkpoint or os.path.join(checkpoint_dir(spark), "dialog-stream-" + os.path.basename(out_dir.rstrip("/")))
    drain(turns.writeStream.outputMode("append").option("checkpointLocation", ckpt), sink)


def memory_log(spark: SparkSession, out_dir: str) -> DataFrame:
    """(conv_id, turn, role, text): every turn once; of one that several streams appended, the earliest epoch's."""
    log = spark.read.parquet(out_dir)
    first = F.min_by(F.struct("role", "text"), F.struct("epoch", "stream"))
    return log.groupBy("conv_id", "turn").agg(first.alias("t")).select("conv_id", "turn", "t.role", "t.text")


def latest_histories(spark: SparkSession, out_dir: str, limit: int | None = None) -> DataFrame:
    """(conv_id, n_turns, history) of every conversation in the log, the newest ``limit`` turns if given."""
    return dialog_history(memory_log(spark, out_dir), limit)
