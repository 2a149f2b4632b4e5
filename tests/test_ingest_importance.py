"""Batch ingestion equals streaming ingestion; importance checks against brute force."""

import os
import random
import uuid

from pyspark.sql import functions as F

from conftest import SF_SMALL
from kbspark.operators import importance as imp
from kbspark.plans import ingest
from kbspark.session import scratch_path
from kbspark.sources.tables import read_table
from kbspark.streaming.ingest_stream import run_ingest_stream

AS_OF = "2024-01-15 00:00:00"


def _table(spark, out, name, cols):
    rows = spark.read.parquet(os.path.join(out, name)).select(*cols).collect()
    return {tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in rows}


def test_batch_equals_stream(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    out_b = scratch_path(spark, "t-batch-" + uuid.uuid4().hex)
    out_s = scratch_path(spark, "t-stream-" + uuid.uuid4().hex)
    ingest.ingest_batch(ingest.requests_from_documents(docs), out_b, batch_id=0, as_of=AS_OF)
    run_ingest_stream(spark, SF_SMALL, out_s, as_of=AS_OF, file_glob="documents.parquet")
    for name, cols in [("documents", ["document_id", "request_id", "access_level", "is_approved"]),
                       ("chunks", ["chunk_id", "document_id", "chunk_idx", "chunk_text"]),
                       ("embeddings", ["embedding_id", "chunk_id", "subchunk_idx", "vector"]),
                       ("responses", ["request_id", "status", "error"])]:
        a, b = _table(spark, out_b, name, cols), _table(spark, out_s, name, cols)
        assert a == b and len(a) > 0, name


def test_rerun_of_a_batch_is_idempotent(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    out = scratch_path(spark, "t-rerun-" + uuid.uuid4().hex)
    req = ingest.requests_from_documents(docs)
    ingest.ingest_batch(req, out, batch_id=3, as_of=AS_OF)
    n1 = spark.read.parquet(os.path.join(out, "embeddings")).count()
    ingest.ingest_batch(req, out, batch_id=3, as_of=AS_OF)
    assert spark.read.parquet(os.path.join(out, "embeddings")).count() == n1


def test_public_requests_fail_and_others_succeed(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    v = ingest.validate(ingest.requests_from_documents(docs))
    bad = v.where(F.col("status") == "failed").select("access_level", "error").distinct().collect()
    assert {(r.access_level, r.error) for r in bad} == {("PUBLIC", ingest.ERR_PUBLIC_UNAPPROVED)}
    assert v.where((F.col("status") == "success") & F.col("document_uid").isNull()).count() == 0


def _jaccard(a, b, k=3):
    def sh(t):
        w = t.lower().split()
        return {" ".join(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))}
    x, y = sh(a), sh(b)
    return len(x & y) / len(x | y)


def test_importance_against_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    base = [" ".join(rnd.choice(vocab) for _ in range(200)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows.append((100, base[0]))                                   # exact copy
    words = base[1].split()
    words[50] = "changed"
    rows.append((101, " ".join(words)))                           # near copy of doc 1
    df = spark.createDataFrame(rows, "document_id long, text string")
    exact = {r.document_id: r.importance for r in imp.exact_importance(df).collect()}
    near = {r.document_id: r.importance_near for r in imp.near_importance(df).collect()}
    texts = dict(rows)
    for d in texts:  # brute force over all pairs of this small fixture
        copies = sum(1 for e in texts if e != d and texts[e].strip().lower() == texts[d].strip().lower())
        assert exact[d] == copies
        similar = sum(1 for e in texts if e != d and _jaccard(texts[d], texts[e]) >= 0.9)
        assert near[d] >= copies
        assert (near[d] > 0) == (similar > 0)


def test_dialog_stream_state_across_epochs(spark):
    from kbspark.operators import dialog
    from kbspark.streaming.dialog_stream import latest_histories, run_dialog_stream
    conv = read_table(spark, SF_SMALL, "conversations").select("conv_id", "turn", "role", "text")
    landing = scratch_path(spark, "t-dialog-land-" + uuid.uuid4().hex)
    conv.where("turn < 3").coalesce(1).write.parquet(os.path.join(landing, "part=a"))
    conv.where("turn >= 3").coalesce(1).write.parquet(os.path.join(landing, "part=b"))
    out = scratch_path(spark, "t-dialog-out-" + uuid.uuid4().hex)
    run_dialog_stream(spark, landing + "/*", out, max_files_per_trigger=1)
    assert spark.read.parquet(out).select("epoch").distinct().count() >= 2
    got = {tuple(r) for r in latest_histories(spark, out, limit=4).select("conv_id", "n_turns", "history").collect()}
    want = {tuple(r) for r in dialog.dialog_history(conv, limit=4).select("conv_id", "n_turns", "history").collect()}
    assert got == want


def test_memory_log_only_grows(spark):
    """Each turn is appended once: later epochs, repeated turns and another stream rewrite nothing."""
    from kbspark.streaming.dialog_stream import latest_histories, memory_log, run_dialog_stream
    landing, out = (scratch_path(spark, f"t-log-{n}-" + uuid.uuid4().hex) for n in ("in", "out"))
    ckpt = scratch_path(spark, "t-log-ckpt-" + uuid.uuid4().hex)
    schema = "conv_id long, turn long, role string, text string"
    for epoch in range(3):
        rows = [(1, t, "user", f"e{epoch}") for t in range(epoch * 40, epoch * 40 + 50)] + [(2, epoch, "user", None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        run_dialog_stream(spark, landing, out, checkpoint=ckpt)
    log = spark.read.parquet(out)
    assert log.count() == 133 == log.select("conv_id", "turn").distinct().count()
    assert log.where("conv_id = 1").groupBy("text").count().orderBy("text").collect() == [("e0", 50), ("e1", 40), ("e2", 40)]
    run_dialog_stream(spark, landing, out, checkpoint=scratch_path(spark, "t-log-other-" + uuid.uuid4().hex))
    assert spark.read.parquet(out).count() == 266 and memory_log(spark, out).count() == 133
    assert {r.conv_id: r.n_turns for r in latest_histories(spark, out).collect()} == {1: 130, 2: 3}
