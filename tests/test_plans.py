"""Plan regression tests: the physical plans keep the properties the design relies on."""

import contextlib
import io
import os
import uuid

from pyspark.sql import functions as F

from conftest import SF_SMALL
from kbspark.operators import retrieve as rt
from kbspark.plans.queries import KB
from kbspark.session import scratch_path


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_access_policy_has_no_products(spark):
    plan = _plan(KB(spark, SF_SMALL).list_access)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # documents are scanned without their text
    assert "ReadSchema: struct<doc_id:bigint,text" not in plan


def test_access_policies_shuffle_no_pairs(spark):
    kb = KB(spark, SF_SMALL)
    for policy in (kb.list_access, kb.point_access):
        tree = [line.strip(" +-:*") for line in _plan(policy).split("\n\n")[0].split("\n") if line.strip()]
        top = [line for line in tree if not line.startswith(("==", "AdaptiveSparkPlan"))][0]
        assert top.startswith("Union")                 # no distinct over the pairs


def _scoped_vectors(kb):
    """The rows that the search tasks of the first block read."""
    from kbspark.operators import scoped
    block = scoped.question_blocks(kb.questions)[0]
    ready = kb.embeddings.where("status = 'COMPLETED'").select("chunk_id", F.col("vector").cast("array<double>").alias("_v"))
    return ready.join(kb.chunks.select("chunk_id", "document_id").join(scoped._policies(kb.scope, block), "document_id"), "chunk_id")


def test_no_caller_document_rows_in_retrieval(spark):
    """What is exchanged before the search are documents, grants, chunks and vectors; callers and
    questions are broadcast, and no exchange holds a question or a user beside a document."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = _plan(_scoped_vectors(KB(spark, SF_SMALL)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    exchanges = [b for b in plan.split("\n\n") if ") Exchange" in b.split("\n")[0]]
    assert len(exchanges) >= 4
    for block in exchanges:
        assert not ("document_id" in block and "query_id" in block)
    assert sum("_v#" in b for b in exchanges) == 1     # vectors move once


def test_winners_alone_meet_their_vectors(spark):
    plan = _plan(KB(spark, SF_SMALL).retrieve(0.15))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Scan ExistingRDD" in plan


def test_status_filter_reaches_parquet_scan(spark):
    path = scratch_path(spark, "t-emb-" + uuid.uuid4().hex)
    (spark.range(0, 30).select(F.col("id").alias("embedding_id"), F.expr("id div 3").alias("chunk_id"),
                               (F.col("id") % 3).alias("subchunk_idx"),
                               F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("vector"),
                               F.when(F.col("id") % 10 == 9, "FAILED").otherwise("COMPLETED").alias("status"),
                               F.lit("x" * 50).alias("error_message"))
     .write.parquet(path))
    plan = _plan(rt.prepare_vectors(spark.read.parquet(path)))
    assert "EqualTo(status,COMPLETED)" in plan
    assert "error_message" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_ingest_chunks_stay_narrow(spark):
    from kbspark.operators import chunking
    docs = spark.read.parquet(os.path.join(SF_SMALL, "documents.parquet")).select(
        F.col("doc_id").alias("document_id"), "text")
    plan = _plan(chunking.token_subchunks(chunking.sentence_chunks(docs)))
    assert "Exchange" not in plan                      # chunking never shuffles


def test_workers_need_not_find_the_package(tmp_path):
    """A driver started elsewhere, with the repository on its own path alone: functions travel by value."""
    import subprocess
    import sys

    from conftest import ROOT
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from kbspark.session import get_session
from kbspark.plans.queries import queries
spark = get_session("local[2]", 2)
sys.path.remove({ROOT!r})
for name in ("gleu_pair", "vector_l2_topk", "fact_fold_model_loop", "importance_similar", "retrieve_topk"):
    print(name, queries()[name](spark, {SF_SMALL!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert len(out.stdout.strip().split("\n")) >= 5
