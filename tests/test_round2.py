"""Numbering at size, strict replies, and other cases that small tables hide."""

import random
import uuid

import numpy as np
from pyspark.sql import functions as F, types as T

from kbspark import schema as S
from kbspark.functions.text import render_template
from kbspark.operators import dialog, embed as emb, facts, groupconcat, index as idx, mixing as mx, nearest
from kbspark.operators.joins import row_blocks
from kbspark.plans import ingest, queries as plans
from kbspark.session import scratch_path
from kbspark.streaming.dialog_stream import latest_histories, run_dialog_stream
from kbspark.streaming.ingest_stream import run_ingest_stream


def test_numbering_over_many_range_partitions(spark):
    rows = spark.range(100_000, numPartitions=7).select(
        F.pmod(F.xxhash64("id"), F.lit(500)).alias("k"), F.col("id"), F.repeat(F.lit("x"), 50).alias("payload"))
    g = mx.local_index(rows, "k", "id").groupBy("k").agg(
        F.min("local_index").alias("lo"), F.max("local_index").alias("hi"), F.count_distinct("local_index").alias("n"), F.count("*").alias("rows"))
    assert g.where("lo <> 0 OR hi <> n - 1 OR n <> rows").isEmpty()
    assert g.agg(F.sum("rows")).first()[0] == 100_000
    n = mx.with_neighbours(rows, "k", "id", ["id"])
    assert n.where("next_id IS NOT NULL").count() == 100_000 - 500 == n.where("prev_id IS NOT NULL").count()


REPLIES = [
    ('{"answer":"a"} and {"answer":"b"}', False), ("{'answer': 'a'}", False), ('{"answer":"a"} }', False),
    ('{"answer":"a","new_facts":"oops"}', False), ('{"answer":"a","new_facts":null}', False), ('{"answer":"a","new_facts":["x"]}', False),
    ('so: {"answer":"a","new_facts":[]}!', True), ('{"answer":"a"}', True), ("{}", True), ("", False), (None, False), ("no", False),
    ('{"new_facts":[{"fact":"f","certainty":"HIGH"}]}', True), ('{"new_facts":[{"fact":"f"}]}', False),
    ('{"new_facts":[{"fact":"f","certainty":"sure"}]}', False), ('{"updated_facts":[{"id":1,"fact":"g","certainty":"low"}]}', True)]


def test_strict_replies_agree(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REPLIES)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", facts.parse_reply(F.col("t")).alias("p")).collect()}
    for i, (text, valid) in enumerate(REPLIES):
        assert got[i].valid == valid, text
        py = facts.parse_reply_py(text)
        assert (py["answer"], py["can_answer"], len(py["new_facts"]), len(py["updated_facts"])) == \
            (got[i].answer, got[i].can_answer, len(got[i].new_facts), len(got[i].updated_facts)), text


def test_folds_agree_on_numeric_ids(spark):
    rnd = random.Random(3)
    rows = []
    for q in range(20):
        for rank in range(4):
            new = [{"fact": f"f{rank}{j}", "certainty": rnd.choice(["high", "contradicts"])} for j in range(2)]
            upd = [{"id": rnd.choice([1, "2", 3, "", None]), "fact": rnd.choice(["g", ""]), "certainty": rnd.choice(["low", "contradicts"])}]
            import json
            rows.append((q, rank, json.dumps({"answer": f"a{rank}", "new_facts": new, "updated_facts": upd})))
    df = spark.createDataFrame(rows, "query_id long, doc_rank int, reply_text string")
    rel = facts.fold_facts(df.withColumn("reply", facts.parse_reply(F.col("reply_text"))))
    seq = facts.fold_facts_sequential(df.select("*", F.lit("q").alias("question"), F.lit("[]").alias("context_json"), F.lit("").alias("dialog_history")),
                                      lambda request, row: row["reply_text"])
    key = lambda d: sorted((r.query_id, r.fact_id, r.fact, r.certainty, r.reasoning) for r in d.collect() if r.fact_id)
    assert key(rel) == key(seq) and key(rel)


def test_long_conversations_keep_every_turn(spark):
    df = spark.range(60).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    assert dialog.dialog_history(df).first().history.count("\n") == 59
    c = dialog.compact_history(df).first()
    assert (c.n_recent, c.n_old) == (10, 50) and "t0 " in c.history.split("\n")[0]


def test_values_with_braces_and_empty_groups(spark):
    df = spark.createDataFrame([("see {question}", "why")], "document string, question string")
    out = df.select(render_template("{document} | {question}", {"document": F.col("document"), "question": F.col("question")}).alias("t")).first().t
    assert out == "see {question} | why"


def test_row_blocks_cover_all_rows(spark):
    df = spark.range(1000)
    blocks = row_blocks(df, "id", 100)
    assert len(blocks) > 1 and sum(b.count() for b in blocks) == 1000
    assert len(row_blocks(df, "id", 1000)) == 1


def test_nearest_vectors_against_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    vecs = [[float(rnd.randrange(4)) for _ in range(3)] for _ in range(300)]   # many ties
    rows = [(i, v) for i, v in enumerate(vecs)] + [(300, None), (301, [1.0]), (None, vecs[0])]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    asked = [(q, [float(rnd.randrange(4)) for _ in range(3)], "?") for q in range(30)] + [(30, None, "?"), (31, [1.0, 1.0, 1.0], " "), (32, [2.0], "?")]
    questions = spark.createDataFrame(asked, "query_id long, query_vector array<float>, question string")
    want = {(q, n + 1, i) for q, v, _ in asked[:30]
            for n, (_, i) in enumerate(sorted((sum((a - b) ** 2 for a, b in zip(x, v)), i) for i, x in enumerate(vecs))[:4])} | {(32, 1, 301)}
    names = index.withColumn("vec_id", F.lpad(F.col("vec_id").cast("string"), 5, "0"))
    for bound, vectors, number in ((1 << 20, index, int), (7 * 8 * 3, index, int), (1 << 20, names, int)):
        monkeypatch.setattr(nearest, "BLOCK_BYTES", bound)
        got = {(r.query_id, r["rank"], number(r.vec_id)) for r in idx.l2_topk(vectors, questions, 4).collect()}
        assert got == want
    assert idx.l2_topk(index.limit(0), questions).count() == 0 and idx.l2_topk(index, questions.limit(0)).count() == 0


def test_failing_texts_are_rows(spark):
    def model():
        def encode(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no vector for this")
            return [[1.0, 2.0]] * len(texts)
        return encode
    chunks = spark.createDataFrame([("c1", "d", 0, "a good text"), ("c2", "d", 1, "a bad text"), ("c3", "d", 2, "another")],
                                   "chunk_id string, document_id string, chunk_idx int, chunk_text string").coalesce(1)
    made = ingest.build_embeddings(chunks, emb.isolated_embedding(model, 2), 2, as_of="2024-01-01")
    assert {(r.chunk_id, r.status, r.attempts, r.error_message, tuple(r.vector or ())) for r in made.collect()} == {
        ("c1", "COMPLETED", 0, None, (1.0, 2.0)), ("c2", "FAILED", 3, "RuntimeError: no vector for this", ()), ("c3", "COMPLETED", 0, None, (1.0, 2.0))}
    short = ingest.build_embeddings(chunks, emb.isolated_embedding(model, 3), 3, as_of="2024-01-01")
    assert short.where("status = 'FAILED' AND vector IS NULL").count() == 3


def test_streams_and_batches_share_a_folder(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    out = scratch_path(spark, "t-shared-" + uuid.uuid4().hex)
    for n in range(2):
        landing = scratch_path(spark, "t-landing-" + uuid.uuid4().hex)
        docs.where(F.col("doc_id") == n).write.parquet(landing)
        ckpt = scratch_path(spark, "t-ckpt-" + uuid.uuid4().hex)
        for _ in range(2):   # a restart finds nothing new
            run_ingest_stream(spark, landing, out, checkpoint=ckpt)
    for _ in range(2):
        ingest.ingest_batch(ingest.requests_from_documents(docs.where("doc_id >= 2")), out, batch_id=0)
    got = [r.request_id for r in spark.read.parquet(out + "/responses").collect()]
    assert sorted(got) == [0, 1, 2, 3]


def test_dialog_stream_keeps_long_conversations_whole(spark):
    conv = spark.createDataFrame([(c, t, "user", f"t{t}") for c in range(3) for t in range(26 + c)], "conv_id long, turn long, role string, text string")
    landing, out = scratch_path(spark, "t-long-" + uuid.uuid4().hex), scratch_path(spark, "t-long-out-" + uuid.uuid4().hex)
    conv.write.parquet(landing)
    run_dialog_stream(spark, landing, out)
    want = {tuple(r) for r in dialog.dialog_history(conv).select("conv_id", "n_turns", "history").collect()}
    assert {tuple(r) for r in latest_histories(spark, out).select("conv_id", "n_turns", "history").collect()} == want


def test_conform_rejects_names_what_is_lost(spark):
    old = spark.createDataFrame([("1", "7", "x"), ("2", "seven", "y"), (None, "8", "z")], "chunk_id string, document_id string, chunk_text string")
    target = T.StructType([T.StructField("chunk_id", T.LongType(), False), T.StructField("document_id", T.LongType()), T.StructField("body", T.StringType())])
    got = {r.chunk_text: r.bad_columns for r in S.conform_rejects(old, target, renames={"body": "chunk_text"}).collect()}
    assert got == {"y": ["document_id"], "z": ["chunk_id"]}
    assert S.conform_rejects(old.limit(0), target).count() == 0


def test_registered_ivf_query_recalls_nine_tenths(spark):
    """vector_ivf_topk as registered against brute force, at its own k."""
    from conftest import SF_MID
    kb = plans.KB(spark, SF_MID)
    e = kb.table("embeddings").select("vec_id", "embedding").orderBy("vec_id").collect()
    q = kb.questions.select("query_id", "query_vector").orderBy("query_id").collect()

    def units(rows):
        v = np.array(rows, float)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    d = np.round(1 - units([r.query_vector for r in q]) @ units([r.embedding for r in e]).T, 9)
    ids = np.array([r.vec_id for r in e])
    true = {r.query_id: set(ids[np.lexsort((ids, x))[:plans.TOP_K]].tolist()) for r, x in zip(q, d, strict=True)}
    got = {}
    for r in plans.queries()["vector_ivf_topk"](spark, SF_MID).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    share = [len(true[i] & got.get(i, set())) / plans.TOP_K for i in true]
    assert np.mean(share) >= 0.9


def test_vector_dimension_and_nested_values_in_conformance(spark):
    wide = [0.5] * 768
    old = spark.createDataFrame([(1, wide, ["1", "x"]), (2, wide[:384], ["1", "2"]), (3, None, None), (4, wide[:384], [None])],
                                "embedding_id long, vector array<double>, tags array<string>")
    target = T.StructType([T.StructField("embedding_id", T.LongType(), False), T.StructField("vector", S.VECTOR, False, {"dim": 384}),
                           T.StructField("tags", T.ArrayType(T.IntegerType()))])
    rows = {r.embedding_id: r for r in S.conform(old, target).collect()}
    assert rows[1].vector is None and rows[1].tags == [1, None] and len(rows[2].vector) == 384 and rows[3].vector is None
    assert {r.embedding_id: r.bad_columns for r in S.conform_rejects(old, target).collect()} == {1: ["vector", "tags"], 3: ["vector"]}
    assert {r.embedding_id for r in S.conform_rejects(old, S.with_dimension(target, 768)).collect()} == {1, 2, 3, 4}
    assert S.EMBEDDINGS["vector"].metadata["dim"] == 384
