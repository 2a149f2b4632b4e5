"""Tables that are folders of part files, sessions without Arrow conversion."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from kbspark.functions.vectors import cosine_distance, l2_distance
from kbspark.operators import importance as imp, ivf, nearest as near, retrieve as rt
from kbspark.plans import queries as plans
from kbspark.sources.tables import read_table


def _in_parts(spark, tmp_path, name):
    read_table(spark, SF_SMALL, name).repartition(3).write.parquet(str(tmp_path / "sf" / f"{name}.parquet"))
    return str(tmp_path / "sf")


def test_dialog_stream_reads_a_table_of_part_files(spark, tmp_path):
    folder = _in_parts(spark, tmp_path, "conversations")
    got = sorted(map(tuple, plans.q_dialog_stream(spark, folder).collect()))
    assert got == sorted(map(tuple, plans.q_dialog_stream(spark, SF_SMALL).collect()))
    assert len(got) == read_table(spark, SF_SMALL, "conversations").select("conv_id").distinct().count()


def test_ingest_stream_reads_a_table_of_part_files(spark, tmp_path):
    folder = _in_parts(spark, tmp_path, "documents")
    got = sorted(map(str, plans.q_ingest_stream(spark, folder).collect()))
    assert got and got == sorted(map(str, plans.q_ingest_stream(spark, SF_SMALL).collect()))


def test_index_is_tuned_without_arrow_conversion(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8))
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    asked = rows.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = ivf.build_ivf(rows, str(tmp_path / "ivf"))
    on = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    try:
        assert 1 <= ivf.tune(index, asked, 5) <= index.n_cells
        assert ivf.search_ivf(ivf.open_ivf(spark, str(tmp_path / "ivf")), asked, 5).where("rank = 1 and query_id = vec_id").count() == 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", on)


def test_listed_distances_equal_the_column_functions(spark):
    vectors = spark.createDataFrame(
        [(1, 1, [3.0, 4.0]), (2, 1, [0.0, 0.0]), (3, 2, [1.0, None]), (4, 2, [1.0]), (5, 3, None), (6, 3, []), (6, 3, [0.5, 0.25]), (7, None, [1.0, 1.0])],
        "embedding_id long, chunk_id long, vector array<float>")
    chunks = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (3, 2), (4, None)], "chunk_id long, document_id long")
    access = spark.createDataFrame([(q, d) for q in (1, 2, 3, 4, 5, 6) for d in (1, 2, None)] + [(1, 1)], "query_id long, document_id long")
    questions = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [2.0, None]), (4, [2.0]), (5, None), (6, []), (None, [1.0, 1.0])],
                                      "query_id long, query_vector array<float>")
    got = near.listed_distances(vectors, chunks, access, questions, "embedding_id")
    q = questions.select("query_id", F.col("query_vector").cast("array<double>").alias("q"))
    v = vectors.select("embedding_id", "chunk_id", F.col("vector").cast("array<double>").alias("v"))
    plain = chunks.join(access, "document_id").join(v, "chunk_id").join(q, "query_id").select(
        "query_id", "embedding_id", cosine_distance("v", "q").alias("c"), l2_distance("v", "q").alias("l"), F.size("v").cast("bigint").alias("dim"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, plain.collect())))
    assert got.where("cosine_distance is null").count() and got.where("l2_distance > 0").count()


def test_vectors_and_texts_are_not_shuffled_for_the_winners(spark):
    chunks = spark.createDataFrame([(i, i // 3, i % 3, f"text {i}") for i in range(30)], "chunk_id long, document_id long, chunk_idx long, chunk_text string")
    vectors = spark.createDataFrame([(i, i, 0, [float(i), 1.0], "COMPLETED", 1) for i in range(30)],
                                    "embedding_id long, chunk_id long, subchunk_idx long, vector array<float>, status string, attempts int")
    questions = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, query_vector array<float>")
    wanted = spark.createDataFrame([(1, 29), (2, 0), (2, 1)], "query_id long, chunk_id long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # as with large tables
    try:
        found = rt.pair_distances(wanted, questions, chunks, vectors)
        details = rt.attach_chunk_details(wanted, chunks)
        for df in (found, details):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(chunk_id" not in plan and "BroadcastHashJoin" in plan
        assert {(r.query_id, r.chunk_id, r.document_id) for r in found.collect()} == {(1, 29, 9), (2, 0, 0), (2, 1, 0)}
        assert {(r.query_id, r.chunk_text) for r in details.collect()} == {(1, "text 29"), (2, "text 0"), (2, "text 1")}
        everyone = rt.nearest_chunks(questions, chunks, vectors, None, 2)
        assert everyone.where("query_id = 2").select("chunk_id").orderBy("chunk_id").collect() == [(0,), (1,)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_minhash_is_the_least_hash_of_every_shingle(spark):
    long = " ".join(f"w{i % 700}" for i in range(40_000))
    rows = spark.createDataFrame([(1, "a b c d"), (2, ""), (3, None), (4, "One  word"), (5, long), (6, "x"), (7, "é ü ß ж")], "id long, text string")
    got = {r.id: r.sig for r in imp.signatures(rows, "id", "text", 120).withColumnRenamed("_sig", "sig").collect()}
    for r in rows.where("length(text) < 20").select("id", F.split(imp.normalized(F.col("text")), " ").alias("w")).collect() + [(5, long.split())]:
        words = [w for w in r[1] if w]
        s = {" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
        one = spark.createDataFrame([(x,) for x in s], "s string").select(
            *[F.min(F.xxhash64("s", F.lit(str(j)))).alias(f"h{j}") for j in (0, 7, 42, 119)]).first()
        assert [got[r[0]][j] for j in (0, 7, 42, 119)] == list(one)
    assert got[3] == [None] * 120


def test_group_sizes_meet_their_rows_without_salt_copies(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i < 40 else f"k{i // 3}") for i in range(100)], "id long, fingerprint string")
    sizes = rows.groupBy("fingerprint").count().withColumnRenamed("count", "_n").where("_n > 1")
    want = {(i, n) for i, n in imp._with_sizes(rows, sizes, ["fingerprint"], "left", "id").select("id", "_n").collect()}
    monkeypatch.setattr(imp, "HOT_ROWS", 10)
    monkeypatch.setattr(imp, "bounded_broadcast", lambda df: F.broadcast(df) if df.count() <= 3 else None)
    got = imp._with_sizes(rows, sizes, ["fingerprint"], "left", "id")
    assert "_salt" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert len(want) == 100 and {(i, n) for i, n in got.select("id", "_n").collect()} == want and got.count() == 100
