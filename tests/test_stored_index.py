"""Stored vector index, bounded top-k and versioned folders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.operators import index as idx, ivf, nearest, versions

VEC = "vec_id long, embedding array<float>"


def table(spark, v, first=0, parts=4):
    return spark.createDataFrame([(i + first, [float(x) for x in row]) for i, row in enumerate(v)], VEC).repartition(parts)


def asked(spark, q):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(q)], "query_id long, query_vector array<double>")


def brute(v, q, k):
    unit = lambda x: np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    d = np.round(1 - unit(q) @ unit(np.float32(v).astype(float)).T, 9)
    return {i: np.lexsort((np.arange(len(v)), row))[:k].tolist() for i, row in enumerate(d)}


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_built_once_searched_often(spark, tmp_path):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    v = centers[rng.integers(12, size=900)] + 0.3 * rng.normal(size=(900, 16))
    v[300:600] = v[300]          # a third of all vectors are one vector
    v[5] = 0
    q = centers[rng.integers(12, size=30)] + 0.3 * rng.normal(size=(30, 16))
    odd = spark.createDataFrame([(None, [1.0] * 16), (5000, None), (5001, []), (5002, [1.0, 2.0])], VEC)
    base = str(tmp_path / "ivf")
    index = ivf.build_ivf(table(spark, v).unionByName(odd), base)
    assert (index.n, index.dim) == (900, 16) and index.vectors().count() == 900 and 2 < index.n_cells <= 42
    want = brute(v, q, 10)
    questions = asked(spark, q)
    assert by_query(ivf.search_ivf(index, questions, 10, index.n_cells)) == want

    def mean(nprobe):
        got = by_query(ivf.search_ivf(index, questions, 10, nprobe))
        return np.mean([len(set(got.get(i, [])) & set(want[i])) / 10 for i in want])

    n = ivf.tune(index, questions, 10)
    assert ivf.open_ivf(spark, base).nprobe == n and mean(n) >= 0.9 and (n == 1 or mean(n - 1) < 0.9)
    assert ivf.tune(index, questions, 10, sample=10) >= 1
    # one question reads only the partitions of its cells
    block = nearest.blocks_of(questions.limit(1))[0]
    probes, coarse = ivf._probed(index, block, 1)
    assert len(probes) == 1 and len(coarse) == 1 < index.n_coarse
    rows = ivf.candidates(index, list(probes), coarse)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(coarse" in plan or "PartitionFilters: [coarse" in plan or "coarse#" in plan.split("PartitionFilters")[1][:60]
    assert len(rows.select(F.input_file_name()).distinct().collect()) < len(index.vectors().select(F.input_file_name()).distinct().collect())
    # a new version beside the old one, from the old one
    again = ivf.build_ivf(index.vectors().select("vec_id", "_v").where("vec_id < 100"), base, vec_col="_v")
    assert ivf.open_ivf(spark, base).folder == again.folder != index.folder and index.vectors().count() == 900


def test_index_of_nothing(spark, tmp_path):
    q = asked(spark, np.ones((2, 3)))
    index = ivf.build_ivf(table(spark, np.zeros((0, 3))), str(tmp_path / "none"))
    assert index.n_cells == 0 and ivf.search_ivf(index, q, 5).count() == 0 and ivf.tune(index, q) == 1
    one = ivf.build_ivf(table(spark, np.ones((3, 3))), str(tmp_path / "one"))
    assert by_query(ivf.search_ivf(one, q, 2)) == {0: [0, 1], 1: [0, 1]}
    assert ivf.search_ivf(one, asked(spark, np.ones((1, 4))), 2).count() == 0
    with pytest.raises(ValueError):
        ivf.open_ivf(spark, str(tmp_path / "absent"))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_bounds_keep_the_answer_and_few_rows(spark, metric):
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(6400, 8)), rng.normal(size=(5, 8))
    v[::7] = v[3]                # ties
    vectors = table(spark, v, parts=64).select("vec_id", F.col("embedding").cast("array<double>").alias("_v"))
    block = nearest.blocks_of(asked(spark, q))[0]
    plain = nearest.partial_topk(vectors, block, 10, metric, "vec_id")
    limit = nearest.bounds(vectors, block, 10, metric, "vec_id")
    near = nearest.partial_topk(vectors, block, 10, metric, "vec_id", limits=limit)
    assert by_query(nearest.topk(near, 10, "vec_id")) == by_query(nearest.topk(plain, 10, "vec_id"))
    # 64 tasks of 100 vectors: 10 each without bounds, about 8 x 10 in all with them
    assert plain.count() == 5 * 64 * 10 and near.count() < 5 * 3 * 8 * 10


def test_questions_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v, q = rng.normal(size=(200, 8)), rng.normal(size=(40, 8))
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 8 * 8 * 7)
    questions = asked(spark, q)
    assert len(nearest.blocks_of(questions)) > 4
    got = by_query(idx.l2_topk(table(spark, v), questions, 4, query_text=None))
    d = np.round(np.sqrt(((q[:, None] - np.float32(v).astype(float)[None]) ** 2).sum(axis=2)), 9)
    assert got == {i: np.argsort(row, kind="stable")[:4].tolist() for i, row in enumerate(d)}


def test_rebuild_from_the_index_itself_and_killed_rebuild(spark, tmp_path):
    e = table(spark, np.arange(30).reshape(10, 3))
    idx.update_index(spark, str(tmp_path), "t", e)
    held = idx.update_index(spark, str(tmp_path), "t", None, "find")
    out = idx.update_index(spark, str(tmp_path), "t", held.where("vec_id < 6"), force_rebuild=True)
    assert out.count() == 6
    before = versions.current(spark, f"{tmp_path}/t")
    broken = out.withColumn("vec_id", F.expr("CASE WHEN vec_id = 3 THEN raise_error('killed') ELSE vec_id END").cast("long"))
    with pytest.raises(Exception, match="killed"):
        idx.update_index(spark, str(tmp_path), "t", broken, force_rebuild=True)
    assert versions.current(spark, f"{tmp_path}/t") == before
    assert idx.update_index(spark, str(tmp_path), "t", None, "find").count() == 6
    # a folder that was written but never named is not seen; appends go to the named one, once
    e.write.parquet(versions.new_folder(f"{tmp_path}/t"))
    assert idx.update_index(spark, str(tmp_path), "t", e, "").count() == 10
    assert idx.update_index(spark, str(tmp_path), "t", e, "").count() == 10

