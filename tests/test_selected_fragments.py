"""Key fragments: each vector made once, only for selected documents, and the ranking as computed by hand."""

import math
import random

from pyspark.sql import functions as F, types as T

from kbspark.operators import embed as emb, importance as imp
from kbspark.plans.queries import queries


def _expected(rows, n):
    """{(id, rank): (chunk_idx, distance)} of plain rows (id, chunk_idx, vector)."""
    out = {}
    for d in {r[0] for r in rows if r[0] is not None}:
        mine = [r for r in rows if r[0] == d]
        width = max((len(v) for _, _, v in mine if v), default=0)
        if not width:
            continue
        column = [[v[i] for _, _, v in mine if v and len(v) > i and v[i] is not None] for i in range(width)]
        cent = [sum(c) / len(c) for c in column]
        ranked = []
        for _, idx, v in mine:
            dist = None
            if v is not None and len(v) == width:
                a, b = math.sqrt(sum(x * x for x in v)), math.sqrt(sum(x * x for x in cent))
                dist = round(1 - sum(x * y for x, y in zip(v, cent)) / (a * b), 9) if a and b else 1.0
            ranked.append((dist is not None, dist, idx))
        for rank, (_, dist, idx) in enumerate(sorted(ranked)[:n], 1):
            out[d, rank] = (idx, dist)
    return out


def _found(df):
    return {(r.document_id, r.fragment_rank): (r.chunk_idx, r.centroid_distance) for r in df.collect()}


def _same(got, want):
    assert got.keys() == want.keys()
    for k, (idx, dist) in want.items():
        assert got[k][0] == idx and (got[k][1] is dist is None or abs(got[k][1] - dist) < 2e-9), k


SCHEMA = "document_id long, chunk_idx long, vector array<double>"


def test_key_fragments_by_hand(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(d, i, [rnd.random() for _ in range(6)]) for d in range(40) for i in range(rnd.randrange(1, 30))]
    rows += [(50, 0, None), (50, 1, [1.0, 2.0]), (50, 2, [1.0]), (51, 0, None), (52, 0, []), (53, 0, [0.0, 0.0]), (53, 1, [0.0, 0.0]),
             (54, 0, [3.0, None, 1.0]), (54, 1, [1.0, 2.0, 1.0]), (55, 0, None), (55, 1, [2.0]), (None, 0, [1.0]), (None, 1, [2.0])]
    want = _expected([r for r in rows if r[0] != 54], 2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for values, held in ((imp.BROADCAST_VALUES, imp.SUM_ROWS), (0, 3)):   # broadcast and joined centroids, one and many parts
        monkeypatch.setattr(imp, "BROADCAST_VALUES", values)
        monkeypatch.setattr(imp, "SUM_ROWS", held)
        _same(_found(imp.key_fragments(df.where("document_id IS NULL OR document_id != 54"), 2)), want)
        cent = {r.document_id: r.centroid for r in imp.centroids(df, "document_id").collect()}
        assert cent[54] == [2.0, 2.0, 1.0] and cent[50] == [1.0, 2.0] and not {None, 51, 52} & cent.keys()


def test_key_fragments_makes_each_vector_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf(T.ArrayType(T.DoubleType()))
    def vector(i):
        made.add(1)
        return [float(i % 3 + 1), float(i % 5)]

    rows = spark.range(200).select((F.col("id") % 20).alias("document_id"), F.col("id").alias("chunk_idx"), vector("id").alias("vector"))
    assert imp.key_fragments(rows, 2).count() == 40
    assert made.value == 200


def test_only_selected_documents_are_embedded(spark, tmp_path, monkeypatch):
    sentence = lambda d, i: f"Word{d} says thing{i} of {d * i}."
    # ids 0 to 9 were made early; 1, 2 and 3 share a text, 700 and 701 are late copies, the others have texts of their own
    text = {d: " ".join(sentence(d, i) for i in range(12)) for d in [*range(10), 700]} | {1: "A b. C d.", 2: "A b. C d.", 3: "a  b. c d."}
    text[701] = text[700]
    spark.createDataFrame([*text.items(), (None, "A b. C d."), (5, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, counts = spark.sparkContext.accumulator(0), emb.hashed_counts

    @F.udf("string")
    def watched(t):
        seen.add(1)
        return t

    monkeypatch.setattr(emb, "hashed_counts", lambda t: counts(watched(t)))
    got = queries()["selected_fragments"](spark, str(tmp_path)).collect()
    assert {(r.document_id, r.chunk_idx, r.fragment_rank) for r in got} == {(1, 0, 1), (2, 0, 1), (3, 0, 1)}
    assert seen.value == 3
