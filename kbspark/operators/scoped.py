"""Nearest chunks per question among the documents its asker may read, without (asker, document) rows.

Access is a predicate on a candidate: a vector row carries its document's policy columns (company,
owner, level, approval), a block of questions carries its callers (company, type, user), and the
task that compares them decides the list policy for every question at once as a boolean matrix.
Live grants and requested documents travel the same way, as the short list of question numbers of
the block that a document is granted to or wanted by. So what is shuffled are documents, grants and
vectors, each once, and the k nearest chunks per question and task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from kbspark.functions.vectors import DIST_DIGITS
from kbspark.operators.access import live_grants
from kbspark.operators.joins import row_blocks
from kbspark.operators.nearest import BLOCK_BYTES, Block, cosine, matrix

#: Questions of a block: bounds the lists of question numbers that a document carries.
BLOCK_QUESTIONS = 4096
VECTOR_SLICE = 1024   # vectors compared with a block at once
POLICY = ["company_id", "owner_id", "access_level", "is_approved"]


@dataclass
class Scope:
    """What decides access: ``documents`` (document_id and policy columns), ``callers`` (query_id,
    user_id, company_id, user_type), ``grants`` as of a time, and ``requests`` (query_id, doc_ids; null
    for no restriction) if questions may name documents."""

    documents: DataFrame
    callers: DataFrame
    grants: DataFrame
    as_of: str
    requests: DataFrame | None = None


@dataclass
class _Callers:
    """The callers of a block by question number: codes of user and company (-2: none), type."""

    users: pa.Array
    companies: pa.Array
    user: np.ndarray
    company: np.ndarray
    internal: np.ndarray
    free: np.ndarray          # questions that name no documents

    @classmethod
    def of(cls, block: Block, callers: pa.Table, free: set) -> _Callers:
        rows = {r["query_id"]: r for r in callers.to_pylist()}
        ids = block.ids.to_pylist()

        def column(name):
            kind = callers.schema.field(name).type
            values = pa.array([rows.get(q, {}).get(name) for q in ids], kind)
            known = pc.drop_null(pc.unique(values))
            return known, pc.fill_null(pc.index_in(values, known), -2).to_numpy(zero_copy_only=False)

        users, user = column("user_id")
        companies, company = column("company_id")
        known = np.array([rows.get(q, {}).get("user_id") is not None for q in ids], bool)
        internal = np.array([rows.get(q, {}).get("user_type") == "INTERNAL" for q in ids], bool)
        return cls(users, companies, user, np.where(known, company, -2), internal & known, np.array([q in free for q in ids], bool))

    def may_read(self, batch: pa.RecordBatch) -> np.ndarray:
        """[vector, question]: the list policy."""
        column = batch.schema.get_field_index
        code = lambda name, known: pc.fill_null(pc.index_in(batch.column(column(name)), known), -1).to_numpy(zero_copy_only=False)
        level = batch.column(column("access_level"))
        flag = lambda a: pc.fill_null(a, False).to_numpy(zero_copy_only=False)
        public = flag(pc.equal(level, "PUBLIC")) & flag(batch.column(column("is_approved")))
        internal = flag(pc.equal(level, "INTERNAL"))
        same = code("company_id", self.companies)[:, None] == self.company
        out = same & (public[:, None] | (internal[:, None] & self.internal))
        out |= code("owner_id", self.users)[:, None] == self.user
        _set(out, batch.column(column("granted")))
        if not self.free.all():
            wanted = np.zeros_like(out)
            _set(wanted, batch.column(column("wanted")))
            out &= self.free | wanted
        return out


def _set(out: np.ndarray, lists: pa.Array) -> None:
    """out[row, number] = True for every number of every row's list."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy(zero_copy_only=False)] = True


class _BestChunks:
    """The k nearest chunks so far of each question: distances and ids, by distance, then id."""

    def __init__(self, n: int, k: int, text_ids: bool):
        self.k = k
        self.d = np.full((n, k), np.inf)
        self.i = np.full((n, k), "" if text_ids else -(1 << 63), object if text_ids else np.int64)

    def merge(self, rows: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        """``d``: distances of questions ``rows`` to vectors of the chunks ``ids`` (a chunk may come often)."""
        near = (d <= self.d[rows, -1][:, None]) & np.isfinite(d)
        hit = np.flatnonzero(near.any(axis=1))
        if not len(hit):
            return
        some = np.flatnonzero(near[hit].any(axis=0))   # later on few vectors come near enough
        rows, d, ids = rows[hit], d[np.ix_(hit, some)], ids[some]
        chunk, number = np.unique(ids, return_inverse=True)
        order = np.argsort(number, kind="stable")
        first = np.flatnonzero(np.r_[True, number[order][1:] != number[order][:-1]])
        least = np.minimum.reduceat(d[:, order], first, axis=1)
        all_d = np.concatenate([self.d[rows], least], axis=1)
        all_i = np.concatenate([self.i[rows], np.broadcast_to(chunk, least.shape)], axis=1)
        order = np.lexsort((all_d, all_i), axis=1)     # a chunk's rows together, nearest first
        all_d, all_i = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)
        all_d[:, 1:][all_i[:, 1:] == all_i[:, :-1]] = np.inf
        order = np.lexsort((all_i, all_d), axis=1)[:, :self.k]
        self.d[rows], self.i[rows] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)


def question_blocks(questions: DataFrame, query_vec: str = "query_vector") -> list[Block]:
    q = questions.select("query_id", F.col(query_vec).cast("array<double>").alias("_q")).where(F.size("_q") > 0)
    widest = q.agg(F.max(F.size("_q"))).first()[0]
    if not widest:
        return []
    return [Block.of(b) for b in row_blocks(q, "query_id", max(1, min(BLOCK_QUESTIONS, BLOCK_BYTES // (8 * widest))))]


def _numbers(block: Block, spark) -> DataFrame:
    schema = T.StructType([block.id_field, T.StructField("n", T.IntegerType())])
    return F.broadcast(spark.createDataFrame([(q, i) for i, q in enumerate(block.ids.to_pylist())], schema))


def _policies(scope: Scope, block: Block) -> DataFrame:
    """(document_id, policy columns, granted, wanted): question numbers of the block, at most its size a document."""
    numbers = _numbers(block, scope.documents.sparkSession)
    asking = F.broadcast(scope.callers.where("user_id IS NOT NULL").join(numbers, "query_id").select("user_id", "n"))
    grants = (live_grants(scope.grants, scope.as_of).join(asking, "user_id")
              .groupBy("document_id").agg(F.collect_set("n").alias("granted")))
    out = scope.documents.select("document_id", *POLICY).join(grants, "document_id", "left")
    if scope.requests is None:
        return out.withColumn("wanted", F.lit(None).cast("array<int>"))
    named = scope.requests.join(numbers, "query_id").select("n", F.explode("doc_ids").alias("document_id"))
    return out.join(named.groupBy("document_id").agg(F.collect_set("n").alias("wanted")), "document_id", "left")


def _nearest_of_block(vectors: DataFrame, block: Block, callers: _Callers | None, k: int) -> DataFrame:
    """(query_id, chunk_id, best): per task the k nearest readable chunks of each question."""
    text_ids = isinstance(vectors.schema["chunk_id"].dataType, T.StringType)
    # plain values: a broadcast is unpickled by workers that may not have this package
    held = vectors.sparkSession.sparkContext.broadcast((block.ids, block.groups, None if callers is None else vars(callers)))

    def run(batches):
        query_ids, groups, known = held.value
        callers = None if known is None else _Callers(**known)
        best = [_BestChunks(len(q), k, text_ids) for _, q in groups]
        id_type = None
        for whole in batches:
            id_type = whole.schema.field(0).type
            for a in range(0, whole.num_rows, VECTOR_SLICE):
                batch = whole.slice(a, VECTOR_SLICE)
                readable = callers.may_read(batch) if callers is not None else np.ones((batch.num_rows, len(query_ids)), bool)
                size = pc.fill_null(pc.list_value_length(batch.column(1)), -1).to_numpy(zero_copy_only=False)
                for (place, q), b in zip(groups, best, strict=True):
                    rows = np.flatnonzero((size == q.shape[1]) & readable[:, place].any(axis=1))
                    asks = np.flatnonzero(readable[np.ix_(rows, place)].any(axis=0)) if len(rows) else rows
                    if not len(asks):
                        continue
                    part = batch.take(pa.array(rows))
                    ids, v = part.column(0).to_numpy(zero_copy_only=False), matrix(part.column(1), q.shape[1])
                    d = np.round(cosine(q[asks], v), DIST_DIGITS)
                    d[~readable[np.ix_(rows, place[asks])].T] = np.inf
                    b.merge(asks, d, ids)
        for (place, _), b in zip(groups, best, strict=True):
            row, col = np.nonzero(np.isfinite(b.d))
            if len(row):
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(place[row])), pa.array(b.i[row, col], id_type), pa.array(b.d[row, col])],
                                                 names=["query_id", "chunk_id", "best"])

    schema = T.StructType([block.id_field, vectors.schema["chunk_id"], T.StructField("best", T.DoubleType())])
    return vectors.mapInArrow(run, schema)


def nearest_chunks(questions: DataFrame, chunks: DataFrame, embeddings: DataFrame, scope: Scope | None, top_k: int) -> DataFrame:
    """(query_id, chunk_id): the ``top_k`` nearest chunks of each question by their nearest vector (ties
    by chunk id), among the readable ones with a ``scope``, else among all. ``embeddings``: chunk_id, vector."""
    double = F.col("_v").cast("array<double>").alias("_v")   # behind the shuffle: stored numbers may be half as wide
    vectors = embeddings.select("chunk_id", F.col("vector").alias("_v")).where(F.col("chunk_id").isNotNull() & (F.size("_v") > 0))
    found = []
    for block in question_blocks(questions):
        callers, rows = None, vectors.select("chunk_id", double)
        if scope is not None:
            numbers = _numbers(block, questions.sparkSession)
            of_block = scope.callers.join(numbers, "query_id").select("query_id", "user_id", "company_id", "user_type").toArrow()
            named = set(block.ids.to_pylist())
            if scope.requests is not None:   # a question without a request row may see nothing
                named = {r.query_id for r in scope.requests.join(numbers, "query_id").where("doc_ids IS NULL").select("query_id").collect()}
            callers = _Callers.of(block, of_block, named)
            # one row per document; chunks of a hot document are dealt anew by the adaptive skew join
            policies = chunks.select("chunk_id", "document_id").join(_policies(scope, block), "document_id")
            rows = vectors.join(policies, "chunk_id").select("chunk_id", double, *POLICY, "granted", "wanted")
        found.append(_nearest_of_block(rows, block, callers, top_k))
    if not found:
        return questions.select("query_id").limit(0).crossJoin(chunks.select("chunk_id").limit(0))
    each = reduce(DataFrame.unionByName, found)
    w = Window.partitionBy("query_id").orderBy("best", "chunk_id")
    return each.groupBy("query_id", "chunk_id").agg(F.min("best").alias("best")).withColumn("at", F.row_number().over(w)).where(
        F.col("at") <= top_k).select("query_id", "chunk_id")
