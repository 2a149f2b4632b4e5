"""Document importance and training-set selection (O-34, O-48, O-61, O-82, O-93, O-94).

Importance I(D) = number of other documents in the store with the same content. It is
computed without ever forming document pairs:

* exact copies: documents are grouped by a fingerprint of their normalised text; I(D) is the
  group size minus one (one aggregate, joined back with a salted join so a hot fingerprint —
  say a third of all rows — is spread over many tasks);
* similar documents: I(D) = number of other documents of at least a given similarity, counted
  exactly in blocks (``similar.py``); ``select_training`` takes either form;
* near copies, cheaply: MinHash signatures over word 3-gram shingles, cut into bands; I_near(D) is the
  size of D's most populated band bucket minus one. Bucket sizes are aggregates, not pairs.

Selection follows the design: important (I > I_thr), selected old important documents
(t < t_thr ∧ I > I_thr) with their key fragments, moderate recent documents
(t > t_recent ∧ I < I_thr); documents newer than t_latest stay retrieval-only until their
number reaches a critical mass.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from kbspark.functions.exprs import let
from kbspark.functions.text import BLANK, strip_blanks
from kbspark.functions.vectors import cosine_distance
from kbspark.operators import similar
from kbspark.operators.joins import bounded_broadcast, hot_key_join
from kbspark.session import materialize, scratch_path

N_HASHES = 32
ROWS_PER_BAND = 4
SHINGLE = 3
HOT_ROWS = 10_000        # groups of more rows do not meet their rows in one task
SHINGLE_SLICE = 1 << 15  # shingles hashed at once in a task
SUM_ROWS = 1 << 14       # vectors that a task adds up at once
BROADCAST_VALUES = 1 << 22   # coordinates of centroids that are broadcast (32 MB)
U64 = np.uint64


def normalized(text: Column) -> Column:
    return F.lower(F.regexp_replace(strip_blanks(F.coalesce(text, F.lit(""))), f"{BLANK}+", " "))


def fingerprint(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def exact_importance(docs: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, importance = number of other documents with the same text)."""
    # the (id, fingerprint) table is written once: both the group sizes and the join back read
    # it instead of hashing every text twice more
    fp = materialize(docs.select(id_col, fingerprint(F.col(text_col)).alias("fingerprint")))
    sizes = _repeated(fp, ["fingerprint"])
    j = _with_sizes(fp, sizes, ["fingerprint"], "left", id_col)
    return j.select(id_col, "fingerprint", F.coalesce(F.col("_n") - 1, F.lit(0)).alias("importance"))


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _n) of the keys that more than one row holds, written once: the others need no join."""
    return materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1))


def _with_sizes(rows: DataFrame, sizes: DataFrame, keys: list[str], how: str, id_col: str) -> DataFrame:
    """``rows`` with the size of their group (``sizes``: keys, _n). Few groups are broadcast. Of many, those of
    more than ``HOT_ROWS`` rows are still few, and the others meet their rows by a plain join: no copies for a salt."""
    small = bounded_broadcast(sizes)
    if small is not None:
        return rows.join(small, keys, how)
    hot = sizes.where(F.col("_n") > HOT_ROWS)
    hot_keys, few = hot.select(*keys), bounded_broadcast(hot)
    rest = rows.join(hot_keys if few is None else F.broadcast(hot_keys), keys, "left_anti")
    light = rest.join(sizes.where(F.col("_n") <= HOT_ROWS), keys, how)
    return light.unionByName(hot_key_join(rows, hot, keys, salt_by=[id_col], small_fits=few is not None))


def _short_hashes(seeds: np.ndarray, text: bytes) -> np.ndarray:
    """xxhash64 of a text of less than four bytes, for every seed."""
    x = seeds + (U64(0x27D4EB2F165667C5) + U64(len(text)))
    for byte in text:
        x ^= U64(byte * 0x27D4EB2F165667C5 % (1 << 64))
        x = ((x << U64(11)) | (x >> U64(53))) * U64(0x9E3779B185EBCA87)
    x ^= x >> U64(33)
    x *= U64(0xC2B2AE3D27D4EB4F)
    x ^= x >> U64(29)
    x *= U64(0x165667B19E3779F9)
    return x ^ (x >> U64(32))


def _least_hashes(column: pa.Array, n_hashes: int) -> pa.Array:
    """Per row the least ``xxhash64(shingle, j)`` for every j, from the shingles' own hashes; nulls where there are none."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    seeds = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    stop = np.cumsum(n)
    full = np.flatnonzero(n)
    out = np.zeros((len(n), n_hashes), np.int64)
    a = 0
    while a < len(full):   # rows of about so many shingles at once, one row at least
        first = stop[full[a]] - n[full[a]]
        b = max(a + 1, int(np.searchsorted(stop[full], first + SHINGLE_SLICE, "right")))
        some = full[a:b]
        part, starts = seeds[first:stop[some[-1]]], stop[some] - n[some] - first
        for j in range(n_hashes):
            out[some, j] = np.minimum.reduceat(_short_hashes(part, str(j).encode()).view(np.int64), starts)
        a = b
    flat = pa.array(out.ravel(), mask=np.repeat(n == 0, n_hashes))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * n_hashes, pa.int32()), flat)


def signatures(docs: DataFrame, id_col: str, text_col: str, n_hashes: int = N_HASHES, k: int = SHINGLE) -> DataFrame:
    """(id, _sig): ``minhash`` of every text. ``xxhash64(s, j)`` continues from ``xxhash64(s)``, so a
    shingle's text is hashed once and its numbers are hashed in arrays."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _least_hashes(b.column(1), n_hashes)], names=[id_col, "_sig"])

    hashed = let(_shingles(F.col(text_col), k), lambda s_: F.transform(s_, lambda s: F.xxhash64(s)))
    return docs.select(id_col, hashed.alias("_h")).mapInArrow(
        run, T.StructType([docs.schema[id_col], T.StructField("_sig", T.ArrayType(T.LongType()))]))


def _shingles(text: Column, k: int) -> Column:
    def shingles(toks: Column) -> Column:
        n = F.size(toks)
        starts = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.when(n > 0, F.array(F.lit(0))))
        return F.transform(F.coalesce(starts, F.array().cast("array<int>")),
                           lambda i: F.array_join(F.slice(toks, i + 1, k), " "))

    return let(F.filter(F.split(normalized(text), " "), lambda t: t != ""), shingles)


def minhash(text: Column, n_hashes: int = N_HASHES, k: int = SHINGLE) -> Column:
    sh = _shingles(text, k)
    return let(sh, lambda s_: F.transform(F.sequence(F.lit(0), F.lit(n_hashes - 1)),
                                         lambda j: F.array_min(F.transform(s_, lambda s: F.xxhash64(s, j.cast("string"))))))


def near_importance(docs: DataFrame, id_col: str = "document_id", text_col: str = "text",
                    n_hashes: int = N_HASHES, rows_per_band: int = ROWS_PER_BAND) -> DataFrame:
    """(id, importance_near): largest band bucket containing the document, minus one."""
    bands = n_hashes // rows_per_band
    if n_hashes <= 1000:   # numbers of up to three digits
        sig = signatures(docs, id_col, text_col, n_hashes)
    else:
        sig = docs.select(id_col, minhash(F.col(text_col), n_hashes).alias("_sig")).where(F.size("_sig") > 0)
    banded = sig.select(id_col, F.posexplode(let(F.col("_sig"), lambda sg: F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.xxhash64(F.slice(sg, b * rows_per_band + 1, rows_per_band))))).alias("band", "bucket"))
    banded = materialize(banded.where(F.col("bucket").isNotNull()))
    j = _with_sizes(banded, _repeated(banded, ["band", "bucket"]), ["band", "bucket"], "inner", id_col)
    best = j.groupBy(id_col).agg((F.max("_n") - 1).alias("importance_near"))
    return docs.select(id_col).join(best, id_col, "left").select(
        id_col, F.coalesce(F.col("importance_near"), F.lit(0)).alias("importance_near"))


def similar_importance(docs: DataFrame, id_col: str = "document_id", text_col: str = "text", **options) -> DataFrame:
    """(id, importance = number of other documents that are similar to it)."""
    return similar.similar_importance(docs, normalized(F.col(text_col)), id_col, **options)


def select_training(docs: DataFrame, importance: DataFrame, t_thr: str, t_recent: str, i_thr: float,
                    id_col: str = "document_id", t_col: str = "created_at") -> DataFrame:
    """T = important ∪ selected ∪ moderate, one row per document with its reasons (O-61, O-93)."""
    d = docs.select(id_col, t_col).join(importance.select(id_col, "importance"), id_col)
    t, i = F.col(t_col), F.col("importance")
    reasons = F.array_compact(F.array(
        F.when(i > i_thr, F.lit("important")),
        F.when((t < F.lit(t_thr).cast("timestamp")) & (i > i_thr), F.lit("selected")),
        F.when((t > F.lit(t_recent).cast("timestamp")) & (i < i_thr), F.lit("moderate"))))
    return (d.withColumn("_r", reasons).where(F.size("_r") > 0)
            .select(id_col, t_col, "importance", F.array_join("_r", ",").alias("reasons")))


def route_new(docs: DataFrame, t_latest: str, critical_mass: int, id_col: str = "document_id",
              t_col: str = "created_at") -> DataFrame:
    """Documents newer than ``t_latest`` are retrieval-only; ``mass_reached`` says whether their
    number reached ``critical_mass`` (a scalar subquery, evaluated once) (O-82)."""
    is_new = F.col(t_col) > F.lit(t_latest).cast("timestamp")
    n_new = docs.where(is_new).select(F.count(F.lit(1))).scalar()
    return docs.select(id_col, t_col,
                       F.when(is_new, F.lit("retrieval_only")).otherwise(F.lit("training_candidate")).alias("route"),
                       (n_new >= F.lit(critical_mass)).alias("mass_reached"))


def recent_window(docs: DataFrame, days: int, t_col: str = "created_at") -> DataFrame:
    """Documents within ``days`` of the newest one (O-94); the newest time is a scalar subquery."""
    newest = docs.select(F.max(t_col)).scalar()
    return docs.where(F.col(t_col) >= newest - F.make_interval(days=F.lit(days)))


def _partial_sums(id_field: T.StructField):
    """Task function: (id, sums and numbers of the non-null values by coordinate), one row per id and about
    ``SUM_ROWS`` vectors; rows of one id that stand together, as a document's chunks do, give one row."""
    out = T.StructType([id_field, T.StructField("_s", T.ArrayType(T.DoubleType())), T.StructField("_k", T.ArrayType(T.LongType()))])

    def sums(rows: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
        code = rows.column(0).combine_chunks().dictionary_encode()
        owner, n = code.indices.to_numpy(zero_copy_only=False), len(code.dictionary)
        vector = rows.column(1).combine_chunks()
        size = pc.list_value_length(vector).to_numpy(zero_copy_only=False).astype(np.int64)
        width = int(size.max())
        value = vector.flatten()
        at = np.repeat(owner.astype(np.int64) * width, size) + np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
        given = pc.is_valid(value).to_numpy(zero_copy_only=False)
        x = pc.fill_null(value, 0.0).to_numpy(zero_copy_only=False)
        total = np.bincount(at, weights=x, minlength=n * width)
        number = np.bincount(at, weights=given, minlength=n * width).astype(np.int64)
        reach = np.zeros(n, np.int64)
        np.maximum.at(reach, owner, size)
        inside = (np.arange(width) < reach[:, None]).ravel()
        stops = np.r_[0, np.cumsum(reach)].astype(np.int32)
        lists = [pa.ListArray.from_arrays(stops, pa.array(y[inside])) for y in (total, number)]
        return pa.RecordBatch.from_arrays([code.dictionary.cast(schema.field(0).type), *lists], names=out.names)

    def run(batches):
        held, n, schema = [], 0, None
        for b in batches:
            held, n, schema = held + [b], n + b.num_rows, b.schema
            if n >= SUM_ROWS:
                yield sums(pa.Table.from_batches(held), schema)
                held, n = [], 0
        if n:
            yield sums(pa.Table.from_batches(held), schema)

    return run, out


def centroids(vectors: DataFrame, id_col: str, vector_col: str = "vector") -> DataFrame:
    """(id, centroid): the mean of every coordinate over the id's vectors. Tasks add up their own vectors in
    arrays; only one row per id and part is shuffled, not one per vector or coordinate."""
    v = F.col(vector_col).cast("array<double>")
    some = vectors.where(F.col(id_col).isNotNull()).select(id_col, v.alias("_v")).where(F.size("_v") > 0)
    run, schema = _partial_sums(some.schema[id_col])
    parts = some.mapInArrow(run, schema).groupBy(id_col).agg(F.collect_list(F.struct("_s", "_k")).alias("_p"))

    def added(name: str) -> Column:
        add = lambda a, p: F.zip_with(a, p[name], lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
        return F.aggregate(F.slice("_p", 2, F.size("_p")), F.element_at("_p", 1)[name], add)

    mean = lambda s, k: F.when(k > 0, s / k)
    return parts.select(id_col, F.zip_with(added("_s"), added("_k"), mean).alias("centroid"))


def key_fragments(chunk_vectors: DataFrame, n: int, id_col: str = "document_id") -> DataFrame:
    """S(D): the ``n`` chunks of each document closest (cosine) to the document's centroid.
    The vectors are written once and read for the centroids and for the distances; centroids that can be
    broadcast meet them without a shuffle, and then a task sends at most ``n`` chunks per document to the ranking."""
    path = scratch_path(chunk_vectors.sparkSession, f"chunk-vectors-{uuid.uuid4().hex}")
    chunk_vectors.write.parquet(path)
    vectors = chunk_vectors.sparkSession.read.parquet(path)
    cent = materialize(centroids(vectors, id_col))
    small = (cent.agg(F.sum(F.size("centroid"))).first()[0] or 0) <= BROADCAST_VALUES
    d = vectors.join(F.broadcast(cent) if small else cent, id_col).withColumn("centroid_distance", cosine_distance("vector", "centroid"))
    # per-document windows: a document's chunks are bounded by its length
    w = Window.partitionBy(id_col).orderBy("centroid_distance", "chunk_idx")
    return d.withColumn("fragment_rank", F.row_number().over(w)).where(F.col("fragment_rank") <= n).drop("centroid")
