"""Stored approximate vector index (O-58): cells on disk, built once, searched often.

A version folder holds ``centroids`` (coarse, cell, centroid), ``vectors`` (partitioned by coarse,
sorted by cell) and ``meta``. There are about √n cells in about √cells coarse parts. Coarse
centroids are fitted on the driver on a bounded sample (``SAMPLE_PER_CENTROID`` vectors each), the
cells of a coarse part in one task on a bounded sample of that part; then every vector is assigned
to the nearest cell of its nearest coarse part. All groups are bounded: a coarse part with a third
of all vectors is dealt over as many salted groups as its size needs.

A search finds the nearest cells by an exact search over the centroid table, reads only the coarse
partitions (and, by their statistics, row groups) of those cells, compares a vector with the
questions that probe its cell only, and re-ranks exactly. ``tune`` measures, against the search of
all cells, how many cells must be probed for a recall, and stores that with the index.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kbspark.operators import versions
from kbspark.operators.nearest import Block, blocks_of, bounds, cosine, matrix, nearest, partial_topk, topk, units

SAMPLE_PER_CENTROID, GROUP_ROWS = 64, 20_000
RECALL, RECALL_SAMPLE = 0.9, 200   # aim, and questions that it is measured on

_META = "n long, dim int, n_cells int, n_coarse int, fine int"
_CENTROIDS = "coarse int, cell int, centroid array<double>"


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """At most ``k`` unit centroids of the unit rows of ``x`` (k-means++ start, repeated rows count once)."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centers = x[[rng.integers(len(x))]]
    far = 1 - x @ centers[0]
    while len(centers) < min(k, len(x)) and far.max() > 1e-12:
        centers = np.vstack([centers, x[rng.choice(len(x), p=np.maximum(far, 0) / np.maximum(far, 0).sum())]])
        far = np.minimum(far, 1 - x @ centers[-1])
    for _ in range(rounds):
        cell = (x @ centers.T).argmax(axis=1)
        total = np.zeros_like(centers)
        np.add.at(total, cell, x)
        used = np.abs(total).sum(axis=1) > 0
        centers = np.where(used[:, None], units(total), centers)
    return centers


def nearest_center(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([(v[a:a + 4096] @ centers.T).argmax(axis=1) for a in range(0, len(v), 4096)]) if len(v) else np.zeros(0, np.int64)


def _assign_coarse(vectors: DataFrame, centers: np.ndarray, id_col: str) -> DataFrame:
    dim = centers.shape[1]

    def run(batches):
        for b in batches:
            coarse = nearest_center(units(matrix(b.column(1), dim)), centers)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(coarse, pa.int32())], names=[id_col, "_v", "coarse"])

    return vectors.mapInArrow(run, f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, _v array<double>, coarse int")


@dataclass
class IvfIndex:
    spark: SparkSession
    base: str
    folder: str
    id_col: str
    n: int
    dim: int
    n_cells: int
    n_coarse: int
    fine: int            # cell numbers of one coarse part: coarse = cell // fine
    nprobe: int | None   # as tuned

    def centroids(self) -> DataFrame:
        return self.spark.read.schema(_CENTROIDS).parquet(f"{self.folder}/centroids")

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/vectors")


def open_ivf(spark: SparkSession, base: str, id_col: str = "vec_id") -> IvfIndex:
    """The current version of the index under ``base``."""
    folder = versions.current(spark, base)
    if folder is None:
        raise ValueError(f"no index under {base}")
    m = spark.read.schema(_META).parquet(f"{folder}/meta").first()
    probes = versions.current(spark, f"{folder}/probes")
    nprobe = spark.read.parquet(probes).first()["nprobe"] if probes else None
    return IvfIndex(spark, base, folder, id_col, m.n, m.dim, m.n_cells, m.n_coarse, m.fine, nprobe)


def build_ivf(vectors: DataFrame, base: str, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None,
              seed: int = 7) -> IvfIndex:
    """Write a new version of the index under ``base`` and make it the current one.

    Vectors of the most frequent length are indexed; null ids, null or empty vectors and vectors of
    another length are not part of it. Repeated rows are kept. An empty table gives an index without
    cells. ``lists``: number of cells (default √n).
    """
    spark, folder = vectors.sparkSession, versions.new_folder(base)
    rows = vectors.select(id_col, F.col(vec_col).cast("array<double>").alias("_v")).where(F.col(id_col).isNotNull() & (F.size("_v") > 0))
    sizes = rows.groupBy(F.size("_v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, n = (sizes["dim"], sizes["count"]) if sizes else (0, 0)
    rows = rows.where(F.size("_v") == dim)
    cells = lists or math.ceil(math.sqrt(n))
    part = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 30)) / float(1 << 30)
    n_coarse = max(1, math.ceil(math.sqrt(cells)))
    got = rows.where(part < SAMPLE_PER_CENTROID * n_coarse / max(1, n)).select("_v").toArrow()["_v"].combine_chunks()
    if not len(got):   # few rows: all of them
        got = rows.limit(SAMPLE_PER_CENTROID * n_coarse).select("_v").toArrow()["_v"].combine_chunks()
    coarse = kmeans(units(matrix(got, dim)), n_coarse, seed) if n else np.zeros((0, 1))
    fine = math.ceil(cells / max(1, len(coarse)))
    _assign_coarse(rows, coarse, id_col).write.parquet(f"{folder}/coarse")
    assigned = spark.read.parquet(f"{folder}/coarse")
    # one row per coarse part: about the fourth root of n
    plan = [(r.coarse, max(1, -(-r["count"] // GROUP_ROWS)), min(1.0, SAMPLE_PER_CENTROID * fine / r["count"]))
            for r in assigned.groupBy("coarse").count().collect()]
    parts = F.broadcast(spark.createDataFrame(plan, "coarse int, salts long, keep double"))

    def fit(t: pa.Table) -> pa.Table:
        number = t["coarse"][0].as_py()
        centers = kmeans(units(matrix(t["_v"].combine_chunks(), dim)), fine, seed)
        return pa.table({"coarse": pa.array([number] * len(centers), pa.int32()),
                         "cell": pa.array(number * fine + np.arange(len(centers)), pa.int32()),
                         "centroid": pa.array(list(centers), pa.list_(pa.float64()))})

    sample = assigned.join(parts, "coarse").where((part < F.col("keep"))).select("coarse", "_v")
    missing = assigned.groupBy("coarse").agg(F.min_by("_v", part).alias("_v"))   # a part whose sample is empty has this one
    sample.unionByName(missing).groupBy("coarse").applyInArrow(fit, _CENTROIDS).write.parquet(f"{folder}/centroids")
    id_type = assigned.schema[id_col].dataType.simpleString()

    def assign(rows: pa.Table, centers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({id_col: rows[id_col], "_v": rows["_v"], "cell": pa.array([], pa.int32()), "coarse": rows["coarse"]})
        at = nearest_center(units(matrix(rows["_v"].combine_chunks(), dim)), matrix(centers["centroid"].combine_chunks(), dim))
        return pa.table({id_col: rows[id_col], "_v": rows["_v"], "cell": centers["cell"].take(pa.array(at)), "coarse": rows["coarse"]})

    dealt = assigned.join(parts, "coarse").select(id_col, "_v", "coarse", F.pmod(F.xxhash64(id_col, F.lit(1)), F.col("salts")).alias("salt"))
    each = (spark.read.schema(_CENTROIDS).parquet(f"{folder}/centroids").join(parts, "coarse")
            .select("coarse", "cell", "centroid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")))
    placed = dealt.groupBy("coarse", "salt").cogroup(each.groupBy("coarse", "salt")).applyInArrow(
        assign, f"`{id_col}` {id_type}, _v array<double>, cell int, coarse int")
    placed.sortWithinPartitions("coarse", "cell").write.partitionBy("coarse").parquet(f"{folder}/vectors")
    n_cells = spark.read.parquet(f"{folder}/centroids").count()
    spark.createDataFrame([(n, dim, n_cells, len(coarse), fine)], _META).coalesce(1).write.parquet(f"{folder}/meta")
    versions.name(spark, base, folder)
    return open_ivf(spark, base, id_col)


def _probed(index: IvfIndex, block: Block, nprobe: int) -> tuple[dict[int, list[np.ndarray]], list[int]]:
    """(cell → per group the questions that probe it, coarse partitions to read) of one block: at most
    block × nprobe pairs of small numbers."""
    cells = index.centroids().select("cell", F.col("centroid").alias("_v"))
    got = nearest(cells, [block], nprobe, "cosine", "cell").select("query_id", "cell").toArrow()
    place = {v: i for i, v in enumerate(block.ids.to_pylist())}
    group_of, number_of = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    for g, (at, _) in enumerate(block.groups):
        group_of[at], number_of[at] = g, np.arange(len(at))
    lists: dict[int, list[list[int]]] = {}
    for q, cell in zip(got["query_id"].to_pylist(), got["cell"].to_pylist()):
        lists.setdefault(cell, [[] for _ in block.groups])[group_of[place[q]]].append(number_of[place[q]])
    return ({c: [np.array(sorted(x), np.int64) for x in per] for c, per in lists.items()}, sorted({c // index.fine for c in lists}))


def candidates(index: IvfIndex, cells: list[int], coarse: list[int]) -> DataFrame:
    """(id, _v, cell) of the probed partitions; of their row groups only those that may hold a probed cell."""
    rows = index.vectors().where(F.col("coarse").isin(coarse)).where(F.col("cell").between(min(cells), max(cells)))
    return rows.select(index.id_col, "_v", "cell")


def search_ivf(index: IvfIndex, queries: DataFrame, k: int = 20, nprobe: int | None = None, query_vec: str = "query_vector") -> DataFrame:
    """(query_id, id, distance, cell, rank): approximate top k by cosine distance through the ``nprobe``
    nearest cells (default: as tuned, else all). Probing all cells is the exact search. Questions
    without a vector, or of another length than the index, match nothing."""
    nprobe = nprobe or index.nprobe or index.n_cells
    found = []
    for block in blocks_of(queries, query_vec):
        probes, coarse = _probed(index, block, min(nprobe, index.n_cells)) if index.n_cells else ({}, [])
        if probes:
            rows = candidates(index, list(probes), coarse)
            found.append(partial_topk(rows, block, k, "cosine", index.id_col, probes, bounds(rows, block, k, "cosine", index.id_col, probes)))
    if not found:
        schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, `{index.id_col}` long, distance double, cell long, rank int"
        return index.spark.createDataFrame([], schema)
    return topk(reduce(DataFrame.unionByName, found), k, index.id_col)


def tune(index: IvfIndex, queries: DataFrame, k: int = 20, least: float = RECALL, sample: int = RECALL_SAMPLE,
         query_vec: str = "query_vector") -> int:
    """Store and return the least ``nprobe`` whose mean recall of the exact top ``k`` is ``least`` or
    more, counted over all questions or, of more than ``sample``, over that many by least hash; then
    the recall less three standard errors has to reach it."""
    if not index.n_cells:
        return 1
    q = queries.select("query_id", F.col(query_vec).cast("array<double>").alias("_q")).where(F.size("_q") == index.dim)
    q = q.orderBy(F.xxhash64("query_id"), "query_id").limit(sample + 1).toArrow()
    whole = q.num_rows <= sample
    q = index.spark.createDataFrame(q.slice(0, sample).rename_columns(["query_id", "query_vector"]))   # Arrow: no conversion by the session's settings
    exact = search_ivf(index, q, k, index.n_cells).select("query_id", "cell").toArrow()
    hits: dict = {}
    for query, cell in zip(exact["query_id"].to_pylist(), exact["cell"].to_pylist()):
        hits.setdefault(query, []).append(cell)
    if not hits:
        return index.n_cells
    # place of each hit's cell among the question's nearest: centroids that are nearer (or as near with a smaller number)
    block = blocks_of(q)[0]
    ids, vectors = block.ids.to_pylist(), block.groups[0][1]
    wanted = sorted({c for cells in hits.values() for c in cells})
    own = index.centroids().where(F.col("cell").isin(wanted)).select("cell", "centroid").toArrow()   # at most sample x k
    at = {c: i for i, c in enumerate(own["cell"].to_pylist())}
    far = np.round(cosine(vectors, matrix(own["centroid"].combine_chunks(), index.dim)), 9)
    pairs = [(i, at[c], c) for i, query in enumerate(ids) for c in hits.get(query, [])]
    row, limit = np.array([p[0] for p in pairs]), np.array([far[p[0], p[1]] for p in pairs])
    cell, dim = np.array([p[2] for p in pairs]), index.dim

    def nearer(batches):
        n = np.zeros(len(row), np.int64)
        for b in batches:
            d = np.round(cosine(vectors, matrix(b.column(1), dim)), 9)
            number = b.column(0).to_numpy()
            for j in range(len(number)):
                n += (d[row, j] < limit) | ((d[row, j] == limit) & (number[j] < cell))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(row))), pa.array(n)], names=["pair", "n"])

    counted = index.centroids().select("cell", "centroid").mapInArrow(nearer, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    place = np.zeros(len(row), np.int64)
    place[counted["pair"].to_numpy()] = counted["n"].to_numpy()
    found = np.zeros((len(ids), index.n_cells))
    np.add.at(found, (row, place), 1)
    asked = found.sum(axis=1) > 0
    share = np.cumsum(found[asked], axis=1) / found[asked].sum(axis=1, keepdims=True)
    mean = share.mean(axis=0)
    if not whole:
        mean = mean - 3 * share.std(axis=0) / math.sqrt(len(share))
    nprobe = int(np.argmax(mean >= least)) + 1   # with all cells probed every share is 1
    versions.replace(index.spark.createDataFrame([(nprobe, float(share.mean(axis=0)[nprobe - 1]), k)], "nprobe int, recall double, k int").coalesce(1),
                     f"{index.folder}/probes")
    return nprobe


def recall(approx: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Per query: share of the exact top-k found by the approximate search."""
    hit = exact.join(approx.select("query_id", id_col), ["query_id", id_col], "left_semi")
    e = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("k"))
    h = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    return e.join(h, "query_id", "left").select("query_id", F.round(F.coalesce(F.col("hits"), F.lit(0)) / F.col("k"), 9).alias("recall"))
