"""Counting similar documents (O-34, O-48): how many others have at least a given similarity, exactly
verified, with no row per pair.

A document is the set of its word five-grams (normalised text; a shorter text is one gram), the
similarity is the Jaccard similarity of the sets. Documents with one set are one representative
with a weight. Representatives that agree in a band of their MinHash sketch share a bucket; a
bucket is dealt into parts and compared block by block, every two parts in a task. The sketches
say which members of a block have a partner at all; only those meet again with their whole sets,
and a block returns one number per member: the weight of the partners that reach the similarity,
each pair counted in the first band that it shares. Sums of these numbers are the counts.

Two documents at similarity 0.8 share no band with probability 5e-5 (25 bands of 5), and the sketch
test leaves five standard errors. Blocks of a family of m different sets hold m² / ``PART`` rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from kbspark.operators.joins import bounded_broadcast
from kbspark.session import materialize

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
PART, SIGMAS = 250, 5
BATCH_TEXTS, COLUMNS_AT_ONCE = 500, 4096

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _coefficients(n: int) -> np.ndarray:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, size=(2, n), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_sets(texts: list[str], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word ``k``-grams of normalised texts (one blank between words)."""
    known: dict[str, int] = {}
    out = []
    for t in texts:
        words = [w for w in t.split(" ") if w]
        h = np.array([known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words], np.uint64)
        if not len(h):
            out.append(h)
            continue
        n = max(1, len(h) - k + 1)
        gram = np.full(n, len(words) if len(words) < k else k, np.uint64)
        for j in range(min(k, len(h))):
            gram = (gram ^ h[j: j + n]) * _MIX
            gram ^= gram >> np.uint64(29)
        out.append(np.unique(gram))
    return out


def sketches(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash of each set (all not empty): [sets, n] 32-bit numbers."""
    flat, first = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    a, b = _coefficients(n)
    return np.stack([np.minimum.reduceat((flat * a[j] + b[j]) >> np.uint64(32), first) for j in range(n)], axis=1).astype(np.uint32)


def _signatures(docs: DataFrame, id_col: str, text: Column, bands: int, rows: int) -> DataFrame:
    """(id, same: digest of the set, sketch, keys, bands) of the documents that have words."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(lo, BATCH_TEXTS)
                sets = gram_sets(part.column(1).to_pylist())
                some = [i for i, s in enumerate(sets) if len(s)]
                if not some:
                    continue
                sig = sketches([sets[i] for i in some], bands * rows)
                h = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(some), 1))
                for r in range(rows):
                    h = (h ^ sig.reshape(-1, bands, rows)[:, :, r]) * _MIX
                    h ^= h >> np.uint64(31)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * bands, pa.int32()), pa.array(h.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(some)), pa.array([xxhash.xxh128_digest(sets[i].tobytes()) for i in some], pa.binary()),
                    pa.array([x.tobytes() for x in sig.astype(np.uint16)], pa.binary()),
                    pa.array([x.tobytes() for x in h.astype(np.uint32)], pa.binary()), lists], names=["id", "same", "sketch", "keys", "bands"])

    rows_in = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    kind = rows_in.schema["id"].dataType.simpleString()
    return rows_in.mapInArrow(run, f"id {kind}, same binary, sketch binary, keys binary, bands array<long>")


def _grams(docs: DataFrame, id_col: str, text: Column, ids: DataFrame) -> DataFrame:
    """(rep, grams) of the documents in ``ids``."""
    small = bounded_broadcast(ids)
    chosen = docs.select(F.col(id_col).alias("rep"), text.alias("text")).join(ids if small is None else small, "rep", "left_semi").dropDuplicates(["rep"])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(lo, BATCH_TEXTS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in gram_sets(part.column(1).to_pylist())], pa.binary())],
                                                 names=["rep", "grams"])

    return chosen.mapInArrow(run, f"rep {chosen.schema['rep'].dataType.simpleString()}, grams binary")


def _blocks(members: DataFrame, part: int) -> DataFrame:
    """``members`` (band, rep, ...) in blocks (band, lo, hi): every two parts of each bucket once."""
    sizes = members.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts"))
    rows = members.join(sizes, "band").withColumn("side", F.pmod(F.xxhash64("rep", "band"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return rows.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other")).drop("parts", "other")


def _runs(batches, columns: list[str]):
    """(key, columns) of each block: rows come sorted by (band, lo, hi)."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ["band", "lo", "hi", *columns])):
            if row[:3] != key:
                if held:
                    yield key, [list(c) for c in zip(*held)]
                held, key = [], row[:3]
            held.append(row[3:])
    if held:
        yield key, [list(c) for c in zip(*held)]


def _in_blocks(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "rep")


def _table(column: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _sides(side: list[int], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    side = np.array(side)
    return np.flatnonzero(side == lo), np.flatnonzero(side == hi)


def _possible(blocks: DataFrame, least: float) -> DataFrame:
    """(band, lo, hi, side, pos, rep, keys) of the members of a block with a partner by their sketches, in the
    first band that the two share."""
    rep_type = blocks.schema["rep"].dataType.simpleString()

    def run(batches):
        for (band, lo, hi), (side, pos, rep, sketch, keys) in _runs(batches, ["side", "pos", "rep", "sketch", "keys"]):
            left, right = _sides(side, lo, hi)
            sketch, bands = _table(sketch, np.uint16), _table(keys, np.uint32)
            hit = np.zeros(len(rep), bool)
            for i in left.tolist():
                at = right[right > i] if lo == hi else right
                near = at[np.count_nonzero(sketch[at] == sketch[i], axis=1) >= least]
                near = near[(bands[near] == bands[i]).argmax(axis=1) == pos[0]]
                hit[near] = True
                hit[i] |= len(near) > 0
            at = np.flatnonzero(hit).tolist()
            if at:
                pick = lambda c: [c[i] for i in at]
                yield pa.RecordBatch.from_pydict({
                    "band": pa.array([band] * len(at), pa.int64()), "lo": pa.array([lo] * len(at), pa.int64()), "hi": pa.array([hi] * len(at), pa.int64()),
                    "side": pa.array(pick(side), pa.int64()), "pos": pa.array(pick(pos), pa.int32()), "rep": pa.array(pick(rep)), "keys": pa.array(pick(keys), pa.binary())})

    return _in_blocks(blocks).select("band", "lo", "hi", "side", "pos", "rep", "sketch", "keys").mapInArrow(
        run, f"band long, lo long, hi long, side long, pos int, rep {rep_type}, keys binary")


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """[left, right]: how many elements two sets have in common."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, len(both), COLUMNS_AT_ONCE):
        some = both[at:at + COLUMNS_AT_ONCE]
        has = [np.stack([np.isin(some, s, assume_unique=True) for s in sets]).astype(np.float32) for sets in (left, right)]
        out += has[0] @ has[1].T
    return out


def _counts(rows: DataFrame, similarity: float) -> DataFrame:
    """(rep, add): per block and member the weight of its partners at or over ``similarity``."""
    rep_type = rows.schema["rep"].dataType.simpleString()
    num, den = Fraction(similarity).limit_denominator(10_000).as_integer_ratio()   # 0.8 is 4/5, compared exactly

    def run(batches):
        for (_, lo, hi), (side, pos, rep, keys, weight, grams) in _runs(batches, ["side", "pos", "rep", "keys", "weight", "grams"]):
            left, right = _sides(side, lo, hi)
            if not len(left) or not len(right):
                continue
            bands, weight = _table(keys, np.uint32), np.array(weight, np.int64)
            sets = [np.frombuffer(g, np.uint64) for g in grams]
            size = np.array([len(s) for s in sets], np.float64)
            same = shared([sets[i] for i in left], [sets[i] for i in right])
            ok = den * same >= num * (size[left][:, None] + size[right] - same)
            if lo == hi:
                np.fill_diagonal(ok, False)
            x, y = np.nonzero(ok)
            first = (bands[left[x]] == bands[right[y]]).argmax(axis=1) == pos[0]
            x, y = left[x[first]], right[y[first]]
            add = np.bincount(x, weight[y], len(rep))
            if lo != hi:   # within a part both orders of a pair are there already
                add += np.bincount(y, weight[x], len(rep))
            at = np.flatnonzero(add)
            yield pa.RecordBatch.from_arrays([pa.array([rep[i] for i in at.tolist()], pa.array(rep).type), pa.array(add[at].astype(np.int64))], names=["rep", "add"])

    return _in_blocks(rows).select("band", "lo", "hi", "side", "pos", "rep", "keys", "weight", "grams").mapInArrow(run, f"rep {rep_type}, add long")


def similar_importance(docs: DataFrame, text: Column, id_col: str = "document_id", similarity: float = SIMILARITY,
                       bands: int = BANDS, rows: int = ROWS, part: int = PART) -> DataFrame:
    """(id, importance): number of other documents whose set of word five-grams has at least
    ``similarity`` with the document's. ``text``: the normalised text. Documents without words have 0;
    rows without an id have 0 and count for others."""
    sig = materialize(_signatures(docs, id_col, text, bands, rows))
    each = sig.groupBy("same").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), "sketch", "keys", "bands")).alias("r"), F.count(F.lit(1)).alias("weight"))
    reps = materialize(each.select("same", F.col("r.id").alias("rep"), "weight", "r.sketch", "r.keys", "r.bands"))
    band = reps.where("rep IS NOT NULL").select("rep", F.posexplode("bands").alias("pos", "band"))
    shared_bands = band.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    members = materialize(band.join(shared_bands, "band").join(reps.select("rep", "sketch", "keys"), "rep"))
    least = bands * rows * (similarity - SIGMAS * math.sqrt(similarity * (1 - similarity) / (bands * rows)))
    possible = materialize(_possible(_blocks(members, part), least))
    sets = _grams(docs, id_col, text, possible.select("rep").distinct())
    counts = _counts(possible.join(reps.select("rep", "weight"), "rep").join(sets, "rep"), similarity).groupBy("rep").agg(F.sum("add").alias("near"))
    found = reps.join(counts, "rep", "left").select("same", (F.col("weight") - 1 + F.coalesce("near", F.lit(0))).alias("importance")).where("importance > 0")
    # a set that a third of all documents share is one row here: broadcast if small, else split by the adaptive skew join
    mine = sig.select("id", "same").join(found, "same").select(F.col("id").alias(id_col), "importance")
    return docs.select(id_col).join(mine.groupBy(id_col).agg(F.max("importance").alias("importance")), id_col, "left").select(
        id_col, F.coalesce("importance", F.lit(0)).cast("bigint").alias("importance"))
