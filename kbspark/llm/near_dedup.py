"""Near-duplicate documents by DartMinHash signatures and a banded join.

A document is the multiset of its word five-grams (lower case, blank-separated; a shorter text is
one gram), weight = number of occurrences. For every gram, hashed darts are thrown at the plane
(weight x rank), one region at a time: regions double in weight and in rank, each holds a Poisson
number of darts set by the hash of (gram, region), and a dart counts if its weight coordinate is
under the gram's weight. A dart's hash names one of ``k`` coordinates; the earliest dart (least
rank) of each coordinate is the signature. The rank limit of a document is t / total weight with
t = k ln k + 2k, so it takes about t darts however long it is; it is doubled for documents with an
empty coordinate. Two documents agree in a coordinate with the probability of their weighted
Jaccard similarity.

Signatures are cut into bands of ``rows`` coordinates; documents with an equal band form a
bucket. Exact copies are collapsed first. A bucket names pairs to compare by its members' sketches
(one byte per coordinate): the member nearest to the bucket's commonest sketch leads, and each
member the leader resembles is a pair with it, named in the first band that the two share; members
that no leader resembles lead in turn. So the pairs grow with the members, not with their square. A
bucket of more than ``BUCKET`` members is dealt into parts of about that size, differently in each
band, and the leaders of its parts are dealt and led again, level by level, until they fit one part
or no longer get fewer. Pairs are compared by their exact similarity, and those that reach it link
members into groups.

That finds most links at a cost that grows with the members; the rest is found by comparing
all pairs of a bucket whose members are in different groups. A bucket goes in blocks of at most
about two times ``BLOCK`` members. Of a block stay the members of pairs whose sketches agree in at
least as many coordinates as ``SIGMAS`` standard errors under the similarity, each pair in the
first band that it shares (32 bits of every band's hash travel with a member); the similarities of all pairs of those are counted exactly. Two members
of a bucket's largest group need no comparison, so a bucket that is one group, or nearly, stays
cheap. Classes are the connected components of all links.

Null and empty texts have no grams and are classes of their own. Repeated rows are copies.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .arrow_words import BLANK_SEPARATED, U64, Words, combine, mix, slices, split_words
from .components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
BUCKET = 500
RESEMBLES, LED = 0.65, 0.7   # estimated similarity that makes a pair, and that spares a member from leading
BLOCK, SIGMAS = 1000, 5
GRAMS_AT_ONCE = 4096   # columns of a block's incidence matrix
BROADCAST_IDS = 1_000_000   # of 8 bytes each
_FINEST = 2.0 ** -6         # height of the lowest rank region


def _grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, gram, occurrence number within the document from 0), in document order."""
    n = words.counts()
    gram, ok = words.windows(k)
    short = np.flatnonzero((n > 0) & (n < k))
    whole = mix(words.hash[words.first[short]] + U64(1))
    for j in range(1, k):
        more = np.flatnonzero(n[short] > j)
        whole[more] = combine(whole[more], words.hash[words.first[short[more]] + j])
    doc = np.concatenate([words.doc()[ok], short])
    gram = np.concatenate([gram[ok], whole])
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, np.int64)
    times = np.diff(np.r_[new, len(doc)])
    return doc, gram, np.arange(len(doc)) - np.repeat(new, times)


def _poisson_steps(mean: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson number, up to where doubles end."""
    top = int(mean + 12 * math.sqrt(mean) + 24)
    i = np.arange(top + 1)
    return np.cumsum(np.exp(i * math.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(i[1:]))])))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> U64(11)).astype(np.float64) * 2.0 ** -53


def dart_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Signatures (n_docs x k, uint64) of weighted sets given as (document, element hash, weight);
    documents without elements get zeros. Every weight must be positive."""
    total = np.bincount(doc, weight, n_docs)
    alive = total > 0
    limit = np.full(n_docs, 0.0)
    limit[alive] = (k * math.log(k) + 2 * k) / total[alive]
    best = np.full(n_docs * k, np.inf)
    name = np.zeros(n_docs * k, U64)
    low, high, step = 0.0, _FINEST, 0
    todo = alive.copy()
    while todo.any():
        use = np.flatnonzero(todo[doc])
        v = 0
        while len(use):   # weight regions [2^v - 1, 2^(v+1) - 1)
            seed = combine(element[use], np.full(1, (step << 8) + v, U64))
            n = np.searchsorted(_poisson_steps(2.0 ** v * (high - low)), _unit(seed), side="right")
            at = np.repeat(use, n)
            dart = combine(np.repeat(seed, n), (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)).astype(U64))
            rank = low + (high - low) * _unit(dart)
            over = 2.0 ** v - 1 + 2.0 ** v * _unit(mix(dart + U64(1)))
            in_set = over < weight[at]
            at, dart, rank = at[in_set], dart[in_set], rank[in_set]
            cell = doc[at] * np.int64(k) + (mix(dart + U64(2)) % U64(k)).astype(np.int64)
            np.minimum.at(best, cell, rank)
            first = rank == best[cell]
            name[cell[first]] = mix(dart[first] + U64(3))
            v += 1
            use = use[weight[use] > 2.0 ** v - 1]
        low, high, step = high, high * 2, step + 1
        passed = todo & (limit <= low)
        short = passed & np.isinf(best.reshape(n_docs, k)).any(axis=1)
        limit[short] *= 2   # an empty coordinate: throw on
        todo &= ~passed | (short & (limit > low))
        todo |= short
    return name.reshape(n_docs, k)


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """(id, copy: digest of the lower-case text, bands: array of band hashes or null without words,
    sketch: the low byte of every coordinate, keys: the low 32 bits of every band hash)."""
    k = bands * rows

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column("text"), 2 << 20):
                for c in range(a, b, 1000):
                    part = batch.slice(c, min(1000, b - c))
                    words = split_words(part.column("text"), BLANK_SEPARATED)
                    doc, gram, nth = _grams(words, shingle)
                    new = np.flatnonzero(nth == 0)
                    weight = np.diff(np.r_[new, len(doc)]).astype(np.float64)
                    sig = dart_minhash(doc[new], gram[new], weight, words.n_docs, k).reshape(-1, bands, rows)
                    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64)), (words.n_docs, bands))
                    for r in range(rows):
                        h = combine(h, sig[:, :, r])
                    flat = pa.array(np.ascontiguousarray(h).view(np.int64).ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(words.n_docs + 1) * bands, pa.int32()), flat)
                    empty = pa.array(words.counts() == 0)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), part.column("copy"), pc.if_else(empty, pa.scalar(None, lists.type), lists),
                         pa.array([x.tobytes() for x in sig.reshape(-1, k).astype(np.uint8)], pa.binary()),
                         pa.array([x.tobytes() for x in h.astype(np.uint32)], pa.binary())],
                        names=["id", "copy", "bands", "sketch", "keys"])

    text = F.lower(F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.md5(text).alias("copy")).mapInArrow(
        run, "id long, copy string, bands array<long>, sketch binary, keys binary")


def _small(ids: DataFrame) -> DataFrame:
    """``ids`` to be broadcast if there are at most ``BROADCAST_IDS``; else Spark shuffles both sides."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _gram_sets(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, grams: sorted 64-bit hashes of (gram, occurrence) as bytes) of the documents in ``ids``."""
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(_small(ids), "id", "left_semi")
    # rows that repeat an id would double its pairs
    if not chosen.groupBy("id").count().where("count > 1").isEmpty():
        chosen = chosen.dropDuplicates(["id"])

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                words = split_words(part.column("text"), BLANK_SEPARATED)
                doc, gram, nth = _grams(words, shingle)
                one = combine(gram, nth.astype(U64))
                order = np.lexsort((one, doc))
                one, stop = one[order], np.cumsum(np.bincount(doc, minlength=words.n_docs))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([one[s - n: s].tobytes() for s, n in zip(stop, np.diff(np.r_[0, stop]), strict=True)], pa.binary())],
                    names=["id", "grams"])

    return chosen.select("id", F.lower("text").alias("text")).mapInArrow(run, "id long, grams binary")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose weighted Jaccard similarity reaches ``similarity``, exactly."""
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("a"), batch.column("b"), strict=True)):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                if min(len(x), len(y)) >= similarity * max(len(x), len(y)):
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    same = int((both[1:] == both[:-1]).sum())
                    keep[i] = same >= similarity * (len(x) + len(y) - same) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep))

    a = sets.select(F.col("id").alias("u"), F.col("grams").alias("a"))
    b = sets.select(F.col("id").alias("v"), F.col("grams").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _first_band(keys: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Number of the first band that ``keys`` shares with each row of ``others`` (0 if none)."""
    return (others == keys).argmax(axis=1)


def bucket_pairs(ids: np.ndarray, sketch: np.ndarray, keys: np.ndarray, pos: int) -> tuple[list[tuple[int, int]], list[int]]:
    """(pairs of members to compare, places of the leaders) of one bucket of band number ``pos``,
    members sorted by id."""
    n, k = sketch.shape
    pairs = set()
    common = np.array([np.bincount(c, minlength=256).argmax() for c in sketch.T], np.uint8)
    free, leaders = np.ones(n, bool), []
    for i in np.argsort(-(sketch == common).sum(axis=1), kind="stable").tolist():
        if free[i]:
            same = np.count_nonzero(sketch == sketch[i], axis=1)
            free &= same < LED * k
            free[i] = False
            leaders.append(i)
            near = np.flatnonzero(same >= RESEMBLES * k)
            near = near[(near != i) & (_first_band(keys[i], keys[near]) == pos)]
            pairs.update((min(i, j), max(i, j)) for j in near.tolist())
    return [(int(ids[i]), int(ids[j])) for i, j in pairs], leaders


def _named(members: DataFrame) -> DataFrame:
    """``bucket_pairs`` of each (band, part): rows (u, v, band: null) of pairs and, where the bucket has
    other parts, (u, null, band) of leaders. Rows of a partition come sorted, so a part is a run of
    them; one part is in memory at a time."""
    def run(batches):
        for (band, _), (pos, rep, sketch, keys, parts) in _runs(batches, 2):
            if len(rep) > 1 or parts[0] > 1:
                ids = np.array(rep)
                table = lambda x, kind: np.frombuffer(b"".join(x), kind).reshape(len(x), -1)
                pairs, leaders = bucket_pairs(ids, table(sketch, np.uint8), table(keys, np.uint32), pos[0])
                out = [(u, v, None) for u, v in pairs] + [(int(ids[i]), None, band) for i in leaders if parts[0] > 1]
                if out:
                    yield _pair_batch(out)

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (members.repartition(n, "band", "part").sortWithinPartitions("band", "part", "rep")
            .select("band", "part", "pos", "rep", "sketch", "keys", "parts").mapInArrow(run, "u long, v long, band long"))


def _dealt(found: DataFrame, bucket: int, level: int) -> DataFrame:
    """``found`` (band, rep, ...) with its part of about ``bucket`` members and the number of parts."""
    sizes = found.groupBy("band").agg(F.ceil(F.count("*") / bucket).alias("parts")).where("parts > 0")
    return found.drop("parts", "part").join(sizes, "band").withColumn("part", F.pmod(F.xxhash64("rep", "band", F.lit(level)), F.col("parts")))


def _pair_batch(rows: list[tuple]) -> pa.RecordBatch:
    u, v, band = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(band, pa.int64())], names=["u", "v", "band"])


def _runs(batches, keys: int):
    """(key, columns) of each run of rows that agree in the first ``keys`` columns."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if held:
                    yield key, list(zip(*held, strict=True))
                held, key = [], row[:keys]
            held.append(row[keys:])
    if held:
        yield key, list(zip(*held, strict=True))


def _by_block(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """(band, lo, hi, side, pos, rep, comp, sketch, keys): the members of every two parts ``lo`` <= ``hi`` of
    a bucket of several groups. A large bucket's largest group has parts of its own, which do not meet."""
    groups = members.groupBy("band", "comp").agg(F.count("*").alias("c"))
    total = groups.groupBy("band").agg(F.sum("c").alias("n"), F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("groups"))
    total = total.where("groups > 1").select(
        "band", F.col("top.comp").alias("main"), (F.col("n") > block).alias("parted"),
        F.ceil((F.col("n") - F.col("top.c")) / block).alias("others"), F.ceil(F.col("top.c") / block).alias("mains"))
    rows = members.join(total, "band")
    deal, is_main = F.xxhash64("rep", "band"), F.col("comp") == F.col("main")
    rows = rows.withColumn("side", F.when(~F.col("parted"), F.lit(0)).when(is_main, F.col("others") + F.pmod(deal, F.col("mains")))
                           .otherwise(F.pmod(deal, F.col("others"))).cast("long"))
    meets = F.when(~F.col("parted"), F.lit(0)).when(is_main, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), meets.cast("long"))))
    return rows.select("band", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "pos", "rep", "comp", "sketch", "keys")


def _possible(blocks: DataFrame, least: float) -> DataFrame:
    """(band, lo, hi, side, rep, comp) of the members of a block that are in a pair of two groups whose
    sketches agree in ``least`` coordinates or more, and in no band before this one."""
    def run(batches):
        for (band, lo, hi), (side, pos, rep, comp, sketch, keys) in _runs(batches, 3):
            side, comp = np.array(side), np.array(comp)
            sketch, keys = (np.frombuffer(b"".join(x), kind).reshape(len(rep), -1) for x, kind in ((sketch, np.uint8), (keys, np.uint32)))
            right = np.flatnonzero(side == hi)
            hit = np.zeros(len(rep), bool)
            for i in np.flatnonzero(side == lo).tolist():
                at = right[comp[right] != comp[i]]
                near = np.count_nonzero(sketch[at] == sketch[i], axis=1) >= least
                if near.any():
                    first = _first_band(keys[i], keys[at[near]]) == pos[0]
                    hit[at[near][first]] = True
                    hit[i] |= first.any()
            if hit.any():
                n = int(hit.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x] * n, pa.int64()) for x in (band, lo, hi)]
                    + [pa.array(x[hit], pa.int64()) for x in (side, np.array(rep), comp)], names=["band", "lo", "hi", "side", "rep", "comp"])

    return _by_block(blocks).mapInArrow(run, "band long, lo long, hi long, side long, rep long, comp long")


def shared_grams(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements every set on the left has in common with every one on the right."""
    ends = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    one, other = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(one, other)
    out = np.zeros((len(left), len(right)), np.float64)
    for a in range(0, len(both), GRAMS_AT_ONCE):
        some = both[a:a + GRAMS_AT_ONCE]
        held = []
        for sets, owner, grams in ((left, ends[0], one), (right, ends[1], other)):
            at = np.minimum(np.searchsorted(some, grams), len(some) - 1)
            ok = some[at] == grams
            m = np.zeros((len(sets), len(some)), np.float32)
            m[owner[ok], at[ok]] = 1
            held.append(m)
        out += held[0] @ held[1].T
    return out


def _links(possible: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): groups that a pair of members of one block links, by their exact similarity."""
    def run(batches):
        for (_, lo, hi), (side, comp, grams) in _runs(batches, 3):
            side, comp = np.array(side), np.array(comp)
            grams = [np.frombuffer(g, U64) for g in grams]
            size = np.array([len(g) for g in grams])
            a, b = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
            if len(a) and len(b):
                same = shared_grams([grams[i] for i in a], [grams[i] for i in b])
                x, y = np.nonzero((same >= similarity * (size[a][:, None] + size[b] - same) - 1e-9) & (comp[a][:, None] != comp[b]))
                if len(x):
                    pairs = np.unique(np.sort(np.stack([comp[a[x]], comp[b[y]]], axis=1), axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    rows = possible.join(sets, possible["rep"] == sets["id"]).select("band", "lo", "hi", "side", "comp", "grams")
    return _by_block(rows).mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                    bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, class_id (least id of its class), copy_id (least id among
    its exact copies). Rows with a null id are classes of their own, with null ids."""
    sig = materialize(signatures(docs, id_col, text_col, bands, rows, shingle))
    known = sig.where("bands IS NOT NULL AND id IS NOT NULL")
    # one row per text, combined before the shuffle: a text with very many copies is one row per task
    first = known.groupBy("copy").agg(F.min(F.struct("id", "bands", "sketch", "keys")).alias("r"), F.count("*").alias("n"))
    first = materialize(first.select("copy", "n", F.col("r.id").alias("rep"), "r.bands", "r.sketch", "r.keys"))
    groups = first.where("n > 1").select("copy", "rep")
    reps = first.select("rep", "bands", "sketch", "keys").dropDuplicates(["rep"])
    band = reps.select("rep", F.posexplode("bands").alias("pos", "band"))
    sizes = band.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    found = band.join(sizes, "band").select("band", "pos", "rep", F.ceil(F.col("n") / bucket).alias("parts"))
    part = F.pmod(F.xxhash64("rep", "band"), F.col("parts"))
    members = materialize(found.withColumn("part", part).join(reps.select("rep", "sketch", "keys"), "rep"))
    named = materialize(_named(members))
    pairs, level, before = named.where("v IS NOT NULL").select("u", "v"), 0, None
    while (leading := named.where("v IS NULL").count()) and leading != before:   # leaders of several parts meet
        before, level = leading, level + 1
        leaders = named.where("v IS NULL").select("band", F.col("u").alias("rep")).distinct()
        named = materialize(_named(_dealt(members.join(leaders, ["band", "rep"], "left_semi"), bucket, level)))
        pairs = pairs.unionByName(named.where("v IS NOT NULL").select("u", "v"))
    pairs = materialize(pairs.distinct())
    ends = materialize(pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct())
    edges = _similar(pairs, materialize(_gram_sets(docs, id_col, text_col, ends, shingle)), similarity)
    labels = materialize(connected_components(edges).select(F.col("node").alias("copy_id"), "component"))
    # all pairs between the groups so far
    grouped = members.join(labels, members["rep"] == labels["copy_id"], "left").select(
        "band", "pos", "rep", "sketch", "keys", F.coalesce("component", "rep").alias("comp"))
    least = (similarity - SIGMAS * math.sqrt(similarity * (1 - similarity) / (bands * rows))) * bands * rows
    possible = materialize(_possible(_blocks(materialize(grouped), block), least - 1e-9))
    links = possible.limit(0).select(F.col("rep").alias("u"), F.col("comp").alias("v"))
    if not possible.isEmpty():
        ends = materialize(possible.select(F.col("rep").alias("id")).distinct())
        links = _links(possible, _gram_sets(docs, id_col, text_col, ends, shingle), similarity)
    joined = connected_components(links).select(F.col("node").alias("class_id"), F.col("component").alias("joined"))
    copies = sig.join(groups, "copy", "left").select(
        "id", F.when(F.col("bands").isNull() | F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("rep", "id")).alias("copy_id"))
    classes = copies.join(labels, "copy_id", "left").select("id", F.coalesce("component", "copy_id").alias("class_id"), "copy_id")
    return classes.join(joined, "class_id", "left").select("id", F.coalesce("joined", "class_id").alias("class_id"), "copy_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that are not the least id of their class. Of repeated rows
    under one id one stays; rows with a null id all stay."""
    gone = materialize(near_duplicates(docs, id_col, text_col, **options).where("id <> class_id").select(F.col("id").alias("_gone")).distinct())
    kept = docs.join(_small(gone), docs[id_col] == gone["_gone"], "left_anti")
    twice = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    if twice.isEmpty():
        return kept
    one = kept.join(twice, id_col, "left_semi").dropDuplicates([id_col])
    return kept.join(twice, id_col, "left_anti").unionByName(one)
