"""Prefix trie of conversations by truncation peeling.

A conversation is its turns in order; each distinct sequence of first ``d`` turns (role, text) is
a node of depth ``d``. Nodes are found and aggregated from the deepest level up: conversations
that end at a depth are merged with the nodes that survive from the level below, grouped by their
whole sequence so far; every group is a node, gets its figures, loses its last turn and is a
survivor of the next level. One grouping with partial aggregation per level, each level written
once and read by the next.

What moves: texts are hashed where they are read. A sequence is known by two 64-bit sums (exclusive
or) over its turns of hashes of (position, hash of the turn), so positions can be taken together in
any order and no task has to follow a conversation from its first turn. A conversation is cut into
segments of 32 turns; only the segment that is being peeled travels with a node. Where a segment's
start is reached by one conversation alone, everything below is that conversation's own chain: its
nodes are written at once from its rows and enter the peeling as one finished survivor. So the
number of levels is the depth that conversations *share*, not the length of the longest, and one
conversation with a third of all turns is spread like any other rows.

Rows: turns are ordered by ``turn``, null first; rows of one turn number by the hash of (role, text),
repeated rows stay repeated turns. A null role or text is the empty one. Rows without ``conv_id``
belong to no conversation and are left out. An empty table has no nodes, not even a root. Only the
named columns are read.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.joins import bounded_broadcast, hot_key_join
from ..operators.mixing import consecutive_index
from ..session import scratch_path

SEGMENT = 32
#: Conversations above this many turns meet their rows by broadcast: there are at most turns / LONG of them.
LONG = 50_000
#: A digest's text is handed on in pieces of at most so many ids.
PIECE_IDS = 65_536

_PIECE = "depth int, k1 long, k2 long, first long, whole boolean, ids string"
_DIGEST = "depth int, k1 long, k2 long, ends_sha256 string"
_FIGURES = ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, bytes): texts stay behind."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.substring(F.unhex(F.sha2(key, 256)), 1, 16).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def _with_conversation(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """``rows`` joined to ``convs`` on conv_id; a conversation with very many rows meets them by broadcast."""
    small = bounded_broadcast(convs, 100_000)
    if small is not None:
        return rows.join(small, "conv_id")
    long = F.broadcast(convs.where(F.col("n") > LONG))
    return rows.join(long, "conv_id").unionByName(rows.join(long, "conv_id", "left_anti").join(convs, "conv_id"))


def positioned(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with their ``at`` in one consecutive numbering, conversations as (conv_id, first, n))."""
    ranged = consecutive_index(turns, ["conv_id", "turn", "digest"], name="at")
    return ranged, ranged.groupBy("conv_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))


def rebuilt_turns(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(rows (conv_id, p, digest, bytes), conversations (conv_id, length)) of the rebuilt conversations:
    the first h turns of conversation c - c % family, then c's own after its first h; h = crc32(c) % heads."""
    ranged, convs = positioned(turns)
    convs = _write_once(convs)
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = (convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(base, "base", "left")
            .withColumn("h", F.when(F.col("base") == F.col("conv_id"), F.lit(0)).otherwise(h).cast("long"))
            .select("conv_id", "first", "n", "h", F.least(F.col("h"), F.coalesce("n_base", F.lit(0))).alias("head")))
    plan = _write_once(plan)
    here = _with_conversation(ranged, plan).withColumn("i", F.col("at") - F.col("first"))
    own = here.where("i >= h").select("conv_id", (F.col("head") + F.col("i") - F.col("h")).alias("p"), "digest", "bytes")
    lent = (here.where((F.col("conv_id") % family == 0) & (F.col("i") < heads - 1))
            .select(F.explode(F.sequence(F.col("conv_id") + 1, F.col("conv_id") + family - 1)).alias("conv_id"), "i", "digest", "bytes")
            .join(plan.select("conv_id", "head"), "conv_id").where("i < head")
            .select("conv_id", F.col("i").alias("p"), "digest", "bytes"))
    return own.unionByName(lent), plan.select("conv_id", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def segments(rows: DataFrame) -> DataFrame:
    """(conv_id, seg, s1, s2, path): at most 32 turns each as (k1, k2, bytes), the keys of the prefixes
    that they end; s1, s2 is the key of the prefix before the segment (0 for the root)."""
    lanes = rows.select("conv_id", "p", "bytes", F.floor(F.col("p") / SEGMENT).cast("long").alias("seg"),
                        F.xxhash64(F.lit(1), "p", "digest").alias("x1"), F.xxhash64(F.lit(2), "p", "digest").alias("x2"))
    here = Window.partitionBy("conv_id", "seg").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    local = lanes.select("conv_id", "seg", "p", "bytes", "x1", "x2", F.bit_xor("x1").over(here).alias("k1"), F.bit_xor("x2").over(here).alias("k2"))
    cut = local.groupBy("conv_id", "seg").agg(
        F.array_sort(F.collect_list(F.struct("p", "k1", "k2", "bytes"))).alias("turns"), F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    start = cut.select("conv_id", "seg", "turns", *[F.coalesce(F.bit_xor(f"t{i}").over(before), F.lit(0).cast("long")).alias(f"s{i}") for i in (1, 2)])
    path = F.transform("turns", lambda t: F.struct(t["k1"].bitwiseXOR(F.col("s1")).alias("k1"), t["k2"].bitwiseXOR(F.col("s2")).alias("k2"), t["bytes"].alias("bytes")))
    return start.select("conv_id", "seg", "s1", "s2", path.alias("path"))


def _level(waiting: DataFrame) -> DataFrame:
    """The nodes of one depth: rows (path, s1, s2, figures) grouped by the key of their last turn."""
    last = F.element_at("path", -1)
    rows = waiting.select("path", "s1", "s2", last["k1"].alias("k1"), last["k2"].alias("k2"), *_FIGURES)
    nodes = rows.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("below"), F.sum("saved_tokens").alias("saved"),
        F.first("path").alias("path"), F.first("s1").alias("s1"), F.first("s2").alias("s2"))
    own = (F.col("n_convs") - 1) * F.element_at("path", -1)["bytes"]
    parent = F.get("path", F.size("path") - 2)
    return nodes.select("k1", "k2", F.coalesce(parent["k1"], "s1").alias("p1"), F.coalesce(parent["k2"], "s2").alias("p2"), "path", "s1", "s2",
                        "conv_id", "n_convs", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("below")).alias("n_leaves"),
                        (F.col("saved") + own).alias("saved_tokens"))


def _survivors(nodes: DataFrame) -> DataFrame:
    """The nodes of a level without their last turn: one child each to its parent."""
    return nodes.select(F.slice("path", 1, F.size("path") - 1).alias("path"), "s1", "s2", "conv_id", "n_convs",
                        F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")


def prefix_trie(rows: DataFrame, lengths: DataFrame, path: str | None = None) -> DataFrame:
    """Nodes of the trie over ``rows`` (conv_id, p, digest, bytes; p from 0) and ``lengths`` (conv_id,
    length), turnless conversations included: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (over the subtree, (n_convs - 1) x bytes of each node's last turn)
    and ends_sha256 of the members that end there."""
    spark = rows.sparkSession
    path = path or scratch_path(spark, f"trie-{uuid.uuid4().hex}")
    segments(rows).write.partitionBy("seg").parquet(f"{path}/segments")
    if lengths.isEmpty():
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
                                         "n_leaves long, saved_tokens long, ends_sha256 string")
    lengths.write.parquet(f"{path}/lengths")
    lengths = spark.read.parquet(f"{path}/lengths")
    n_segments = -(-lengths.agg(F.max("length")).first()[0] // SEGMENT)
    zero = F.lit(0).cast("long")
    levels: list[tuple[int, str]] = []
    finished = None
    top: DataFrame | None = None
    if n_segments:
        cut = spark.read.parquet(f"{path}/segments").withColumn("seg", F.col("seg").cast("long"))
        alone = cut.groupBy("seg", "s1", "s2").agg(F.count(F.lit(1)).alias("reach"), F.min("conv_id").alias("only")).where("reach = 1 AND seg > 0")
        alone.select("seg", F.col("only").alias("conv_id")).write.parquet(f"{path}/alone")
        alone = spark.read.parquet(f"{path}/alone")
        own = cut.join(alone, ["seg", "conv_id"], "left_semi")
        finished = own.select("conv_id", "seg", "s1", "s2", F.posexplode("path").alias("at", "turn"), "path").select(
            (F.col("seg") * SEGMENT + F.col("at") + 1).cast("int").alias("depth"), F.col("turn.k1").alias("k1"), F.col("turn.k2").alias("k2"),
            F.coalesce(F.get("path", F.col("at") - 1)["k1"], "s1").alias("p1"), F.coalesce(F.get("path", F.col("at") - 1)["k2"], "s2").alias("p2"),
            "conv_id", F.lit(1).cast("long").alias("n_convs"), F.lit(None).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
            zero.alias("saved_tokens"))
        finished = (finished.join(lengths, "conv_id").withColumn("n_children", (F.col("depth") < F.col("length")).cast("long")).drop("length"))
        entries = alone.groupBy("conv_id").agg(F.min("seg").alias("seg"))
        shared = cut.join(alone, ["seg", "conv_id"], "left_anti").join(lengths, "conv_id").select(
            "*", F.size("path").alias("len"), (F.col("length") == F.col("seg") * SEGMENT + F.size("path")).alias("ended"))
        shared.write.partitionBy("seg").parquet(f"{path}/shared")
        for seg, width in spark.read.parquet(f"{path}/shared").groupBy("seg").agg(F.max("len")).orderBy(F.desc("seg")).collect():
            band = spark.read.parquet(f"{path}/shared").where(F.col("seg") == seg)
            for size in range(width, 0, -1):
                waiting = band.where((F.col("len") == size) & F.col("ended")).select(
                    "path", "s1", "s2", "conv_id", F.lit(1).cast("long").alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"))
                if size == SEGMENT:   # survivors of the segment below, and chains that only one conversation has
                    chains = entries.where(F.col("seg") == seg + 1).select(
                        "conv_id", F.lit(1).cast("long").alias("n_convs"), F.lit(1).cast("long").alias("n_children"),
                        F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"))
                    lower = chains if top is None else chains.unionByName(top.select(*_FIGURES))
                    waiting = waiting.unionByName(band.where((F.col("len") == SEGMENT) & ~F.col("ended")).join(lower, "conv_id").select("path", "s1", "s2", *_FIGURES))
                elif top is not None:
                    waiting = waiting.unionByName(top)
                depth = int(seg) * SEGMENT + size
                _level(waiting).write.parquet(f"{path}/depth-{depth}")
                levels.append((depth, f"{path}/depth-{depth}"))
                top = _survivors(spark.read.parquet(f"{path}/depth-{depth}"))
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    figures = (top if top is not None else lengths.limit(0).select(zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"))).agg(
        F.coalesce(F.sum("n_children"), zero).alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce(F.sum("saved_tokens"), zero).alias("saved_tokens"))
    # one row each: all conversations start at the root
    nodes = root.crossJoin(figures).select(F.lit(0).alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("p1"),
                                           F.lit(None).cast("long").alias("p2"), *_FIGURES)
    for depth, where in levels:
        nodes = nodes.unionByName(spark.read.parquet(where).select(F.lit(depth).alias("depth"), "k1", "k2", "p1", "p2", *_FIGURES))
    if finished is not None:
        nodes = nodes.unionByName(finished)
    nodes.write.parquet(f"{path}/nodes")
    nodes = spark.read.parquet(f"{path}/nodes")
    return _assemble(nodes, _ends(spark, lengths, path, n_segments))


def _ends(spark, lengths: DataFrame, path: str, n_segments: int) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of every node at which conversations end.

    Ids are range partitioned by (node, id), so a node with a third of them lies in many tasks; each
    task joins its ids to pieces of text, and only pieces of nodes that cross tasks are read on in
    order by one task, which holds one piece at a time.
    """
    none = lengths.where("length = 0").select(F.lit(0).alias("depth"), *[F.lit(0).cast("long").alias(k) for k in ("k1", "k2")], "conv_id")
    if n_segments:
        cut = spark.read.parquet(f"{path}/segments")
        last = F.element_at("path", -1)
        ended = cut.join(lengths, "conv_id").where(F.col("length") == F.col("seg") * SEGMENT + F.size("path")).select(
            F.col("length").cast("int").alias("depth"), last["k1"].alias("k1"), last["k2"].alias("k2"), "conv_id")
        none = none.unionByName(ended)
    none.write.parquet(f"{path}/ends")
    keys = ["depth", "k1", "k2"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = spark.read.parquet(f"{path}/ends").repartitionByRange(n, *keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    ranged.mapInArrow(_pieces, _PIECE).write.parquet(f"{path}/pieces")
    pieces = spark.read.parquet(f"{path}/pieces")
    whole = pieces.where("whole").select(*keys, F.sha2("ids", 256).alias("ends_sha256"))
    parts = pieces.where("NOT whole").repartition(*keys).sortWithinPartitions(*keys, "first")
    return whole.unionByName(parts.mapInArrow(_chained, _DIGEST))


def _pieces(batches):
    """Runs of one node's ids as text; ``whole`` where the run neither meets an end of the partition nor is cut."""
    now, ids, cut, first_run = None, [], False, True

    def piece(whole):
        return pa.RecordBatch.from_pydict({
            "depth": pa.array([now[0]], pa.int32()), "k1": pa.array([now[1]], pa.int64()), "k2": pa.array([now[2]], pa.int64()),
            "first": pa.array([ids[0]], pa.int64()), "whole": pa.array([whole]), "ids": pa.array([",".join(map(str, ids))], pa.string())})

    out = []
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("depth", "k1", "k2", "conv_id"))):
            if row[:3] != now:
                if ids:
                    out.append(piece(not first_run and not cut))
                    first_run = False
                now, ids, cut = row[:3], [], False
            elif len(ids) >= PIECE_IDS:
                out.append(piece(False))
                ids, cut = [], True
            ids.append(row[3])
            if len(out) >= 512:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
    if ids:
        out.append(piece(False))
    if out:
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def _chained(batches):
    """SHA-256 over the pieces of each node, in the order they come."""
    now, digest = None, None
    for batch in batches:
        done = []
        for *key, text in zip(*(batch[c].to_pylist() for c in ("depth", "k1", "k2", "ids"))):
            if key != now:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        yield _digests(done)
    if now is not None:
        yield _digests([(*now, digest.hexdigest())])


def _digests(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), ()]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["depth", "k1", "k2", "ends_sha256"])


def _assemble(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Each node with its parent's conv_id and the digest of what ends there."""
    inner = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                                                 F.col("conv_id").alias("parent_conv_id"))
    # a parent may hold a third of all nodes as children
    below = hot_key_join(nodes.where("depth > 0"), inner, ["depth", "p1", "p2"], max_broadcast_rows=50_000, salt_by=["k1"])
    both = below.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = both.join(ends, ["depth", "k1", "k2"], "left")
    nothing: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", *_FIGURES[1:],
                      F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def _write_once(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, f"trie-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
