"""Merkle manifest of a dataset, kept as aligned blocks in van Emde Boas order.

Each row is a leaf: the SHA-256 of its fields, every field as ``-`` if null, else its UTF-8 byte
count, ``:`` and its value. The leaves of a group (``lang``) ascend by id; every two consecutive
nodes become the hash of their hex texts, a last single node the hash of its own, until one node
is left, the group's subroot. Subroots ascend by group (null first, UTF-8 bytewise) and are
combined in the same way to the root.

Storage: a tree is cut into aligned blocks of ``BLOCK_LEVELS`` levels above 256 leaves. A block is
one row that holds its subtree in van Emde Boas order: the tree is split at half its height, the
top half is stored first, the bottom trees follow one after the other, each split in the same way.
``addresses`` computes a node's place from its depth and index; building a block and reading a
leaf's siblings both go through it. The roots of the blocks of one tier are the leaves of the
next, until a group has a single block; so a tier is one grouping of bounded groups of 256, and
a manifest of N leaves has log(N) / 8 tiers.

Rows: a null group is a group of its own (before the empty name). A null id sorts first in its
group. Rows with one id are ordered by their leaf; whole rows that repeat are leaves of their own.
An empty table has no blocks, no root and no proofs. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.joins import hot_key_join
from ..operators.mixing import consecutive_index
from ..session import scratch_path

BLOCK_LEVELS = 8
_BLOCK = 1 << BLOCK_LEVELS
_FOREST = "forest"

_BLOCK_TYPE = "grp string, block long, n_leaves int, height int, alone boolean, nodes binary, ids array<long>, claims array<binary>"
_ABOVE_TYPE = "grp string, block long, above binary, subroot binary, root binary"
_PROOF_TYPE = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, n_siblings int"


def record_digest(columns: list[str], changed: dict[str, Column] | None = None) -> Column:
    """SHA-256 (binary) of the fields of a row; ``changed`` replaces some of them."""
    parts = []
    for c in columns:
        value = (changed or {}).get(c, F.col(c)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def addresses(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places in van Emde Boas order of nodes ``index`` at ``depth`` in a full tree of ``levels`` levels."""
    index = np.asarray(index, dtype=np.int64)
    if levels == 1:
        return np.zeros(len(index), np.int64)
    top = levels // 2
    if depth < top:
        return addresses(top, depth, index)
    bottom, within = levels - top, depth - top
    tree = index >> within
    first = (1 << top) - 1 + tree * ((1 << bottom) - 1)
    return first + addresses(bottom, within, index - (tree << within))


def node_hash(*nodes: bytes) -> bytes:
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def block_nodes(leaves: list[bytes], height: int) -> bytes:
    """The subtree over ``leaves`` (at most 2 ** height) in van Emde Boas order; absent nodes are zeros."""
    out = np.zeros(((2 << height) - 1, 32), np.uint8)
    row = leaves
    for up in range(height + 1):
        at = addresses(height + 1, height - up, np.arange(len(row)))
        out[at] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, 32)
        row = [node_hash(*row[i:i + 2]) for i in range(0, len(row), 2)]
    return out.tobytes()


def sibling_paths(nodes: bytes, n_leaves: int, height: int) -> list[bytes]:
    """For each leaf of a block its siblings from the bottom up: per level a byte (0 none, 1 left of
    the path, 2 right of it) and the sibling's digest."""
    leaf, size, paths = np.arange(n_leaves), n_leaves, [[] for _ in range(n_leaves)]
    for up in range(height):
        sibling = (leaf >> up) ^ 1
        at = addresses(height + 1, height - up, np.minimum(sibling, size - 1))
        for path, s, a in zip(paths, sibling.tolist(), at.tolist()):
            path.append(b"\0" if s >= size else (b"\2" if s & 1 else b"\1") + nodes[32 * a: 32 * a + 32])
        size = (size + 1) // 2
    return [b"".join(p) for p in paths]


def steps_of(path: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(path):
        side = path[at]
        out.append((side, path[at + 1: at + 33] if side else b""))
        at += 33 if side else 1
    return out


def fold(leaf: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for side, digest in steps:
        leaf = node_hash(leaf) if side == 0 else node_hash(digest, leaf) if side == 1 else node_hash(leaf, digest)
    return leaf


def _build(rows: pa.Table) -> pa.Table:
    """One block of a tier from its rows (at most 256)."""
    order = np.argsort(rows["pos"].to_numpy(), kind="stable")
    rows = rows.take(pa.array(order))
    n, total = rows.num_rows, rows["total"][0].as_py()
    alone = total <= _BLOCK
    height = max(n - 1, 0).bit_length() if alone else BLOCK_LEVELS
    return pa.table({
        "grp": rows["grp"][:1].combine_chunks(), "block": rows["block"][:1].combine_chunks(),
        "n_leaves": pa.array([n], pa.int32()), "height": pa.array([height], pa.int32()), "alone": pa.array([alone]),
        "nodes": pa.array([block_nodes(rows["digest"].to_pylist(), height)], pa.binary()),
        "ids": pa.array([rows["id"].to_pylist()], pa.list_(pa.int64())),
        "claims": pa.array([rows["claim"].to_pylist()], pa.list_(pa.binary()))})


def _descend(block: pa.Table, above: pa.Table) -> pa.Table:
    """Siblings up to the root for each child block of one block."""
    out = {"grp": [], "block": [], "above": [], "subroot": [], "root": []}
    for b, a in zip(block.to_pylist(), above.to_pylist()):
        paths = sibling_paths(b["nodes"], b["n_leaves"], b["height"])
        out["grp"] += [b["grp"]] * len(paths)
        out["block"] += [b["block"] * _BLOCK + i for i in range(len(paths))]
        out["above"] += [p + a["above"] for p in paths]
        out["subroot"] += [a["subroot"]] * len(paths)
        out["root"] += [a["root"]] * len(paths)
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})


def _prove(block: pa.Table, above: pa.Table) -> pa.Table:
    """Proof, and the root folded from the claimed leaf, of each leaf of one block."""
    out: dict[str, list] = {k: [] for k in ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "n_siblings")}
    for b, a in zip(block.to_pylist(), above.to_pylist()):
        n, height, nodes = b["n_leaves"], b["height"], b["nodes"]
        place = addresses(height + 1, height, np.arange(n)).tolist()
        upper = steps_of(a["above"])
        upper_hex = "".join(d.hex() for _, d in upper)
        n_upper = sum(side > 0 for side, _ in upper)
        folded: dict[bytes, str] = {}   # roots above this block, by the block root they start from
        for i, path in enumerate(sibling_paths(nodes, n, height)):
            leaf = nodes[32 * place[i]: 32 * place[i] + 32]
            steps = steps_of(path)
            top = fold(leaf if b["claims"][i] is None else b["claims"][i], steps)
            if top not in folded:
                folded[top] = fold(top, upper).hex()
            out["id"].append(b["ids"][i])
            out["leaf"].append(leaf.hex())
            out["proof_sha256"].append(hashlib.sha256(("".join(d.hex() for _, d in steps) + upper_hex).encode()).hexdigest())
            out["folded_root"].append(folded[top])
            out["n_siblings"].append(n_upper + sum(side > 0 for side, _ in steps))
        out["subroot"] += [a["subroot"].hex()] * n
        out["root"] += [a["root"].hex()] * n
    kinds = (pa.int64(), *[pa.string()] * 5, pa.int32())
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})


@dataclass
class Manifest:
    """Written tiers: of the groups' trees, and of the tree over their subroots."""

    spark: SparkSession
    path: str
    tiers: list[str] = field(default_factory=list)
    forest: list[str] = field(default_factory=list)

    def read(self, tier: str) -> DataFrame:
        return self.spark.read.schema(_BLOCK_TYPE).parquet(tier)

    def subroots(self) -> DataFrame:
        """(grp, digest, tier) of every group: the root of its only block in its last tier."""
        each = [self.read(t).where("alone").select("grp", F.substring("nodes", 1, 32).alias("digest"), F.lit(i).alias("tier"))
                for i, t in enumerate(self.tiers)]
        out = each[0]
        for df in each[1:]:
            out = out.unionByName(df)
        return out


def _climb(spark: SparkSession, rows: DataFrame, path: str, name: str) -> list[str]:
    """Write the tiers over ``rows`` (grp, pos, total, digest, id, claim) until each group has one block."""
    tiers: list[str] = []
    while True:
        tier = f"{path}/{name}-{len(tiers)}"
        cut = rows.withColumn("block", F.shiftright("pos", BLOCK_LEVELS))
        (cut.groupBy("grp", "block").applyInArrow(_build, _BLOCK_TYPE).write.mode("overwrite").parquet(tier))
        tiers.append(tier)
        done = spark.read.schema(_BLOCK_TYPE).parquet(tier).where("NOT alone")
        if done.isEmpty():
            return tiers
        above = done.select("grp", F.col("block").alias("pos"), F.substring("nodes", 1, 32).alias("digest"))
        totals = above.groupBy("grp").agg(F.count(F.lit(1)).alias("total"))
        rows = (hot_key_join(above, totals, ["grp"], salt_by=["pos"])
                .withColumn("id", F.lit(None).cast("long")).withColumn("claim", F.lit(None).cast("binary")))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows (grp, id, digest, claim, tie) with ``pos`` in their group and the group's ``total``."""
    ranged = consecutive_index(rows, ["grp", "id", "digest", "tie"], name="at").drop("tie")
    groups = ranged.groupBy("grp").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("total"))
    return hot_key_join(ranged, groups, ["grp"], salt_by=["at"]).select(
        "grp", (F.col("at") - F.col("first")).alias("pos"), "total", "digest", "id", "claim")


def write_manifest(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", group_col: str = "lang",
                   columns: list[str] | None = None, claim: Column | None = None) -> Manifest:
    """Hash ``columns`` of every row and write the manifest under ``path`` (default: shared scratch).

    ``claim``: a leaf digest (binary, null for none) that somebody claims for a row; ``proofs`` folds
    it in the leaf's place. The leaves are written once, so the texts are read in a single scan and
    only digests are sorted, shuffled and numbered.
    """
    spark = rows.sparkSession
    path = path or scratch_path(spark, f"merkle-{uuid.uuid4().hex}")
    grp = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaves = rows.select(grp.alias("grp"), F.col(id_col).cast("long").alias("id"),
                         record_digest(columns or sorted(rows.columns)).alias("digest"),
                         (F.lit(None).cast("binary") if claim is None else claim).alias("claim"),
                         F.monotonically_increasing_id().alias("tie"))
    leaves.write.mode("overwrite").parquet(f"{path}/leaves")
    out = Manifest(spark, path)
    out.tiers = _climb(spark, _numbered(spark.read.parquet(f"{path}/leaves")), path, "tier")
    roots = out.subroots().select(F.lit(_FOREST).alias("grp"), F.lit(None).cast("long").alias("id"), F.col("grp").alias("name"),
                                  "digest", F.lit(None).cast("binary").alias("claim"))
    roots.write.mode("overwrite").parquet(f"{path}/subroots")
    at = consecutive_index(spark.read.parquet(f"{path}/subroots"), ["name"], name="pos")
    total = at.agg(F.count(F.lit(1)).alias("total"))
    at.crossJoin(F.broadcast(total)).drop("claim").write.mode("overwrite").parquet(f"{path}/subroot-order")
    order = spark.read.parquet(f"{path}/subroot-order")
    out.forest = _climb(spark, order.withColumn("claim", F.lit(None).cast("binary")).drop("name"), path, "forest")
    return out


def proofs(manifest: Manifest) -> DataFrame:
    """One row per leaf: id, leaf, subroot, root, ``proof_sha256`` (of the siblings' hex texts from the
    leaf to the root), ``folded_root`` (from the claimed leaf, else its own) and ``n_siblings``.

    Siblings above a block are found once per block, from the last tier down.
    """
    spark = manifest.spark
    forest = manifest.read(manifest.forest[-1])
    root = F.substring("nodes", 1, 32)
    above = forest.select("grp", "block", F.lit(b"").alias("above"), root.alias("subroot"), root.alias("root"))
    for tier in reversed(manifest.forest):
        above = _down(manifest.read(tier), above, _descend, _ABOVE_TYPE)
    order = spark.read.parquet(f"{manifest.path}/subroot-order").select(F.col("name").alias("grp"), F.col("pos").alias("block"), "digest")
    places = above.select("block", "above", "root").join(order, "block").select("grp", "above", F.col("digest").alias("subroot"), "root")
    entry = manifest.subroots().select("grp", "tier").join(places, "grp").withColumn("block", F.lit(0).cast("long"))
    path = f"{manifest.path}/entries-{uuid.uuid4().hex}"
    entry.write.parquet(path)
    entry = spark.read.parquet(path)
    above = None
    for i in reversed(range(len(manifest.tiers))):
        here = entry.where(F.col("tier") == i).select("grp", "block", "above", "subroot", "root")
        above = here if above is None else above.unionByName(here)
        kind = (_prove, _PROOF_TYPE) if i == 0 else (_descend, _ABOVE_TYPE)
        above = _down(manifest.read(manifest.tiers[i]), above, *kind)
    return above


def _down(blocks: DataFrame, above: DataFrame, step, kind: str) -> DataFrame:
    return blocks.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(step, kind)
