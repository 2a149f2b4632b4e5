"""Benchmark decontamination by greedy string tiling.

Tokens are lower-case alphanumeric runs (every non-ASCII character counts as a letter). Documents
and benchmark items are joined on the hashes of their ``min_match``-token sequences. A pair whose
shared sequences together cover less than ``threshold`` of the item's tokens cannot reach the
threshold and goes no further. Every other pair is tiled: running Karp-Rabin matching finds the
longest common runs of tokens that no tile covers yet, with a search length that falls from the
longest match down to ``min_match``; each round marks the matches found, longest first. The share
of the item's tokens under tiles is the coverage, so passages count in any order.

The benchmark is read in blocks of at most ``block_bytes`` of text, each broadcast and held
against all documents; there is one block unless the benchmark is larger than that. Documents are
never shuffled.

Null and empty texts match nothing, nor do items of fewer than ``min_match`` tokens. Repeated
rows each give their own result rows; ties in tile length go to the earlier place in the item.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .arrow_words import ALPHANUMERIC, U64, slices, split_words

MIN_MATCH = 4
THRESHOLD = 0.5
BLOCK_BYTES = 16 << 20
BROADCAST_IDS = 1_000_000   # of 8 bytes each

RESULT = "id long, item_id long, coverage double, n_item_tokens int, tiles array<struct<doc:int,item:int,length:int>>"


def _karp_rabin(x: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of runs of ``size`` free tokens, their rolling hashes)."""
    if len(x) < size:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    busy = np.concatenate([[0], np.cumsum(~free)])
    start = np.flatnonzero(busy[size:] == busy[:-size])
    base = U64(0x9E3779B97F4A7C15)
    roll = np.zeros(len(x) - size + 1, U64)
    for j in range(size):   # h = h * base + token, for all starts at once
        roll = roll * base + x[j: j + len(roll)]
    return start, roll[start]


def _longest(doc: np.ndarray, item: np.ndarray, free_d: np.ndarray, free_i: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of at least ``size`` free tokens: (length, item start, document start)."""
    at_i, hash_i = _karp_rabin(item, free_i, size)
    at_d, hash_d = _karp_rabin(doc, free_d, size)
    if not len(at_i) or not len(at_d):
        return []
    order = np.argsort(hash_i, kind="stable")
    lo, hi = np.searchsorted(hash_i[order], hash_d, "left"), np.searchsorted(hash_i[order], hash_d, "right")
    found, reached = [], set()
    for p, a, b in zip(at_d[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
        for q in at_i[order[a:b]].tolist():
            if (p - q, q) in reached:   # inside a run that starts further left
                continue
            n = 0
            while (p + n < len(doc) and q + n < len(item) and free_d[p + n] and free_i[q + n] and doc[p + n] == item[q + n]):
                n += 1
            if n >= size:
                found.append((n, q, p))
                reached.update((p - q, q + j) for j in range(1, n - size + 1))
    return found


def greedy_tiles(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """(document start, item start, length) of the tiles of two token-hash sequences."""
    free_d, free_i, tiles = np.ones(len(doc), bool), np.ones(len(item), bool), []
    size = max(min_match, len(item) // 2)
    while True:
        found = _longest(doc, item, free_d, free_i, size)
        top = max((n for n, _, _ in found), default=0)
        if top > 2 * size:   # far longer than searched for: start again from there
            size = top
            continue
        for n, q, p in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if free_d[p:p + n].all() and free_i[q:q + n].all():
                free_d[p:p + n] = free_i[q:q + n] = False
                tiles.append((p, q, n))
            # what an earlier tile cut off is found again, at its own length, by a later search
        if any(free_d[p:p + n].any() and free_i[q:q + n].any() and _still(free_d, free_i, n, q, p, size) for n, q, p in found):
            continue
        if size == min_match:
            return sorted(tiles)
        size = max(min_match, size // 2)


def _still(free_d, free_i, n: int, q: int, p: int, size: int) -> bool:
    """Whether a match that lost tokens to a tile keeps a free run of ``size`` tokens."""
    both = free_d[p:p + n] & free_i[q:q + n]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], both.view(np.int8), [0]])))
    return bool(len(edge) and (edge[1::2] - edge[::2]).max() >= size)


def _block(ids: list[int], texts: list[str], min_match: int) -> dict:
    """Token hashes of benchmark items, and their seeds sorted by hash: plain values to broadcast."""
    words = split_words(pa.array([t.lower() for t in texts], pa.string()), ALPHANUMERIC)
    seed, ok = words.windows(min_match)
    at = np.flatnonzero(ok)
    at = at[np.argsort(seed[at], kind="stable")]
    return {"ids": ids, "tokens": words.hash, "first": words.first, "seed": seed[at], "item": words.doc()[at],
            "place": at - words.first[words.doc()[at]], "known": np.unique(seed[at])}


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, min_match: int, block_bytes: int) -> Iterator[dict]:
    total = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = -(-total // block_bytes)
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        got = sorted((r for r in part.where("text IS NOT NULL").collect()), key=lambda r: (r.item is None, r.item or 0, r.text))
        if got:
            yield _block([r.item for r in got], [r.text for r in got], min_match)


def _search(part: pa.RecordBatch, block: SimpleNamespace, min_match: int, threshold: float) -> list[dict]:
    words = split_words(part.column("text"), ALPHANUMERIC)
    seed, ok = words.windows(min_match)
    if not len(block.known) or not ok.any():
        return []
    at = np.minimum(np.searchsorted(block.known, seed), len(block.known) - 1)
    hit = np.flatnonzero(ok & (block.known[at] == seed))
    lo, hi = np.searchsorted(block.seed, seed[hit], "left"), np.searchsorted(block.seed, seed[hit], "right")
    doc = words.doc()[hit]
    out = []
    bounds = np.searchsorted(doc, np.arange(words.n_docs + 1))
    for d in np.unique(doc):   # the seeds of one document at a time
        a, b = bounds[d], bounds[d + 1]
        n = hi[a:b] - lo[a:b]
        entry = np.repeat(lo[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        length = np.diff(block.first)
        places = np.unique(block.item[entry] * np.int64(length.max()) + block.place[entry])
        item, place = np.divmod(places, np.int64(length.max()))
        same = np.r_[item[1:] == item[:-1], False]
        reach = np.where(same, np.minimum(np.r_[place[1:], 0] - place, min_match), min_match)
        covered = np.bincount(item, reach, len(length))
        for i in np.flatnonzero((covered >= threshold * length) & (covered > 0)):
            tokens = block.tokens[block.first[i]:block.first[i + 1]]
            tiles = greedy_tiles(words.hash[words.first[d]:words.first[d + 1]], tokens, min_match)
            coverage = sum(t[2] for t in tiles) / len(tokens)
            if coverage >= threshold:
                out.append({"id": part.column("id")[int(d)].as_py(), "item_id": block.ids[i], "coverage": coverage, "n_item_tokens": len(tokens),
                            "tiles": [{"doc": p, "item": q, "length": n} for p, q, n in tiles]})
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item_id, coverage, n_item_tokens, tiles) for each pair at or over ``threshold``; tile
    positions count tokens."""
    spark = docs.sparkSession
    schema = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_item_tokens", pa.int32()),
                        ("tiles", pa.list_(pa.struct([("doc", pa.int32()), ("item", pa.int32()), ("length", pa.int32())])))])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(text_col)).alias("text"))
    out = None
    for block in _blocks(benchmark, item_col, item_text_col, min_match, block_bytes):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            block = SimpleNamespace(**held.value)
            for batch in batches:
                for a, b in slices(batch.column("text")):
                    found = _search(batch.slice(a, b - a), block, min_match, threshold)
                    if found:
                        yield pa.RecordBatch.from_pylist(found, schema=schema)
        part = rows.mapInArrow(run, RESULT)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold ``threshold`` or more of a benchmark item. Rows
    with a null id are judged by what they hold as well, through a key of id and text."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    keyed = docs.select(key.alias("_key"), F.col(text_col).alias("_text"))
    bad = materialize(contaminated(keyed, benchmark, "_key", "_text", **options).select(F.col("id").alias("_key")).distinct())
    few = bad.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS   # else both sides are shuffled
    return docs.join(F.broadcast(bad) if few else bad, key == bad["_key"], "left_anti")
