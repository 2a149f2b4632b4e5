"""Stupid-backoff language-model scores of documents, leave-one-out.

Every document is scored against the n-gram counts of all *other* documents: its own occurrences
are subtracted from the corpus counts. For word i, S = c(w[i-n+1..i]) / c(w[i-n+1..i-1]) for the
longest n <= ``order`` whose n-gram another document holds, times ``alpha`` for each order given
up. A word that no other document holds gets alpha / (N + 1) in place of its relative frequency,
N being the number of words in the other documents.

The n-gram count tables are partitioned by hash: each batch of documents sends each distinct
n-gram once with its count in the batch, the owners sum the counts, and each batch is joined to
the sums of its own n-grams, scored word by word and summed per document. An n-gram that every
document holds costs an owner one entry per batch, so no hot word reaches one task row by row.
Keys are 48 bits under an owner chosen by 24 other bits.

A null or empty text has no words: its sums are 0 and its mean is null. Repeated rows and rows
with a null id are documents of their own; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import batches as B
from .arrow_words import BLANK_SEPARATED, U64, mix, slices, split_words

ORDER = 2
ALPHA = 0.4
BATCH_BYTES = 6 << 20
_LOW = U64((1 << 48) - 1)

RESULT = "id long, n_words long, n_backoff long, n_unseen long, sum_log double, mean_log double"


def _owner_key(h: np.ndarray, owners: int) -> np.ndarray:
    """Owner in the high 16 bits (owners are at most 65,536), 48 bits of the hash below."""
    return ((h >> U64(40)) % U64(owners)) << U64(48) | (h & _LOW)


def _six_bytes(key: np.ndarray) -> bytes:
    return np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(U64).ravel()


def _batch_grams(table: pa.Table, order: int, owners: int):
    """Per order: the key of the n-gram that ends at each word, and whether there is one;
    then words per document."""
    keys: list[list[np.ndarray]] = [[] for _ in range(order)]
    ok: list[list[np.ndarray]] = [[] for _ in range(order)]
    counts = []
    text = table.column("text").combine_chunks()
    for a, b in slices(text):
        words = split_words(text.slice(a, b - a), BLANK_SEPARATED)
        counts.append(words.counts())
        n = len(words.hash)
        for k in range(1, order + 1):
            h, inside = words.windows(k)
            shift = min(k - 1, n)
            keys[k - 1].append(np.concatenate([np.zeros(shift, U64), _owner_key(mix(h + U64(k)), owners)[: n - shift]]))
            ok[k - 1].append(np.concatenate([np.zeros(shift, bool), inside[: n - shift]]))
    return [np.concatenate(x) for x in keys], [np.concatenate(x) for x in ok], np.concatenate(counts)


def _loo(key: np.ndarray, total: np.ndarray, doc: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Corpus count of each occurrence's n-gram without those in its own document."""
    pair = doc * np.int64(len(key)) + inverse
    _, back, own = np.unique(pair, return_inverse=True, return_counts=True)
    return total[inverse] - own[back]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA,
          batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_backoff (words scored below the longest order
    open to them), n_unseen, sum_log and mean_log (natural logarithms)."""
    if order < 1 or not 0 < alpha <= 1:
        raise ValueError("order must be at least 1 and alpha in (0, 1]")
    rows, owners = B.in_batches(docs, id_col, text_col, batch_bytes)
    owners = min(owners, 1 << 16)
    n_key = _owner_key(mix(np.array([0x70707], U64)), owners)[0]   # of the number of words

    def distinct(table):
        keys, ok, counts = _batch_grams(table, order, owners)
        every = np.concatenate([k[o] for k, o in zip(keys, ok, strict=True)] + [np.full(1, n_key)])
        return every, counts

    def grams(batch, table):
        every, counts = distinct(table)
        key, n = np.unique(every, return_counts=True)
        n = n.astype(np.uint32)
        n[np.searchsorted(key, n_key)] += np.uint32(counts.sum() - 1)
        who = (key >> U64(48)).astype(np.int32)
        at = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        stop = np.r_[at[1:], len(who)]
        return pa.Table.from_arrays([
            pa.array(who[at], pa.int32()), pa.array(np.full(len(at), batch), pa.int64()),
            pa.array([_six_bytes(key[a:b]) for a, b in zip(at, stop, strict=True)], pa.binary()),
            pa.array([n[a:b].tobytes() for a, b in zip(at, stop, strict=True)], pa.binary())], schema=B._ASK)

    def sums(table):
        keys = [_from_six(x) for x in table.column("asked").to_pylist()]
        value, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.frombuffer(b"".join(table.column("extra").to_pylist()), np.uint32)
        total = np.bincount(inverse, n, len(value)).astype(np.int64)[inverse]
        # counts beyond 32 bits need 64; most owners need far fewer
        out = total.astype(np.uint32 if total.max(initial=0) < 1 << 32 else U64)
        stop = np.cumsum([len(k) for k in keys])
        wide = bytes([out.itemsize])
        return pa.Table.from_arrays([
            table.column("batch").combine_chunks(),
            pa.array([out[b - len(k): b].tobytes() for k, b in zip(keys, stop, strict=True)], pa.binary()),
            pa.array([wide + int(o).to_bytes(4, "big") for o in table.column("owner").to_pylist()], pa.binary())], schema=B._ANSWER)

    def finish(table, found):
        keys, ok, counts = _batch_grams(table, order, owners)
        every = np.unique(np.concatenate([k[o] for k, o in zip(keys, ok, strict=True)] + [np.full(1, n_key)]))
        parts = sorted(zip((x[1:] for x in found.column("extra").to_pylist()), found.column("extra").to_pylist(),
                           found.column("found").to_pylist(), strict=True))
        total = np.concatenate([np.frombuffer(raw, np.uint32 if tag[0] == 4 else U64).astype(np.int64) for _, tag, raw in parts])
        corpus = total[np.searchsorted(every, n_key)]
        doc = np.repeat(np.arange(len(counts)), counts)
        other = corpus - np.repeat(counts, counts)
        rest = []   # per order: count in other documents of the n-gram that ends at each word
        for k, o in zip(keys, ok, strict=True):
            at = np.flatnonzero(o)
            c = np.zeros(len(k), np.int64)
            if len(at):
                mine, inverse = np.unique(k[at], return_inverse=True)
                c[at] = _loo(mine, total[np.searchsorted(every, mine)], doc[at], inverse)
            rest.append(c)
        longest = np.ones(len(doc), np.int64)
        for n in range(2, order + 1):
            longest[ok[n - 1]] = n
        log, used = np.zeros(len(doc)), np.zeros(len(doc), np.int64)
        for n in range(order, 1, -1):
            at = np.flatnonzero((used == 0) & (rest[n - 1] > 0))
            log[at] = np.log(rest[n - 1][at]) - np.log(rest[n - 2][at - 1])
            used[at] = n
        at = np.flatnonzero((used == 0) & (rest[0] > 0))
        log[at] = np.log(rest[0][at]) - np.log(other[at])
        used[at] = 1
        unseen = np.flatnonzero(used == 0)
        log[unseen] = math.log(alpha) - np.log(other[unseen] + 1.0)
        log += (longest - np.maximum(used, 1)) * math.log(alpha)
        size = len(counts)
        s = np.bincount(doc, log, size)
        mean = np.divide(s, counts, out=np.zeros(size), where=counts > 0)
        return pa.Table.from_arrays([
            table.column("id").combine_chunks().cast(pa.int64()), pa.array(counts, pa.int64()),
            pa.array(np.bincount(doc, np.maximum(used, 1) < longest, size).astype(np.int64)), pa.array(np.bincount(doc, used == 0, size).astype(np.int64)),
            pa.array(s, pa.float64()), pa.array(mean, pa.float64(), mask=counts == 0)],
            names=["id", "n_words", "n_backoff", "n_unseen", "sum_log", "mean_log"])

    tables = B.ask(rows, grams).groupBy("owner").applyInArrow(sums, B.ANSWER)
    return B.conclude(rows, tables, finish, RESULT)
