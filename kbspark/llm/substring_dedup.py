"""Removal of word passages that occur more than once (prefix-partitioned suffix trees).

A suffix is the rest of a document from one word on, a window its first ``window`` words. A
window is repeated if its word sequence also starts at another place, in the same document or
another. Every word that a repeated window covers is removed; the input decides, not what is
left of it.

1. Every window has an anchor: the least hash among its ``prefix``-word sequences. Equal windows
   have equal anchors, so a window can only repeat if its anchor occurs at two places. Few
   positions are anchors (2 in ``window - prefix``), so this finds the suffixes worth a tree.
2. Those suffixes are split by their first ``prefix`` words into groups. A prefix shared by more
   than ``group_size`` suffixes is lengthened to the whole window, so that no group outgrows a
   task's memory: equal suffixes of a batch are sent once, so a group of equal windows is small.
3. Each group's suffixes are sorted by their path: the hashes of the word runs between the prefix
   lengths. Neighbours in this order share an internal node as deep as their common path; the
   leaves under a node of depth ``window`` are repeated windows (their chains are the maximal repeats).

Rows with a null id or text, repeated rows and extra columns are kept: a null or empty text has
no words and stays as it is; two rows with the same text repeat each other, also under one id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import batches as B
from .arrow_words import BLANK_SEPARATED, U64, Words, combine, slices, split_words

WINDOW = 35
PREFIX = 12
GROUP_SIZE = 2_000_000

RESULT = "id long, text string, kept string, n_words long, n_removed long, removed_spans binary, kept_sha256 string"


def _slide(x: np.ndarray, k: int, best) -> np.ndarray:
    """best of x[i : i + k] for each i (the tail beyond len(x) - k + 1 is dropped)."""
    size, level = 1, x
    while size * 2 <= k:
        level = best(level[: len(level) - size], level[size:])
        size *= 2
    n = len(x) - k + 1
    return best(level[:n], level[k - size: k - size + n])


def _windows(words: Words, window: int, prefix: int):
    """(anchor hash of each window, whether each word starts a window, anchor positions' flags and hashes)."""
    n = len(words.hash)
    ok = words.left() >= window
    if n < window or not ok.any():
        return None
    gram, inside = words.windows(prefix)
    gram = np.where(inside, gram | U64(1), U64(0xFFFFFFFFFFFFFFFF))
    least = np.zeros(n, U64)
    span = window - prefix + 1
    low = _slide(gram, span, np.minimum)
    least[: len(low)] = low
    least[~ok] = 0
    reach = _slide(np.concatenate([np.zeros(span - 1, U64), least]), span, np.maximum)
    return least, ok, reach == gram, gram


def _paths(words: Words, cuts: list[int]) -> list[np.ndarray]:
    """Hash of the words between neighbouring cuts, for each start."""
    out, n = [], len(words.hash)
    for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
        h, _ = words.windows(b - a)
        out.append(np.concatenate([h[a:], np.zeros(min(a, n), U64)])[:n])
    return out


def _tokens(rows: pa.Table):
    """Words of a batch, a few MB at a time."""
    text = rows.column("text").combine_chunks()
    for a, b in slices(text):
        yield a, b, split_words(text.slice(a, b - a), BLANK_SEPARATED)


def _distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, whether each occurs twice or more)."""
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.uint8)
    value, count = np.unique(np.concatenate(parts), return_counts=True)
    return value, (count > 1).astype(np.uint8)


def _repeated(keys: list[np.ndarray], extras: list[bytes]) -> list[tuple[bytes, bytes]]:
    """To each batch, those of its hashes that occur at two places or more in all batches."""
    every = np.concatenate(keys)
    multi = np.frombuffer(b"".join(extras), np.uint8)
    value, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
    twice = (count > 1) | (np.bincount(inverse, multi, len(value)) > 0)
    hit, at, out = twice[inverse], 0, []
    for k in keys:
        out.append((k[hit[at: at + len(k)]].tobytes(), b""))
        at += len(k)
    return out


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   prefix: int = PREFIX, group_size: int = GROUP_SIZE, batch_bytes: int = B.BATCH_BYTES,
                   texts: bool = True, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, text with the repeated words cut out (other bytes
    unchanged), kept (the kept words joined by one space), n_words, n_removed, removed_spans
    (little-endian uint32 pairs: first and last word of each removed run) and the SHA-256 of
    ``kept``. ``texts=False`` leaves text and kept null. ``keep`` names columns of ``docs`` that
    come back in a struct ``row``."""
    if not 1 < prefix < window:
        raise ValueError("prefix must be over 1 and under window")
    middle = min(window - 1, max(prefix + 1, window * 2 // 3))
    cuts = [prefix, middle, window]
    rows, owners = B.in_batches(docs, id_col, text_col, batch_bytes, keep)

    def anchors(batch, table):
        found = []
        for _, _, words in _tokens(table):
            if (w := _windows(words, window, prefix)) is not None:
                found.append(w[3][w[2]])
        value, multi = _distinct(found)
        return B.pack(owners, batch, value, multi)

    def suffixes(table, found):
        """Distinct paths of the suffixes whose anchor is repeated, and which occur twice in the batch."""
        known = np.sort(B.unpack(found, "found", U64))
        parts = []
        for _, _, words in _tokens(table):
            if len(known) and (w := _windows(words, window, prefix)) is not None:
                least, ok = w[0], w[1]
                at = np.minimum(np.searchsorted(known, least), len(known) - 1)
                pick = np.flatnonzero(ok & (known[at] == least))
                parts.append(np.stack([p[pick] for p in _paths(words, cuts)], axis=1))
        every = np.concatenate(parts) if parts else np.zeros((0, 3), U64)
        order = np.lexsort((every[:, 2], every[:, 1], every[:, 0]))
        every = every[order]
        new = np.r_[True, (every[1:] != every[:-1]).any(axis=1)] if len(every) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        return every[at], (np.diff(np.r_[at, len(every)]) > 1).astype(np.uint8)

    def group_sizes(batch, table, found):
        path, _ = suffixes(table, found)
        value, count = np.unique(path[:, 0], return_counts=True)
        return B.pack(owners, batch, value, count.astype(np.uint32))

    def too_large(keys, extras):
        every, count = np.concatenate(keys), np.frombuffer(b"".join(extras), np.uint32)
        value, inverse = np.unique(every, return_inverse=True)
        large = value[np.bincount(inverse, count, len(value)) > group_size]
        return [(k[np.isin(k, large)].tobytes(), b"") for k in keys]

    def grouped(batch, table, found):
        # answers to both earlier questions arrive together: extra marks the prefixes to lengthen
        tag = np.array([x == b"L" for x in found.column("extra").to_pylist()], bool)
        path, multi = suffixes(table, found.filter(pa.array(~tag)))
        large = np.unique(B.unpack(found.filter(pa.array(tag)), "found", U64))
        whole = combine(combine(path[:, 0], path[:, 1]), path[:, 2])
        key = np.where(np.isin(path[:, 0], large), whole, path[:, 0])
        return B.pack(owners, batch, key, path[:, 0], path[:, 1], path[:, 2], multi, send_key=False)

    def subtrees(keys, extras):
        cols = [[], [], []]
        multi = []
        for e in extras:
            n = len(e) // 25
            for i in range(3):
                cols[i].append(np.frombuffer(e, U64, n, 8 * n * i))
            multi.append(np.frombuffer(e, np.uint8, n, 24 * n))
        a, b, c = (np.concatenate(x) for x in cols)
        order = np.lexsort((c, b, a))   # suffixes of each group in lexicographic order of their path
        depth = np.zeros(len(order) + 1, np.int64)   # words that a suffix shares with the one before
        shared = np.ones(len(order) - 1, bool)
        for path, cut in zip((a, b, c), cuts, strict=True):
            shared &= path[order][1:] == path[order][:-1]
            depth[1:-1][shared] = cut
        deep = np.empty(len(order), bool)   # leaves under an internal node as deep as the window
        deep[order] = np.maximum(depth[1:], depth[:-1]) >= window
        deep |= np.concatenate(multi) > 0
        at, out = 0, []
        for x, y, z in zip(*cols, strict=True):
            hit = deep[at: at + len(x)]
            out.append((combine(combine(x[hit], y[hit]), z[hit]).tobytes(), b""))
            at += len(x)
        return out

    def cut_out(table, found):
        known = np.sort(B.unpack(found, "found", U64))
        res: dict[str, list] = {k: [] for k in ("text", "kept", "n_words", "n_removed", "removed_spans", "kept_sha256")}
        for a, b, words in _tokens(table):
            n = len(words.hash)
            gone = np.zeros(n + 1, np.int64)
            ok = words.left() >= window
            if len(known) and ok.any():
                p = _paths(words, cuts)
                full = combine(combine(p[0], p[1]), p[2])
                at = np.minimum(np.searchsorted(known, full), len(known) - 1)
                hit = np.flatnonzero(ok & (known[at] == full))
                np.add.at(gone, hit, 1)
                np.subtract.at(gone, hit + window, 1)
            gone = np.cumsum(gone[:n]) > 0
            _write(res, words, gone, texts)
        null = table.column("text").combine_chunks().is_null()
        res["text"] = pc.if_else(null, None, pa.array(res["text"], pa.string()))
        more = [table.column("row").combine_chunks()] if keep else []
        return pa.Table.from_arrays([
            table.column("id").combine_chunks().cast(pa.int64()), res["text"], pa.array(res["kept"], pa.string()),
            pa.array(res["n_words"], pa.int64()), pa.array(res["n_removed"], pa.int64()),
            pa.array(res["removed_spans"], pa.binary()), pa.array(res["kept_sha256"], pa.string()), *more],
            names=["id", "text", "kept", "n_words", "n_removed", "removed_spans", "kept_sha256", *["row"] * len(more)])

    seen = B.answer(B.ask(rows, anchors), _repeated)
    large = B.answer(B.ask_again(rows, seen, group_sizes), too_large)
    both = seen.unionByName(large.withColumn("extra", F.lit(b"L")))
    deep = B.answer(B.ask_again(rows, both, grouped), subtrees)
    schema = RESULT + (f", row {rows.schema['row'].dataType.simpleString()}" if keep else "")
    return B.conclude(rows, deep, cut_out, schema)


def _write(res: dict, words: Words, gone: np.ndarray, texts: bool) -> None:
    """Append each document's text without the words that are ``gone``."""
    data, first, off = words.data, words.first, words.offsets
    for d in range(words.n_docs):
        a, b = first[d], first[d + 1]
        cut = gone[a:b]
        k = int(cut.sum())
        raw = data[off[d]:off[d + 1]]
        spans = b""
        base = off[d]
        st, en = words.start[a:b] - base, words.end[a:b] - base
        if not texts:
            res["text"].append(None)
        if k:
            edge = np.diff(np.r_[0, cut.astype(np.int8), 0])
            lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            spans = np.stack([lo, hi - 1], axis=1).astype("<u4").tobytes()
        if k and texts:
            # a removed run goes with the separators behind it; the last one with those before it
            alive = np.ones(len(raw) + 1, np.int8)
            for x, y in zip(lo, hi, strict=True):
                if y < b - a:
                    alive[st[x]:st[y]] = 0
                else:
                    alive[(en[x - 1] if x else st[x]):en[y - 1]] = 0
            res["text"].append(raw[alive[:-1].astype(bool)].tobytes().decode("utf-8"))
        elif texts:
            res["text"].append(raw.tobytes().decode("utf-8"))
        size = np.where(cut, 0, en - st + 1)
        if k == b - a:
            kept = b""
        else:
            mark = np.zeros(len(raw) + 2, np.int8)
            live = ~cut
            np.add.at(mark, st[live], 1)
            np.subtract.at(mark, en[live] + 1, 1)
            keep = np.cumsum(mark)[: len(raw) + 1] > 0
            line = np.r_[raw, np.uint8(0x20)]
            line[en] = 0x20
            kept = line[keep].tobytes()[: int(size.sum()) - 1]
        res["kept"].append(kept.decode("utf-8") if texts else None)
        res["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        res["n_words"].append(int(b - a))
        res["n_removed"].append(k)
        res["removed_spans"].append(spans)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` (all its columns and rows) with the repeated words cut out of the text column."""
    out = repeated_words(docs, id_col, text_col, keep=docs.columns, **options)
    return out.select(*[(F.col("text") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
