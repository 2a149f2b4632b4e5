"""Toxicity of documents: a bidirectional gated recurrent network over characters and words.

Every distinct word is read by a character network (a gated recurrent unit in each direction,
pooled by attention), its pooled state is joined to a hashed word embedding, and windows of 64
words are read by a word network of the same build; a logistic unit on the pooled state gives the
window's score. Windows start every 48 words and cover the whole text; a document's score is the
greatest of its windows.

Training is plain numpy on the driver, on a bounded sample of labelled rows (``MAX_TOXIC`` toxic
and ``MAX_CLEAN`` other documents of at most ``MAX_TRAIN_CHARS`` characters, those of least hash),
weighted back to the classes' shares among all labels. First every window carries its document's
label; then, again and again, only the highest scoring window of each document does.

Scoring is one pass of Arrow batches: the input projections of a word depend on the word alone, so
they are computed once per distinct word and looked up; only the recurrence runs per position.

Rows: words are runs of letters and digits, lower-cased; a word of over 24 characters is read as
overlapping pieces of 24. A text without words (null and empty ones too) scores the share of toxic
labels. Every row of the table gets one row, repeated rows and null ids too. Rows without a label
or an id are never trained on; without labelled rows of both classes every score is the share of
toxic labels (0 if there are no labels). Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_words import slices

MAX_TOXIC, MAX_CLEAN, MAX_TRAIN_CHARS = 2000, 4000, 20_000
WINDOW, STRIDE = 64, 48
HIDDEN, EMBEDDING, BUCKETS, CHARS = 8, 8, 4096, 128
PIECE, PIECE_STEP = 24, 16
SLICE_BYTES, MAX_VOCABULARY, WINDOWS_AT_ONCE, WORDS_AT_ONCE = 1 << 20, 100_000, 4096, 4096
#: Update gate of padding: the state passes through unchanged.
_HOLD = 40.0

WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    out = []
    for w in WORD.findall((text or "").lower()):
        if len(w) <= PIECE:
            out.append(w)
        else:
            out += [w[i:i + PIECE] for i in range(0, len(w) - PIECE + PIECE_STEP, PIECE_STEP)]
    return out


def gate(x: np.ndarray) -> np.ndarray:
    """Logistic function, exactly 1 for large x."""
    return 0.5 * np.tanh(0.5 * x) + 0.5


def recur(inputs, u: np.ndarray, reverse: bool, keep: bool = False):
    """States [T, B, H] of a gated recurrent unit over input projections [T, B, 3H] (update, reset, new);
    with ``keep`` also what the backward pass needs."""
    steps, width = len(inputs), len(u)
    first = inputs[0]
    state = np.zeros((len(first), width), u.dtype)
    states = np.empty((steps, len(first), width), u.dtype)
    kept = [None] * steps
    for t in (range(steps - 1, -1, -1) if reverse else range(steps)):
        x, carried = inputs[t], state @ u
        zr = gate(x[:, :2 * width] + carried[:, :2 * width])
        z, r = zr[:, :width], zr[:, width:]
        new = np.tanh(x[:, 2 * width:] + r * carried[:, 2 * width:])
        if keep:
            kept[t] = (state, z, r, new, carried[:, 2 * width:])
        state = new + z * (state - new)
        states[t] = state
    return (states, kept) if keep else states


def recur_back(grad: np.ndarray, kept, u: np.ndarray, reverse: bool):
    """(gradient of the input projections, of ``u``) from that of the states."""
    steps, width = len(grad), len(u)
    back = np.zeros_like(grad[0])
    du, dx = np.zeros_like(u), np.empty((*grad.shape[:2], 3 * width), u.dtype)
    for t in (range(steps) if reverse else range(steps - 1, -1, -1)):
        before, z, r, new, carried = kept[t]
        g = back + grad[t]
        dnew = g * (1 - z) * (1 - new * new)
        dz = g * (before - new) * z * (1 - z)
        dr = dnew * carried * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dnew], axis=1)
        through = np.concatenate([dz, dr, dnew * r], axis=1)
        du += before.T @ through
        back = g * z + through @ u.T
    return dx, du


def attend(states: np.ndarray, v: np.ndarray, there: np.ndarray):
    """(pooled states, weights): positions weighted by softmax of v . state; nothing there gives zeros."""
    e = np.where(there, states @ v, -np.inf)
    top = e.max(axis=0)
    a = np.exp(e - np.where(np.isfinite(top), top, 0))
    a /= np.maximum(a.sum(axis=0), np.finfo(v.dtype).tiny)
    return np.einsum("tb,tbh->bh", a, states), a


def attend_back(grad, states, a, v):
    through = np.einsum("bh,tbh->tb", grad, states)
    de = a * (through - (a * through).sum(axis=0))
    return a[:, :, None] * grad + de[:, :, None] * v, np.einsum("tb,tbh->h", de, states)


def add_rows(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """into[at] += rows, repeated places summed."""
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    first = np.flatnonzero(np.r_[True, sorted_at[1:] != sorted_at[:-1]]) if len(at) else np.zeros(0, int)
    if len(first):
        into[sorted_at[first]] += np.add.reduceat(rows[order], first, axis=0)


def new_model(seed: int = 13, dtype=np.float32) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(dtype)
    model = {"chars": 0.5 * rng.standard_normal((CHARS, EMBEDDING)).astype(dtype),
             "words": 0.1 * rng.standard_normal((BUCKETS, EMBEDDING)).astype(dtype)}
    for level, width in (("c", EMBEDDING), ("w", 2 * HIDDEN + EMBEDDING)):
        for way in "fb":
            model[f"{level}{way}_in"], model[f"{level}{way}_u"] = make(width, 3 * HIDDEN), make(HIDDEN, 3 * HIDDEN)
            model[f"{level}{way}_bias"] = np.zeros(3 * HIDDEN, dtype)
        model[f"{level}_attend"] = make(2 * HIDDEN)
    model["out"], model["out_bias"] = make(2 * HIDDEN), np.zeros(1, dtype)
    return {k: v.astype(dtype) for k, v in model.items()}


def read_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters [T, n] with 0 for none, embedding bucket of each word)."""
    longest = max(map(len, words), default=1)
    codes = np.frombuffer("".join(w.ljust(longest, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(-1, longest).T
    chars = np.where(codes == 0, 0, codes % (CHARS - 1) + 1).astype(np.int64)
    return chars, np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words], np.int64)


def _two_ways(model, level: str, tables, ids: np.ndarray, there: np.ndarray, keep: bool = False):
    """Pooled states [B, 2H] of sequences ``ids`` [T, B] whose input projections are rows of ``tables``."""
    runs = [recur([table[row] for row in ids] if keep else _Rows(table, ids), model[f"{level}{way}_u"], way == "b", keep)
            for way, table in zip("fb", tables)]
    states = np.concatenate([r[0] if keep else r for r in runs], axis=2)
    pooled, a = attend(states, model[f"{level}_attend"], there)
    return (pooled, (states, a, [r[1] for r in runs])) if keep else pooled


class _Rows:
    """Rows of a table for each step, looked up when the step is reached."""

    def __init__(self, table, ids):
        self.table, self.ids = table, ids

    def __len__(self):
        return len(self.ids)

    def __getitem__(self, t):
        return self.table[self.ids[t]]


def _projections(model, level: str, x: np.ndarray) -> list[np.ndarray]:
    """Input projections of every row of ``x`` in both directions; row 0 is padding."""
    out = []
    for way in "fb":
        p = x @ model[f"{level}{way}_in"] + model[f"{level}{way}_bias"]
        p[0] = 0
        p[0, :HIDDEN] = _HOLD
        out.append(p)
    return out


def word_inputs(model, words: list[str], keep: bool = False):
    """Inputs of the word network [n + 1, 2H + E]: row i + 1 belongs to words[i], row 0 to padding.

    Words are read in runs of like length, so that little of a run is padding."""
    tables = _projections(model, "c", model["chars"])
    x = np.zeros((len(words) + 1, 2 * HIDDEN + EMBEDDING), model["words"].dtype)
    length = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(length, kind="stable")
    edges = np.searchsorted(length[order], [6, 9, 13, PIECE + 1])
    parts = []
    for a, b in zip([0, *edges], [*edges, len(order)]):
        for lo in range(a, b, WORDS_AT_ONCE):
            some = order[lo:min(b, lo + WORDS_AT_ONCE)]
            chars, bucket = read_words([words[i] for i in some])
            pooled = _two_ways(model, "c", tables, chars, chars > 0, keep)
            x[some + 1, :2 * HIDDEN] = pooled[0] if keep else pooled
            x[some + 1, 2 * HIDDEN:] = model["words"][bucket]
            if keep:
                parts.append((some, chars, bucket, pooled[1]))
    return (x, parts) if keep else x


def _two_ways_back(model, grads, level: str, pooled_grad, kept, ids, rows: np.ndarray) -> np.ndarray:
    """Adds the gradients of one level; returns that of ``rows``, the projections' inputs."""
    states, a, runs = kept
    dstates, dv = attend_back(pooled_grad, states, a, model[f"{level}_attend"])
    grads[f"{level}_attend"] += dv
    drows = np.zeros_like(rows)
    for way, run, part in (("f", runs[0], dstates[:, :, :HIDDEN]), ("b", runs[1], dstates[:, :, HIDDEN:])):
        dx, du = recur_back(np.ascontiguousarray(part), run, model[f"{level}{way}_u"], way == "b")
        dtable = np.zeros((len(rows), 3 * HIDDEN), rows.dtype)
        add_rows(dtable, ids.ravel(), dx.reshape(-1, 3 * HIDDEN))
        dtable[0] = 0
        grads[f"{level}{way}_u"] += du
        grads[f"{level}{way}_in"] += rows.T @ dtable
        grads[f"{level}{way}_bias"] += dtable.sum(axis=0)
        drows += dtable @ model[f"{level}{way}_in"].T
    return drows


def loss_and_gradients(model, windows: np.ndarray, words: list[str], label: np.ndarray, weight: np.ndarray):
    """Weighted log loss of windows [T, B] of word numbers (from 1; 0 is padding) and all gradients."""
    x, parts = word_inputs(model, words, keep=True)
    pooled, kept = _two_ways(model, "w", _projections(model, "w", x), windows, windows > 0, keep=True)
    logit = pooled @ model["out"] + model["out_bias"]
    share = weight / weight.sum()
    loss = float((share * (np.logaddexp(0, logit) - label * logit)).sum())
    dlogit = (share * (gate(logit) - label)).astype(pooled.dtype)
    grads = {k: np.zeros_like(v) for k, v in model.items()}
    grads["out"], grads["out_bias"] = pooled.T @ dlogit, dlogit.sum(keepdims=True)
    dx = _two_ways_back(model, grads, "w", dlogit[:, None] * model["out"], kept, windows, x)[1:]
    for some, chars, bucket, char_kept in parts:
        add_rows(grads["words"], bucket, dx[some, 2 * HIDDEN:])
        grads["chars"] += _two_ways_back(model, grads, "c", dx[some, :2 * HIDDEN], char_kept, chars, model["chars"])
    grads["chars"][0] = 0
    return loss, grads


def cut_windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, end) of all windows of documents of ``counts`` words, in one numbering of words."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    n = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = first[doc] + nth * STRIDE
    return doc, start, np.minimum(start + WINDOW, first[doc] + counts[doc])


def window_ids(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Word numbers [T, B] of windows; 0 after their end."""
    at = start + np.arange(int((end - start).max(initial=1)))[:, None]
    return np.where(at < end, flat[np.minimum(at, len(flat) - 1)], 0)


def window_scores(model, tables, flat, start, end) -> np.ndarray:
    out = np.empty(len(start), np.float32)
    for lo in range(0, len(start), WINDOWS_AT_ONCE):
        cut = slice(lo, lo + WINDOWS_AT_ONCE)
        ids = window_ids(flat, start[cut], end[cut])
        out[cut] = gate(_two_ways(model, "w", tables, ids, ids > 0) @ model["out"] + model["out_bias"])
    return out


@dataclass
class Toxicity:
    """A trained network and the share of toxic labels; without weights every score is that share."""

    weights: dict[str, np.ndarray] | None
    share: float


def train(texts: list[str], labels: list[int], class_weight: dict[int, float], share: float,
          rounds: int = 8, warm_steps: int = 360, steps: int = 50, batch: int = 96, rate: float = 0.01, seed: int = 13) -> Toxicity:
    """Fit by Adam: ``warm_steps`` batches of any windows, then ``rounds`` x ``steps`` batches of each
    document's highest scoring window. The same rows give the same network."""
    numbers: dict[str, int] = {}
    docs = [[numbers.setdefault(w, len(numbers) + 1) for w in words_of(t)] for t in texts]
    label = np.array(labels, np.float32)
    counts = np.array([len(d) for d in docs], np.int64)
    if not counts.sum() or len(set(labels)) < 2:
        return Toxicity(None, share)
    flat, vocabulary = np.concatenate([np.array(d, np.int64) for d in docs]), list(numbers)
    doc, start, end = cut_windows(counts)
    weight = np.array([class_weight[y] for y in labels], np.float32)
    n_windows = np.bincount(doc, minlength=len(docs))
    rng, model = np.random.default_rng(seed), new_model(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    taken = 0

    def fit(pool: np.ndarray, weights: np.ndarray, n: int, lr: float) -> None:
        nonlocal taken
        order = np.zeros(0, np.int64)
        for _ in range(n):
            while len(order) < min(batch, len(pool)):
                order = np.concatenate([order, rng.permutation(pool)])
            take, order = order[:batch], order[batch:]
            ids = window_ids(flat, start[take], end[take])
            used, ids = np.unique(ids, return_inverse=True)
            if used[0]:   # no padding here: numbers start at 1 all the same
                used, ids = np.concatenate([[0], used]), ids + 1
            ids = ids.reshape(-1, len(take))
            _, grads = loss_and_gradients(model, ids, [vocabulary[i - 1] for i in used[1:]], label[doc[take]], weights[take])
            taken += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                model[k] -= lr * (first[k] / (1 - 0.9 ** taken)) / (np.sqrt(second[k] / (1 - 0.99 ** taken)) + 1e-7)

    fit(np.arange(len(doc)), (weight / np.maximum(n_windows, 1))[doc], warm_steps, rate)
    for i in range(rounds):
        scores = window_scores(model, _projections(model, "w", word_inputs(model, vocabulary)), flat, start, end)
        order = np.lexsort((-scores, doc))
        best = order[np.r_[True, doc[order][1:] != doc[order][:-1]]]
        fit(best, weight[doc], steps, rate * (1 - i / rounds))
    return Toxicity(model, share)


class _Vocabulary(dict):
    """Numbers of the words met so far; new ones wait for their input projections."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self) + 1
        self.new.append(word)
        return n


class Scorer:
    """Scores batches of texts; keeps the projections of at most about ``MAX_VOCABULARY`` words."""

    def __init__(self, model: Toxicity):
        self.model, self.weights = model, model.weights
        self.clear()

    def clear(self) -> None:
        self.known, self.size = _Vocabulary(), 1
        self.tables = None if self.weights is None else _projections(self.weights, "w", np.zeros((1, 2 * HIDDEN + EMBEDDING), np.float32))

    def _learn(self) -> None:
        fresh, self.known.new = self.known.new, []
        if not fresh:
            return
        need = self.size + len(fresh)
        for k, rows in enumerate(_projections(self.weights, "w", word_inputs(self.weights, fresh))):
            if len(self.tables[k]) < need:
                grown = np.empty((max(need, 2 * len(self.tables[k])), 3 * HIDDEN), np.float32)
                grown[:self.size] = self.tables[k][:self.size]
                self.tables[k] = grown
            self.tables[k][self.size:need] = rows[1:]
        self.size = need

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(score, number of windows) of each text."""
        if self.weights is None:
            return np.full(len(texts), self.model.share), np.zeros(len(texts), np.int64)
        if len(self.known) > MAX_VOCABULARY:
            self.clear()
        number = self.known.__getitem__
        docs = [list(map(number, words_of(t))) for t in texts]
        self._learn()
        counts = np.array([len(d) for d in docs], np.int64)
        out = np.full(len(texts), self.model.share)
        doc, start, end = cut_windows(counts)
        if len(doc):
            flat = np.fromiter((i for d in docs for i in d), np.int64, int(counts.sum()))
            scores = window_scores(self.weights, self.tables, flat, start, end)
            out[counts > 0] = np.maximum.reduceat(scores, np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]))
        return out, np.bincount(doc, minlength=len(texts))


def fit_toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Toxicity:
    """Train on a bounded sample of the documents that ``labels`` marks; see the module text."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    totals = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    least = F.xxhash64("id")
    rows = []
    for label, most in ((0, MAX_CLEAN), (1, MAX_TOXIC)):
        ids = marked.where(F.col("label") == label).select("id", "label").orderBy(least, "id").limit(2 * most)
        # at most 2 x most ids
        texts = (documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                 .where(F.length("text").between(1, MAX_TRAIN_CHARS)).join(F.broadcast(ids), "id"))
        rows += texts.orderBy(least, "id", F.xxhash64("text")).limit(most).collect()
    found = {y: sum(r.label == y for r in rows) for y in (0, 1)}
    weight = {y: totals.get(y, 0) / max(1, found[y]) for y in (0, 1)}
    return train([r.text for r in rows], [r.label for r in rows], weight, share)


def score_documents(documents: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_windows) of every document."""
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in slices(texts, SLICE_BYTES):
                score, n = scorer.score(texts.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(score, pa.float64()), pa.array(n, pa.int64())],
                                                 names=["id", "score", "n_windows"])

    return rows.mapInArrow(run, f"id {id_type}, score double, n_windows long")
