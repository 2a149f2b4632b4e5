"""Vectorised word access over Arrow string columns.

Texts stay UTF-8 bytes in one buffer. Words are maximal runs of bytes that a 256-entry class
table marks as word bytes, so a separator must be ASCII (every byte of a non-ASCII character is
a word byte). Word and window hashes are 64-bit; a window hash combines the word hashes of the
window and never crosses a document boundary. Null texts read as empty ones.
"""

from __future__ import annotations

import ctypes
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_LONG_WORD = 64

#: Word bytes of ``[^\x20\x09-\x0D]+``.
BLANK_SEPARATED = np.ones(256, dtype=bool)
BLANK_SEPARATED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Word bytes of ASCII letters, digits and every non-ASCII character.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[128:] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    ALPHANUMERIC[ord(_a):ord(_b) + 1] = True

_KEEP_LOW = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two hashes."""
    return mix(a * U64(0x9E3779B97F4A7C15) + (b ^ U64(0xD6E8FEB86659FD93)))


@dataclass
class Words:
    """Words of a batch of documents, in order: byte spans, hashes and the owning row."""

    data: np.ndarray        # bytes of all texts, padded by 8 zeros
    offsets: np.ndarray     # byte offset of each text, and the end
    start: np.ndarray       # byte span of each word
    end: np.ndarray
    first: np.ndarray       # index of each document's first word, and the end
    hash: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts())

    def left(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return np.repeat(self.first[1:], self.counts()) - np.arange(len(self.hash))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the k words that start at each word, whether they lie in one document)."""
        n, h, done, size, level = len(self.hash), None, 0, 1, self.hash
        ok = self.left() >= k
        if n < k:
            return np.zeros(n, U64), np.zeros(n, bool)
        while size <= k:
            if k & size:
                h = level[: n - k + 1] if h is None else combine(h, level[done: done + n - k + 1])
                done += size
            size *= 2
            if size <= k:
                level = combine(level[: len(level) - size // 2], level[size // 2:])
        return np.concatenate([h, np.zeros(k - 1, U64)]), ok


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes padded by 8, offsets) of an Arrow string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    lo, hi = int(raw[0]), int(raw[-1])
    data = np.zeros(hi - lo + 8, dtype=np.uint8)
    if hi > lo:
        data[: hi - lo] = np.frombuffer(column.buffers()[2], dtype=np.uint8, count=hi)[lo:]
    return data, raw - lo


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span, eight bytes a step; spans over 64 bytes through blake2b."""
    if not len(start):
        return np.zeros(0, U64)
    eight = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    size = end - start
    h = mix((eight[start] & _KEEP_LOW[np.minimum(size, 8)]) + size.astype(U64) * U64(0x9E3779B97F4A7C15))
    at, todo = 8, np.flatnonzero((size > 8) & (size <= _LONG_WORD))
    while len(todo):
        more = eight[start[todo] + at] & _KEEP_LOW[np.minimum(size[todo] - at, 8)]
        h[todo] = combine(h[todo], more)
        at += 8
        todo = todo[size[todo] > at]
    for i in np.flatnonzero(size > _LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def split_words(column, word_bytes: np.ndarray = BLANK_SEPARATED) -> Words:
    data, offsets = text_buffer(column)
    n = len(data) - 8
    inside = word_bytes[data[:n]]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[: n - 1] = inside[: n - 1], inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets), word_hashes(data, start, end))


def release() -> None:
    """Give memory that Arrow and the allocator hold for reuse back to the system: a worker outlives its
    task, and what it keeps adds up over the stages of a job."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(column, max_bytes: int = 4 << 20):
    """Row ranges of a string column of at most ``max_bytes`` each (one longer text stays whole). After
    the last one, unused memory is released."""
    size = pc.fill_null(pc.binary_length(column), 0)
    total = np.cumsum(np.asarray(size, dtype=np.int64)) if len(column) else np.zeros(0, np.int64)
    at = 0
    while at < len(column):
        base = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, base + max_bytes, side="right")))
        yield at, stop
        at = stop
    release()
