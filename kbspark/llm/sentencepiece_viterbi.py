"""SentencePiece encoding and decoding with a shared-prefix Viterbi search.

Spaces become the mark U+2581 and one mark is put in front of a non-empty text, as SentencePiece
does with the identity normaliser. No vocabulary piece holds a mark behind another character
(checked when the model is loaded), so the best segmentation of a text is that of its marked
words: runs of marks and the characters up to the next mark. A slice's distinct marked words of
up to ``LONG_WORD`` characters go through the search together, in blocks of similar length: all
their positions walk the trie of the pieces at once, then forward scores and back pointers are
found for all words, position by position. Longer words are sorted, which lays them out as the
leaves of a trie in depth-first order; forward scores and back pointers are kept on a stack, and
each word takes over those of its common prefix with the word before. The best path has the largest
sum of piece scores; of equal sums the one whose last piece starts earliest. A character outside the
vocabulary costs 10 less than the lowest score and is written as its UTF-8 byte pieces, as is a mark
that stands in the text itself.

Encoding and decoding are exact inverses for every text. A null text gives null ids, an empty one
no ids. Repeated rows, null ids and extra columns pass through. No data is shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_words import U64, slices, text_buffer, word_hashes

MARK = "▁"
_OWN_MARK = "\udfff"   # stands for a mark of the text; no valid text holds it
_UNKNOWN_PENALTY = 10.0
SLICE_BYTES = 1 << 20
LONG_WORD = 48
BLOCK_CELLS = 24_000
RUN = 1 << 16


def take_spans(pool: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The spans of ``pool`` one behind another, in parts: the index of a whole slice's bytes would take
    many times its memory."""
    parts = []
    for a in range(0, len(at), RUN):
        n = size[a: a + RUN]
        stop = np.cumsum(n)
        where = np.repeat(at[a: a + RUN] - (stop - n), n)
        where += np.arange(len(where))
        parts.append(pool[where])
    return parts


class Trie:
    """The pieces by character, as arrays. Node 0 is none, node 1 the root."""

    def __init__(self, pieces: dict[str, tuple[int, float]]) -> None:
        texts = list(pieces)
        size = np.array([len(x) for x in texts])
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        known = np.unique(codes)
        self.char = np.zeros(0x110000, np.int32)     # 0: in no piece
        self.char[known] = np.arange(1, len(known) + 1)
        self.width = len(known) + 1
        at, node, keys, n = np.cumsum(size) - size, np.ones(len(texts), np.int64), [], 2
        for level in range(int(size.max())):
            here = np.flatnonzero(size > level)
            key, which = np.unique(node[here] * self.width + self.char[codes[at[here] + level]], return_inverse=True)
            keys.append(key)
            node[here] = n + which
            n += len(key)
        self.piece, self.score = np.full(n, -1, np.int32), np.full(n, -np.inf)
        self.piece[node] = [i for i, _ in pieces.values()]
        self.score[node] = [s for _, s in pieces.values()]
        self._fill(np.concatenate(keys))

    def _fill(self, keys: np.ndarray) -> None:
        """Hash table with linear probing: the child by parent and character."""
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.key = np.full((1 << self.bits) + len(keys), -1, np.int64)
        self.node = np.zeros(len(self.key), np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.key[slot] < 0
            self.key[slot[free]] = keys[todo[free]]
            placed = self.key[slot] == keys[todo]
            self.node[slot[placed]] = todo[placed] + 2
            todo, slot = todo[~placed], slot[~placed] + 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def child(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node behind each node by its character, 0 if there is none."""
        key = node * np.int64(self.width) + char
        slot = self._slot(key)
        there = self.key[slot]
        out = np.where(there == key, self.node[slot], 0)
        todo = np.flatnonzero((there != key) & (there >= 0))
        while len(todo):
            slot[todo] += 1
            there = self.key[slot[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.node[slot[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out


class Model:
    """Pieces and scores of a SentencePiece model file with byte pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece: dict[str, tuple[int, float]] = {}
        self.byte = [-1] * 256
        self.raw: list[bytes] = []
        for i in range(sp.vocab_size()):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(text[3:5], 16)] = i
                self.raw.append(bytes([int(text[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                if MARK in text.lstrip(MARK):
                    raise ValueError(f"piece {text!r} spans two marked words")
                self.piece[text] = (i, sp.get_score(i))
                self.raw.append(text.replace(MARK, " ").encode())
        if min(self.byte) < 0:
            raise ValueError("the model has no byte pieces")
        self.unknown = min(s for _, s in self.piece.values()) - _UNKNOWN_PENALTY
        self.longest = max(map(len, self.piece))
        self.trie = Trie(self.piece)
        self.is_byte = np.zeros(len(self.raw), bool)
        self.is_byte[self.byte] = True
        self.size = np.array([len(x) for x in self.raw], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)


def viterbi_words(words: list[str], model: Model) -> tuple[list[list[int]], list[float]]:
    """Ids and score of each of the sorted distinct marked words, sharing the work on prefixes."""
    get, unknown, longest = model.piece.get, model.unknown, model.longest
    score, back, piece = [0.0], [0], [-1]   # of the best path to each position of the current word
    ids_of, score_of, last = [], [], ""
    for word in words:
        n, keep = len(word), 0
        for x, y in zip(last, word, strict=False):
            if x != y:
                break
            keep += 1
        del score[keep + 1:], back[keep + 1:], piece[keep + 1:]
        for j in range(keep + 1, n + 1):
            best, start, which = score[j - 1] + unknown, j - 1, -1
            for i in range(max(0, j - longest), j):
                hit = get(word[i:j])
                if hit is not None:
                    s = score[i] + hit[1]
                    if s > best or (s == best and (which < 0 or i < start)):
                        best, start, which = s, i, hit[0]
            score.append(best)
            back.append(start)
            piece.append(which)
        out, j = [], n
        while j:
            if piece[j] >= 0:
                out.append(piece[j])
            else:
                char = word[j - 1]
                raw = MARK.encode() if char == _OWN_MARK else char.encode()
                out.extend(model.byte[x] for x in reversed(raw))
            j = back[j]
        ids_of.append(out[::-1])
        score_of.append(score[n])
        last = word
    return ids_of, score_of


def viterbi_block(codes: np.ndarray, size: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items of all words, number of each word's items, score of each word) of words in falling order of
    ``size``, given by their code points. An item is a piece's id or, of a character in no piece, -1 - code point."""
    n, m, trie = len(size), int(size[0]), model.trie
    n_from = np.searchsorted(-size, -np.arange(m + 1), side="right")     # words of at least so many characters
    word = np.repeat(np.arange(n), size)
    cell = (np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)) * n + word     # position by position
    code = np.zeros(m * n, np.int64)
    code[cell] = codes
    char = np.zeros((m + model.longest) * n, np.int32)
    char[cell] = trie.char[codes]
    piece = np.full((model.longest, (m + 1) * n), -1, np.int32)     # by length and end
    gain = np.full(piece.shape, -np.inf)
    begin, node = cell, np.ones(len(cell), np.int32)
    for length in range(1, model.longest + 1):
        node = trie.child(node, char[begin + (length - 1) * n])
        begin, node = begin[node > 0], node[node > 0]
        whole = np.flatnonzero(trie.piece[node] >= 0)
        end = begin[whole] + length * n
        piece[length - 1, end] = trie.piece[node[whole]]
        gain[length - 1, end] = trie.score[node[whole]]

    score, taken = np.zeros((m + 1, n)), np.zeros((m + 1, n), np.int64)
    gain = gain.reshape(model.longest, m + 1, n)
    for j in range(1, m + 1):
        k, far = n_from[j], min(j, model.longest)
        paths = gain[far - 1::-1, j, :k] + score[j - far: j, :k]     # the earliest start first
        first = paths.argmax(axis=0)
        best, unknown = paths[first, np.arange(k)], score[j - 1, :k] + model.unknown
        score[j, :k] = np.maximum(best, unknown)
        taken[j, :k] = np.where(unknown > best, 0, far - first)     # 0: one unknown character

    found, who, at = [], np.arange(n), size.copy()
    n_items = np.zeros(n, np.int64)
    while len(who):
        length = taken[at, who]
        found.append((who, np.where(length > 0, piece[length - 1, at * n + who], -1 - code[(at - 1) * n + who])))
        n_items[who] += 1
        at = at - np.maximum(length, 1)
        who, at = who[at > 0], at[at > 0]
    items, last = np.empty(int(n_items.sum()), np.int64), np.cumsum(n_items) - 1
    for back, (who, item) in enumerate(found):
        items[last[who] - back] = item
    return items, n_items, score[size, np.arange(n)]


def _with_bytes(items: np.ndarray, n_items: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of each word's ids): unknown characters become their byte pieces."""
    lone = np.flatnonzero(items < 0)
    if not len(lone):
        return items.astype(np.uint32), n_items
    codes, which = np.unique(-1 - items[lone], return_inverse=True)
    raw = [MARK.encode() if c == ord(_OWN_MARK) else chr(c).encode() for c in codes.tolist()]
    width = np.array([len(x) for x in raw])[which]
    pieces = np.array([[model.byte[x] for x in r.ljust(4, b"\0")] for r in raw])
    size = np.ones(len(items), np.int64)
    size[lone] = width
    at = np.cumsum(size) - size
    ids = np.repeat(items, size)
    for k in range(4):
        some = width > k
        ids[at[lone[some]] + k] = pieces[which[some], k]
    edge = np.r_[at, len(ids)][np.r_[0, np.cumsum(n_items)]]
    return ids.astype(np.uint32), np.diff(edge)


def _code_points(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the marked words at these byte spans, number of each word's)."""
    n_bytes = end - start
    stop = np.cumsum(n_bytes)
    raw = data[np.repeat(start - (stop - n_bytes), n_bytes) + np.arange(n_bytes.sum())]
    codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
    codes[codes == ord(MARK)] = ord(_OWN_MARK)
    codes[codes == 0x20] = ord(MARK)
    chars = np.diff(np.r_[0, np.cumsum((raw & 0xC0) != 0x80)[stop - 1]])
    out = np.full(len(codes) + int(first.sum()), ord(MARK), np.int64)
    out[np.arange(len(codes)) + np.repeat(np.cumsum(first), chars)] = codes
    return out, chars + first


def best_pieces(codes: np.ndarray, size: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, where each word's begin, number of each word's, score of each word) of distinct marked words."""
    at = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    n_long = int(np.searchsorted(-size[order], -LONG_WORD))
    parts, begin, count, score, done = [], np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), np.zeros(len(size)), 0

    def put(words, ids, n_ids, scores):
        nonlocal done
        parts.append(ids)
        begin[words], count[words], score[words] = done + np.cumsum(n_ids) - n_ids, n_ids, scores
        done += len(ids)

    if n_long:
        text = {i: codes[at[i]: at[i] + size[i]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for i in order[:n_long].tolist()}
        words = sorted(text, key=text.__getitem__)
        ids, scores = viterbi_words([text[i] for i in words], model)
        n_ids = np.array([len(x) for x in ids], np.int64)
        put(np.array(words), np.fromiter((y for x in ids for y in x), np.uint32, int(n_ids.sum())), n_ids, scores)
    while n_long < len(order):
        words = order[n_long: n_long + max(1, BLOCK_CELLS // int(size[order[n_long]]))]
        stop = np.cumsum(size[words])
        chars = codes[np.repeat(at[words] - (stop - size[words]), size[words]) + np.arange(stop[-1])]
        items, n_items, scores = viterbi_block(chars, size[words], model)
        put(words, *_with_bytes(items, n_items, model), scores)
        n_long += len(words)
    return np.concatenate(parts), begin, count, score


def _marked(raw: bytes, first: bool) -> str:
    text = raw.decode().replace(MARK, _OWN_MARK).replace(" ", MARK)
    return MARK + text if first else text


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the marked words of all texts; a text's first one has no mark of its own yet."""
    n = len(data) - 8
    space = data[:n] == 0x20
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    begin = offsets[:-1][np.diff(offsets) > 0]
    cut[begin] = True
    # a space at the start of a text belongs to the run of the mark put in front of it
    start = np.flatnonzero(cut)
    return start, np.r_[start[1:], n] if len(start) else start


def encode_texts(column, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts, offsets of each text's ids, score of each text)."""
    data, offsets = text_buffer(column)
    n_docs = len(offsets) - 1
    start, end = _units(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint32), np.zeros(n_docs + 1, np.int64), np.zeros(n_docs)
    h = word_hashes(data, start, end)
    first = np.isin(start, offsets[:-1], assume_unique=False)
    h[first] ^= U64(0xA5A5A5A5A5A5A5A5)
    _, one, inverse = np.unique(h, return_index=True, return_inverse=True)
    pool, pool_at, n_ids, scores = best_pieces(*_code_points(data, start[one], end[one], first[one]), model)
    stop = np.cumsum(n_ids[inverse])
    flat = np.concatenate(take_spans(pool, pool_at[inverse], n_ids[inverse]))
    unit_of_doc = np.searchsorted(start, offsets)
    score = np.concatenate([[0.0], np.cumsum(scores[inverse])])[unit_of_doc]
    return flat, np.r_[0, stop][unit_of_doc], np.diff(score)


def decode_ids(flat: np.ndarray, offsets: np.ndarray, model: Model) -> list[bytes]:
    """The UTF-8 text of each run of ids: piece bytes in a row, without the space put in front."""
    raw = b"".join(x.tobytes() for a in range(0, len(flat), RUN)
                   for x in take_spans(model.bytes, model.at[flat[a: a + RUN]], model.size[flat[a: a + RUN]]))
    edge = np.r_[0, np.cumsum(model.size[flat])][offsets]
    return [raw[a + 1:b] if b > a and raw[a] == 0x20 else raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, ids (little-endian uint32), n_pieces, n_byte_pieces, score,
    ids_crc32 and round_trip: whether decoding the ids gives the text back, byte by byte."""
    def run(batches):
        model = Model(model_path)
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(a, b - a)
                flat, at, score = encode_texts(part.column("text"), model)
                back = decode_ids(flat, at, model)
                data, offsets = text_buffer(part.column("text"))
                raw = data.tobytes()
                same = [raw[x:y] == t for x, y, t in zip(offsets[:-1].tolist(), offsets[1:].tolist(), back, strict=True)]
                null = np.asarray(part.column("text").is_null())
                ids = [flat[x:y].astype("<u4").tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                lone = np.concatenate([[0], np.cumsum(model.is_byte[flat])])
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(ids, pa.binary(), mask=null) if with_ids else pa.nulls(len(ids), pa.binary()),
                    pa.array(np.diff(at), pa.int64(), mask=null), pa.array(np.diff(lone[at]).astype(np.int64), mask=null),
                    pa.array(score, mask=null), pa.array([zlib.crc32(x) for x in ids], pa.int64(), mask=null), pa.array(same, pa.bool_())],
                    names=["id", "ids", "n_pieces", "n_byte_pieces", "score", "ids_crc32", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, ids binary, n_pieces long, n_byte_pieces long, score double, ids_crc32 long, round_trip boolean")


def decode(encoded: DataFrame, model_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows with ids as ``encode`` writes them; null ids give a null text."""
    def run(batches):
        model = Model(model_path)
        for batch in batches:
            raw = [x or b"" for x in batch.column("ids").to_pylist()]
            flat = np.frombuffer(b"".join(raw), "<u4")
            at = np.cumsum([0] + [len(x) // 4 for x in raw])
            text = [x.decode() for x in decode_ids(flat, at, model)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(text, pa.string(), mask=np.asarray(batch.column("ids").is_null()))],
                                             names=["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string")
