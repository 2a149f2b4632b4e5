"""Token files: documents as one id sequence, packed by an interleaved rANS coder.

Writing takes two passes. First the texts, range-partitioned by id and sorted, are tokenised; the
ids of whole documents are gathered into blocks of about ``BLOCK_IDS`` and written with the
occurrences of each id counted. The counts of the whole corpus give one shared table of
frequencies scaled to a power of two, in which every id that occurs has a place. Then every block
is encoded on its own with that table.

File format: a Parquet folder ``blocks`` with one row per block (its documents' ids and lengths,
the position ``start`` of its first id in the whole sequence, the coded words, checkpoints and a
CRC-32) and a folder ``table`` with (id, frequency). Ids of a block go to its lanes in turn, each
lane with a 64-bit state that gives 32-bit words to one common stream. A checkpoint holds the
lanes' states and the place in the stream, so that decoding can start there; every stretch between
two checkpoints has its own CRC-32.

A null text is an empty one; the end id is appended to every document. Repeated rows are kept, and
rows with equal ids stand in the order of their texts, null ids first. Other columns are not read.
"""

from __future__ import annotations

import sys
import types
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .arrow_words import U64, slices, text_buffer, word_hashes

BLOCK_IDS = 1 << 18
LANES = 512
CHECKPOINT_STEPS = 256
SCALE_BITS = 20
CACHE_CHUNKS = 3_000_000
SLICE_BYTES = 4 << 20
JOINT_BYTES = 1 << 16   # chunks encoded as one text
_FLOOR = U64(1) << U64(31)

BLOCKS = ("part int, seq int, doc_ids binary, null_ids binary, lengths binary, n_ids long, start long, lanes int, checkpoints binary, "
          "checkpoint_words binary, checkpoint_crcs binary, words binary, crc32 long")


# ---- coder -----------------------------------------------------------------------------------

class Table:
    """Scaled frequencies of the ids that occur, their cumulative sums and the slot table."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray, bits: int = SCALE_BITS) -> None:
        self.bits, self.ids, self.freq = bits, ids, freq.astype(U64)
        self.cum = np.cumsum(self.freq) - self.freq
        self.rank = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
        self.rank[ids] = np.arange(len(ids))
        self._slot = None

    @property
    def slot(self) -> np.ndarray:
        if self._slot is None:
            self._slot = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.freq.astype(np.int64))
        return self._slot


def scaled_frequencies(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Integers of at least 1 that sum to 2^bits, near in proportion to the positive ``counts``;
    what rounding leaves over or short is taken from the most frequent ids in turn."""
    total = 1 << bits
    if len(counts) > total:
        raise ValueError("more distinct ids than slots: raise the scale bits")
    freq = np.maximum(1, (counts.astype(np.float64) * (total / counts.sum())).astype(np.int64))
    order = np.lexsort((np.arange(len(counts)), -counts))
    while (off := total - int(freq.sum())) != 0:
        if off > 0:
            freq[order[0]] += off
        else:
            give = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * -off // total))
            upto = np.minimum(np.cumsum(give), -off)
            freq[order] -= np.diff(upto, prepend=0)
    return freq


def lanes_of(n: int) -> int:
    """Lanes for a block of ``n`` ids: fewer in small blocks, whose states would outweigh them."""
    lanes = 1
    while lanes < LANES and n >= lanes * 64:
        lanes *= 2
    return lanes


def rans_encode(ids: np.ndarray, table: Table, lanes: int) -> tuple[np.ndarray, list[np.ndarray], list[int]]:
    """(32-bit words, lane states at each checkpoint, words before each checkpoint): checkpoint c
    is before step c * CHECKPOINT_STEPS; step t holds ids t * lanes to (t + 1) * lanes - 1."""
    rank = table.rank[ids]
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, _FLOOR, U64)
    bits = U64(table.bits)
    out: list[np.ndarray] = [None] * steps
    states: list[np.ndarray] = []
    for t in range(steps - 1, -1, -1):
        r = rank[t * lanes:(t + 1) * lanes]
        x, f = state[: len(r)], table.freq[r]
        full = x >= (f << (U64(63) - bits))
        out[t] = (x[full] & U64(0xFFFFFFFF)).astype(np.uint32)
        x = np.where(full, x >> U64(32), x)
        q = x // f
        state[: len(r)] = (q << bits) + (x - q * f) + table.cum[r]
        if t % CHECKPOINT_STEPS == 0:
            states.append(state.copy())
    before = np.concatenate([[0], np.cumsum([len(x) for x in out])])
    return (np.concatenate(out) if out else np.zeros(0, np.uint32)), states[::-1], [int(before[t]) for t in range(0, steps, CHECKPOINT_STEPS)]


def rans_decode(words: np.ndarray, state: np.ndarray, table: Table, n: int) -> np.ndarray:
    """``n`` ids from the states and words of a checkpoint on."""
    lanes, at = len(state), 0
    state, bits = state.copy(), U64(table.bits)
    mask = U64((1 << table.bits) - 1)
    out = np.empty(n, np.int32)
    for a in range(0, n, lanes):
        x = state[: min(lanes, n - a)]
        low = x & mask
        r = table.slot[low]
        out[a:a + len(x)] = r
        x = table.freq[r] * (x >> bits) + low - table.cum[r]
        need = x < _FLOOR
        k = int(np.count_nonzero(need))
        if k:
            x[need] = (x[need] << U64(32)) | words[at:at + k]
            at += k
        state[: len(x)] = x
    return table.ids[out]


# ---- tokenising ------------------------------------------------------------------------------

_LETTER = np.zeros(256, bool)
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ",.;:!?*#$%&|<>"]] = True


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a byte-level BPE's pre-tokeniser always cuts, so that chunks can be encoded one
    by one: before a space in front of a printable ASCII character, and between a letter (ASCII or
    Latin-1) and one of a few ASCII marks, either way round."""
    n = len(data) - 8
    byte = data[:n]
    letter_end = _LETTER[byte].copy()
    tail = (byte[1:] >= 0x80) & (byte[1:] <= 0xBF) & (byte[:-1] == 0xC3) & (byte[1:] != 0x97) & (byte[1:] != 0xB7)
    letter_end[1:] |= tail
    letter_begin = _LETTER[byte].copy()
    letter_begin[:-1] |= tail
    mark = _PUNCT[byte]
    cut = np.zeros(n, bool)
    cut[:-1] |= (byte[:-1] == 0x20) & (byte[1:] > 0x20) & (byte[1:] < 0x7F)
    cut[1:] |= (letter_end[:-1] & mark[1:]) | (mark[:-1] & letter_begin[1:])
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


class Chunks:
    """Ids of chunks met so far, kept between the tasks of a worker: sorted hashes and ragged ids.
    Bounded: at ``CACHE_CHUNKS`` chunks it starts anew."""

    def __init__(self) -> None:
        self.hash, self.at = np.zeros(0, U64), np.zeros(0, np.int64)
        self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        if not len(self.hash):
            return np.full(len(h), -1)
        i = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[i] == h, i, -1)

    def add(self, h: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        if len(self.hash) + len(h) > CACHE_CHUNKS:
            self.__init__()
        at = np.cumsum(size) - size + len(self.pool)
        self.pool = np.concatenate([self.pool.astype(ids.dtype), ids])
        h, at, size = np.concatenate([self.hash, h]), np.concatenate([self.at, at]), np.concatenate([self.size, size])
        order = np.argsort(h, kind="stable")
        self.hash, self.at, self.size = h[order], at[order], size[order]


def _worker(path: str):
    """The tokenizer and chunk store of this Python worker."""
    held = sys.modules.setdefault("_llm_token_rans_worker", types.ModuleType("_llm_token_rans_worker"))
    if getattr(held, "path", None) != path:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        held.tokenizer = Tokenizer.from_file(path)
        held.special = [t.content for t in held.tokenizer.get_added_tokens_decoder().values()]
        held.widths = _token_bytes(held.tokenizer)
        held.chunks, held.path = Chunks(), path
    return held


def _token_bytes(tokenizer) -> np.ndarray:
    """Bytes that each id of a byte-level BPE stands for: its token has one character a byte."""
    widths = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        widths[i] = len(token)
    return widths


def encode_chunks(raw: bytes, start: np.ndarray, end: np.ndarray, held, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the chunks ``raw[start:end]`` as the library encodes each alone, their numbers). Chunks are
    encoded many at once, as one text with a place before each where the pre-tokeniser always cuts (as in
    ``chunk_starts``), and told apart by the bytes that their ids stand for. A chunk that starts with
    neither a space, a letter nor a mark, and joint texts whose ids do not end where the chunks do, are encoded one by one."""
    first, after = np.frombuffer(raw, np.uint8)[start], np.frombuffer(raw, np.uint8)[np.minimum(start + 1, len(raw) - 1)]
    spaced = (first == 0x20) & (after > 0x20) & (after < 0x7F) & (end - start > 1)
    kind = np.select([spaced, _LETTER[first], _PUNCT[first]], [1, 2, 3], 0)   # what the chunk needs before it
    size = np.zeros(len(start), np.int64)
    out, order = [np.zeros(0, dtype)], [np.zeros(0, np.int64)]
    alone = np.flatnonzero(kind == 0)
    for k, lead in ((1, b""), (2, b" ."), (3, b" a")):
        some = np.flatnonzero(kind == k)
        total = np.cumsum(end[some] - start[some] + len(lead))
        for part in np.split(some, np.flatnonzero(np.diff(total // JOINT_BYTES)) + 1):
            if len(part):
                got = _joint(raw, start[part], end[part], lead, held, dtype)
                if got is None:
                    alone = np.concatenate([alone, part])
                else:
                    out.append(got[0])
                    order.append(part)
                    size[part] = got[1]
    if len(alone):
        got = [x.ids for x in held.tokenizer.encode_batch_fast([raw[start[i]:end[i]].decode() for i in alone], add_special_tokens=False)]
        out.append(np.fromiter((y for x in got for y in x), dtype))
        order.append(alone)
        size[alone] = [len(x) for x in got]
    return _ragged(np.concatenate(out), np.concatenate(order), size), size


def _ragged(flat: np.ndarray, order: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of ``flat``, which stand in ``order`` and have ``size[order]`` values, in the order of ``size``."""
    at = np.empty(len(size), np.int64)
    at[order] = np.cumsum(size[order]) - size[order]
    return flat[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(len(flat))]


def _joint(raw: bytes, start: np.ndarray, end: np.ndarray, lead: bytes, held, dtype) -> tuple[np.ndarray, np.ndarray] | None:
    """(ids, numbers) of chunks encoded as one text with ``lead`` before each, or None if they can't be told apart."""
    text = b"".join([lead + raw[a:b] for a, b in zip(start.tolist(), end.tolist())]).decode()
    if any(s in text for s in held.special):
        return None
    ids = np.array(held.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype)
    stop = np.r_[0, np.cumsum(held.widths[ids])]
    chunk_end = np.cumsum(end - start + len(lead))
    chunk_start = chunk_end - (end - start)
    b, a = np.searchsorted(stop, chunk_end), np.searchsorted(stop, chunk_start)
    if stop[-1] != chunk_end[-1] or (stop[b] != chunk_end).any() or (stop[a] != chunk_start).any() or (held.widths[ids] == 0).any():
        return None
    size = b - a
    return ids[np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())], size


def encode_column(column, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets): as the tokenizers library encodes each whole text. A text that holds
    the string of a special token goes to the library whole, which cuts it there."""
    held = _worker(path)
    marked = np.zeros(len(column), bool)
    for special in held.special:
        marked |= pc.fill_null(pc.match_substring(column, special), False).to_numpy(zero_copy_only=False)
    if not marked.any():
        return _encode_plain(column, held)
    flat, at = _encode_plain(pc.if_else(pa.array(marked), "", column), held)
    parts = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
    for i in np.flatnonzero(marked).tolist():
        parts[i] = np.array(held.tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, flat.dtype)
    return np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts])


def _encode_plain(column, held) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffer(column)
    dtype = np.uint16 if held.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
    start = chunk_starts(data, offsets)
    if not len(start):
        return np.zeros(0, dtype), np.zeros(len(offsets), np.int64)
    end = np.r_[start[1:], len(data) - 8]
    found = pa.array(word_hashes(data, start, end)).dictionary_encode()   # by a hash table, not by sorting
    h, inverse = found.dictionary.to_numpy(), found.indices.to_numpy()
    order = np.argsort(h)
    h, rank = h[order], np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    inverse = rank[inverse]
    one = np.empty(len(h), np.int64)
    one[inverse] = np.arange(len(inverse))   # some chunk of each hash
    place = held.chunks.find(h)
    new = np.flatnonzero(place < 0)
    if len(new):
        raw = data.tobytes()
        held.chunks.add(h[new], *encode_chunks(raw, start[one[new]], end[one[new]], held, dtype))
        place = held.chunks.find(h)
        if (place < 0).any():   # the store was emptied meanwhile
            again = np.flatnonzero(place < 0)
            held.chunks.add(h[again], *encode_chunks(raw, start[one[again]], end[one[again]], held, dtype))
            place = held.chunks.find(h)
    where = place[inverse]
    size = held.chunks.size[where]
    stop = np.cumsum(size)
    flat = held.chunks.pool[np.repeat(held.chunks.at[where] - (stop - size), size) + np.arange(size.sum())]
    return flat, np.r_[0, stop][np.searchsorted(start, offsets)]


# ---- files -----------------------------------------------------------------------------------

_RAW = "part int, seq int, doc_ids binary, null_ids binary, lengths binary, n_ids long, local_start long, raw binary, counts binary"


def _tokenised(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Unencoded blocks in id order, and one row per partition with the counts of its ids."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        seq, begin = 0, 0
        counts = np.zeros(0, np.int64)
        ids: list[np.ndarray] = []
        docs_in, nulls, sizes, held = [], [], [], 0
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.binary()), ("null_ids", pa.binary()), ("lengths", pa.binary()),
                            ("n_ids", pa.int64()), ("local_start", pa.int64()), ("raw", pa.binary()), ("counts", pa.binary())])

        def block():
            nonlocal seq, begin
            n = sum(sizes)
            row = {"part": part, "seq": seq, "doc_ids": np.array(docs_in, "<i8").tobytes(), "null_ids": np.array(nulls, np.uint8).tobytes(),
                   "lengths": np.array(sizes, "<u4").tobytes(), "n_ids": n, "local_start": begin, "raw": b"".join(x.tobytes() for x in ids), "counts": None}
            seq, begin = seq + 1, begin + n
            ids.clear(), docs_in.clear(), nulls.clear(), sizes.clear()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE_BYTES):
                piece = batch.slice(a, b - a)
                flat, at = encode_column(piece.column("text"), tokenizer_path)
                tally = np.bincount(flat, minlength=max(len(counts), end_id + 1))
                tally[end_id] += piece.num_rows
                tally[: len(counts)] += counts
                counts = tally
                end = np.full(1, end_id, flat.dtype)
                for i, doc_id in enumerate(piece.column("id").to_pylist()):
                    ids += [flat[at[i]:at[i + 1]], end]
                    docs_in.append(doc_id or 0)
                    nulls.append(doc_id is None)
                    sizes.append(int(at[i + 1] - at[i]) + 1)
                    held += sizes[-1]
                    if held >= BLOCK_IDS:
                        yield block()
                        held = 0
        if sizes:
            yield block()
        if len(counts):
            yield pa.RecordBatch.from_pylist([{"part": part, "seq": -1, "n_ids": begin, "counts": counts.astype("<i8").tobytes()}], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.repartitionByRange(parts, "id").sortWithinPartitions(F.col("id").asc_nulls_first(), "text").mapInArrow(run, _RAW)


def _shared_table(tallies: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scaled frequencies) from the partitions' counts, added up on Spark; the result has at
    most one row per id of the vocabulary."""
    def explode(batches):
        for batch in batches:
            for raw in batch.column("counts").to_pylist():
                n = np.frombuffer(raw, "<i8")
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["id", "n"])

    got = tallies.mapInArrow(explode, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toArrow()
    ids, n = np.asarray(got.column("id")), np.asarray(got.column("n"))
    return ids, scaled_frequencies(n, bits) if len(n) else n


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                 bits: int = SCALE_BITS) -> None:
    """Write ``docs`` as token files under ``path``, which Spark must be able to reach."""
    spark = docs.sparkSession
    _tokenised(docs, id_col, text_col, tokenizer_path, end_id).write.option("compression", "zstd").parquet(f"{path}/raw")
    raw = spark.read.parquet(f"{path}/raw")
    tallies = raw.where("seq < 0")
    ids, freq = _shared_table(tallies.select("counts"), bits)
    spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "frequency": pa.array(freq, pa.int64())})).coalesce(1).write.parquet(f"{path}/table")
    # one row per range partition: where its ids start in the whole sequence
    totals = sorted((r.part, r.n_ids) for r in tallies.select("part", "n_ids").collect())
    start, begin = {}, 0
    for part, n in totals:
        start[part], begin = begin, begin + n
    held = spark.sparkContext.broadcast((ids, freq, bits, start))

    def run(batches):
        ids, freq, bits, start = held.value
        table = Table(ids, freq, bits)
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_ids"]
                seq = np.frombuffer(row["raw"], np.uint16 if len(row["raw"]) == 2 * n else np.uint32)
                lanes = lanes_of(n)
                words, states, before = rans_encode(seq, table, lanes)
                stretch = lanes * CHECKPOINT_STEPS
                crcs = [zlib.crc32(seq[a:a + stretch].astype("<u4").tobytes()) for a in range(0, n, stretch)]
                yield pa.RecordBatch.from_pylist([{
                    "part": row["part"], "seq": row["seq"], "doc_ids": row["doc_ids"], "null_ids": row["null_ids"], "lengths": row["lengths"], "n_ids": n,
                    "start": start[row["part"]] + row["local_start"], "lanes": lanes,
                    "checkpoints": np.concatenate(states).astype("<u8").tobytes(), "checkpoint_words": np.array(before, "<u8").tobytes(),
                    "checkpoint_crcs": np.array(crcs, "<u4").tobytes(), "words": words.astype("<u4").tobytes(),
                    "crc32": zlib.crc32(words.astype("<u4").tobytes())}], schema=_block_schema())

    blocks = raw.where("seq >= 0").select("part", "seq", "doc_ids", "null_ids", "lengths", "n_ids", "local_start", "raw")
    blocks.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def _block_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in BLOCKS.split(", "))])


def read_table(spark: SparkSession, path: str, bits: int = SCALE_BITS):
    got = spark.read.parquet(f"{path}/table").orderBy("id").toArrow()
    return np.asarray(got.column("id")), np.asarray(got.column("frequency")), bits


def decode_block(row: dict, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive) of a block, from the checkpoint at or before ``first``;
    raises ValueError where a checksum does not hold."""
    n, lanes = row["n_ids"], row["lanes"]
    last = n if last is None else min(last, n)
    words = np.frombuffer(row["words"], "<u4")
    if first == 0 and last == n and zlib.crc32(row["words"]) != row["crc32"]:
        raise ValueError("block checksum")
    states = np.frombuffer(row["checkpoints"], "<u8").reshape(-1, lanes)
    before = np.frombuffer(row["checkpoint_words"], "<u8")
    crcs = np.frombuffer(row["checkpoint_crcs"], "<u4")
    stretch, out = lanes * CHECKPOINT_STEPS, []
    for c in range(first // stretch, -(-last // stretch)):
        ids = rans_decode(words[int(before[c]):], states[c], table, min(stretch, n - c * stretch))
        if zlib.crc32(ids.astype("<u4").tobytes()) != crcs[c]:
            raise ValueError("checkpoint checksum")
        out.append(ids)
    base = first // stretch * stretch
    return np.concatenate(out)[first - base: last - base] if out else np.zeros(0, np.int64)


def read_tokens(spark: SparkSession, path: str, bits: int = SCALE_BITS, with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids: little-endian uint32) of each document, decoded from
    the files under ``path`` block by block."""
    held = spark.sparkContext.broadcast(read_table(spark, path, bits))
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        table = Table(*held.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = decode_block(row, table).astype("<u4")
                size = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                stop = np.cumsum(size)
                each = [ids[b - n: b].tobytes() for b, n in zip(stop, size, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=np.frombuffer(row["null_ids"], np.uint8) > 0),
                    pa.array(row["start"] + stop - size, pa.int64()), pa.array(size, pa.int64()), pa.array([zlib.crc32(x) for x in each], pa.int64()),
                    pa.array(each if with_ids else [None] * len(each), pa.binary())], schema=schema)

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long, ids binary")
