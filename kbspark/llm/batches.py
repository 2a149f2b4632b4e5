"""Batches of documents that ask hash-partitioned tables questions.

Several operators need, for every document, facts about hashes of all documents (how often an
n-gram occurs, whether a window occurs twice). Exploding one row per n-gram would shuffle many
times the corpus. Here documents are dealt into batches of a few MB by a hash; each batch sends
each *distinct* hash once, packed as bytes, to the partition that owns the hash; the partition
answers each batch; the batch, read again with the answers, goes on. So a hash that every
document holds arrives once per batch, not once per document.

All steps are one lazy plan over one shuffle of the texts (Spark reuses the exchange). Nothing
depends on the order of rows in a batch, so a lost executor's work can be redone at any time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BATCH_BYTES = 2 << 20

ASK = "owner int, batch long, asked binary, extra binary"
ANSWER = "batch long, found binary, extra binary"
_ASK = pa.schema([("owner", pa.int32()), ("batch", pa.int64()), ("asked", pa.binary()), ("extra", pa.binary())])
_ANSWER = pa.schema([("batch", pa.int64()), ("found", pa.binary()), ("extra", pa.binary())])


def in_batches(docs: DataFrame, id_col: str, text_col: str, batch_bytes: int = BATCH_BYTES,
               keep: list[str] | None = None) -> tuple[DataFrame, int]:
    """(batch, id, text, row: a struct of the columns to ``keep``) and the number of hash owners,
    which follows the size of the texts."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-total // batch_bytes))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).alias("batch"),
        F.col(id_col).alias("id"), F.col(text_col).alias("text"),
        *([F.struct(*keep).alias("row")] if keep else []))
    return rows, max(1, min(n, max(parts, n // 8)))


def pack(owners: int, batch: int, key: np.ndarray, *columns: np.ndarray, send_key: bool = True) -> pa.Table:
    """One row per owner of ``key``: keys sorted, the columns in the same order, as bytes. Without
    ``send_key`` the key only chooses the owner."""
    if not len(key):
        return _ASK.empty_table()
    order = np.lexsort((key, key % np.uint64(owners)))
    key, columns = key[order], [c[order] for c in columns]
    who = (key % np.uint64(owners)).astype(np.int32)
    at = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    stop = np.r_[at[1:], len(who)]
    extra = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(at, stop, strict=True)]
    return pa.Table.from_arrays([
        pa.array(who[at], pa.int32()), pa.array(np.full(len(at), batch), pa.int64()),
        pa.array([key[a:b].tobytes() if send_key else None for a, b in zip(at, stop, strict=True)], pa.binary()), pa.array(extra, pa.binary())], schema=_ASK)


def unpack(rows: pa.Table, column: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in rows.column(column).to_pylist() if x), dtype=dtype)


def ask(batches: DataFrame, question: Callable[[int, pa.Table], pa.Table]) -> DataFrame:
    """``question(batch, rows)`` packs what a batch asks."""
    def run(key, rows):
        return question(key[0].as_py(), rows)
    return batches.groupBy("batch").applyInArrow(run, ASK)


def ask_again(batches: DataFrame, answers: DataFrame, question: Callable[[int, pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """As ``ask``, with the answers to an earlier question."""
    def run(key, rows, found):
        return question(key[0].as_py(), rows, found) if rows.num_rows else _ASK.empty_table()
    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, ASK)


def answer(asked: DataFrame, reply: Callable[[list[np.ndarray], list[bytes]], list[tuple[bytes, bytes]]]) -> DataFrame:
    """``reply(keys of each batch, extras of each batch)`` gives (found, extra) for each batch."""
    def run(rows):
        keys = [np.frombuffer(x or b"", np.uint64) for x in rows.column("asked").to_pylist()]
        out = reply(keys, rows.column("extra").to_pylist())
        keep = [i for i, (a, b) in enumerate(out) if a or b]
        return pa.Table.from_arrays([rows.column("batch").combine_chunks().take(pa.array(keep, pa.int64())),
                                     pa.array([out[i][0] for i in keep], pa.binary()),
                                     pa.array([out[i][1] for i in keep], pa.binary())], schema=_ANSWER)
    return asked.groupBy("owner").applyInArrow(run, ANSWER)


def conclude(batches: DataFrame, answers: DataFrame, finish: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``finish(rows, answers)`` gives a batch's result rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def run(rows, found):
        return finish(rows, found) if rows.num_rows else empty
    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, schema)
