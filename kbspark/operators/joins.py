"""Join helpers: size-checked broadcast and salted joins for hot keys.

A side is broadcast only after its row count has been checked against a bound; beyond the
bound the join is salted so that one hot key (one company holding a third of all documents,
say) is spread over ``salt`` tasks instead of landing in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Row bound for broadcasting a "small" side (questions, callers, datasets, cells).
DEFAULT_BROADCAST_ROWS = 1_000_000
DEFAULT_SALT = 32


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame | None:
    """``broadcast(df)`` when ``df`` has at most ``max_rows`` rows, else ``None``.

    The check reads at most ``max_rows + 1`` rows (``limit`` stops the scan early), so it costs
    one small job even when the side turns out to be large.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else None


def require_bounded(df: DataFrame, max_rows: int, what: str) -> DataFrame:
    """Broadcast a side whose size must be bounded (e.g. the question table of an exact
    nearest-neighbour search) or fail loudly instead of planning an unbounded product."""
    b = bounded_broadcast(df, max_rows)
    if b is None:
        raise ValueError(f"{what} has more than {max_rows} rows; use the partitioned (IVF) search")
    return b


def row_blocks(df: DataFrame, key: str, max_rows: int = DEFAULT_BROADCAST_ROWS) -> list[DataFrame]:
    """``df`` as disjoint frames of about ``max_rows`` rows at most, dealt by a hash of ``key``:
    a query set of any size meets all rows block by block, each block small enough to broadcast."""
    n = -(-df.count() // max_rows)
    if n <= 1:
        return [df]
    return [df.where(F.pmod(F.xxhash64(key), F.lit(2 * n)) == i) for i in range(2 * n)]


def hot_key_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                 max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS, salt: int = DEFAULT_SALT,
                 salt_by: list[str] | None = None, small_fits: bool | None = None) -> DataFrame:
    """Equi-join where ``on`` may have very few distinct values (company ids, statuses).

    Small side within the bound: broadcast hash join, no shuffle of ``big`` at all.
    Otherwise: ``big`` rows get a salt from a hash of ``salt_by`` (their own key), ``small`` rows
    are replicated once per salt value, and the join key is extended by the salt, so a hot key
    is split over ``salt`` partitions. Rows are never dropped or sampled. ``small_fits`` passes
    the result of a size check the caller already made.
    """
    if small_fits is None:
        b = bounded_broadcast(small, max_broadcast_rows)
    else:  # the caller already checked this side (or a superset of it)
        b = F.broadcast(small) if small_fits else None
    if b is not None:
        return big.join(b, on, how)
    cols = salt_by or big.columns
    big_s = big.withColumn("_salt", F.pmod(F.xxhash64(*cols), F.lit(salt)))
    small_s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return big_s.join(small_s, on + ["_salt"], how).drop("_salt")
