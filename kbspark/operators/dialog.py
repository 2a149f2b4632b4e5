"""Dialog memory: formatted history, append, compaction (O-53, O-78, O-80).

Conversations are a table (conv_id, turn, role, text). History holds every turn unless a
``limit`` asks for the newest ones only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from kbspark.functions.text import BLANK

HISTORY_LIMIT = None   # every turn; a number keeps the newest ones only
RECENT_VERBATIM = 10


def _lines(rows: Column) -> Column:
    """array<struct<turn, role, text>> → 'role: text' lines in turn order."""
    return F.array_join(F.transform(F.array_sort(rows), lambda m: F.concat(m["role"], F.lit(": "),
                                                                            F.coalesce(m["text"], F.lit("")))), "\n")


def newest(conversations: DataFrame, limit: int | None = HISTORY_LIMIT, key: str = "conv_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col("turn").desc())
    rows = conversations.withColumn("_age", F.row_number().over(w))
    return rows if limit is None else rows.where(F.col("_age") <= limit)


def dialog_history(conversations: DataFrame, limit: int | None = HISTORY_LIMIT, key: str = "conv_id") -> DataFrame:
    """(key, n_turns, history) — newest ``limit`` turns as 'role: text' lines, oldest first."""
    rows = conversations if limit is None else newest(conversations, limit, key)
    return (rows.groupBy(key)
            .agg(F.count(F.lit(1)).alias("n_turns"),
                 _lines(F.collect_list(F.struct("turn", "role", "text"))).alias("history")))


def append_turns(conversations: DataFrame, exchanges: DataFrame, key: str = "conv_id") -> DataFrame:
    """New memory rows for each exchange (key, question, answer): the user turn, then the
    system turn, numbered after the conversation's last turn (O-80). Returns only the
    appended rows; write them with ``mode('append')``."""
    last = conversations.groupBy(key).agg(F.max("turn").alias("_last"))
    base = F.coalesce(F.col("_last"), F.lit(-1))
    # Several exchanges of one key in the same batch are numbered in exchange order.
    w = Window.partitionBy(key).orderBy("exchange_id")
    ex = exchanges.withColumn("_k", F.row_number().over(w) - 1).join(last, key, "left")
    user = ex.select(key, (base + 1 + 2 * F.col("_k")).alias("turn"), F.lit("user").alias("role"),
                     F.col("question").alias("text"))
    system = ex.select(key, (base + 2 + 2 * F.col("_k")).alias("turn"), F.lit("system").alias("role"),
                       F.coalesce(F.col("answer"), F.lit("")).alias("text"))
    return user.unionByName(system)


def default_summary(old_lines: Column, n_old: Column) -> Column:
    """Summary slot default: the older turns, whole, blanks collapsed, on one line."""
    return F.concat(F.lit("summary of "), n_old.cast("string"), F.lit(" earlier messages: "),
                    F.regexp_replace(old_lines, f"{BLANK}+", " "))


def compact_history(conversations: DataFrame, limit: int | None = HISTORY_LIMIT, recent: int = RECENT_VERBATIM,
                    key: str = "conv_id",
                    summarize: Callable[[Column, Column], Column] = default_summary) -> DataFrame:
    """(key, n_recent, n_old, history): the newest ``recent`` turns verbatim, all older
    turns (within ``limit``, if given) folded into one summary line placed first (O-78)."""
    rows = newest(conversations, limit, key)
    g = rows.groupBy(key).agg(
        F.collect_list(F.when(F.col("_age") <= recent, F.struct("turn", "role", "text"))).alias("recent"),
        F.collect_list(F.when(F.col("_age") > recent, F.struct("turn", "role", "text"))).alias("old"))
    n_old = F.size("old")
    summary = summarize(_lines(F.col("old")), n_old)
    hist = F.when(n_old > 0, F.concat(summary, F.lit("\n"), _lines(F.col("recent")))).otherwise(_lines(F.col("recent")))
    return g.select(key, F.size("recent").cast("bigint").alias("n_recent"), n_old.cast("bigint").alias("n_old"),
                    hist.alias("history"))
