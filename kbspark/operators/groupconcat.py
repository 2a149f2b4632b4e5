"""Group-and-concatenate with separator or template rules (O-08, O-13, O-39, O-40, O-64).

``group_concat(df, group_by="a, b", concat=[ConcatRule("col", rule, new_name), ...], order_by=...)``

* Rows with a NULL group key are dropped; NULL values are dropped before concatenation.
* ``%newLine%`` and ``%tab%`` in a rule are aliases for a newline and four blanks.
* Separator mode: values (as strings) in group order joined by the rule.
* Template mode — the rule contains ``%value%``, ``%id%`` or a ``{column}`` of the input:
  one piece per non-NULL value with ``%value%`` = the value, ``%id%`` = its 1-based position
  among the group's non-NULL values, ``{column}`` = that row's column value (stripped, blank →
  ``N/A``); pieces are concatenated with nothing in between.
* Blank new name keeps the old name; no concat columns returns the distinct keys.

Order inside a group is explicit (``order_by``). Positions come from a ``row_number`` window
(sort-based, spills) and the strings from ``listagg ... WITHIN GROUP (ORDER BY ...)``, Spark's
own ordered string aggregate — no list of the group is collected by hand.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from kbspark.functions import text as tx


@dataclass
class ConcatRule:
    column: str
    rule: str = ""
    new_name: str = ""


def parse_columns(csv: str) -> list[str]:
    return [c.strip() for c in (csv or "").split(",") if c.strip()]


def expand_aliases(rule: str) -> str:
    return rule.replace(tx.NEWLINE_ALIAS, "\n").replace(tx.TAB_ALIAS, tx.TAB_TEXT)


def is_template(rule: str, columns: list[str]) -> bool:
    return (tx.VALUE_PLACEHOLDER in rule or tx.ID_PLACEHOLDER in rule
            or any("{" + c + "}" in rule for c in columns))


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _render(rule: str, value: Column, pos: Column, columns: list[str]) -> Column:
    """Fill one template piece; placeholders are substituted in one left-to-right pass over
    the rule text so that substituted values are never scanned again."""
    names = {"{" + c + "}": c for c in columns}
    tokens = [tx.VALUE_PLACEHOLDER, tx.ID_PLACEHOLDER] + sorted(names, key=len, reverse=True)
    parts = re.split("(" + "|".join(re.escape(t) for t in tokens) + ")", rule)
    out = []
    for p in parts:
        if p == tx.VALUE_PLACEHOLDER:
            out.append(value)
        elif p == tx.ID_PLACEHOLDER:
            out.append(pos.cast("string"))
        elif p in names:
            v = tx.strip_blanks(F.col(names[p]).cast("string"))
            out.append(F.coalesce(F.when(v != "", v), F.lit(tx.EMPTY_VALUE)))
        elif p:
            out.append(F.lit(p))
    return F.concat(*out) if out else F.lit("")


def group_concat(df: DataFrame, group_by: str | list[str], concat: list[ConcatRule], order_by: str | list[str],
                 default_rule: str = tx.NEWLINE_ALIAS) -> DataFrame:
    keys = parse_columns(group_by) if isinstance(group_by, str) else list(group_by)
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    data = df.where(F.expr(" AND ".join(f"{_q(k)} IS NOT NULL" for k in keys)) if keys else F.lit(True))
    if not concat:
        return data.select(*keys).distinct()
    columns = df.columns
    order_sql = ", ".join(_q(o) for o in order)
    aggs, extra = [], []
    for i, r in enumerate(concat):
        rule = expand_aliases(r.rule or default_rule or tx.NEWLINE_ALIAS)
        out_name = r.new_name.strip() or r.column
        val = F.col(r.column).cast("string")
        piece = f"_piece{i}"
        if is_template(rule, columns):
            # position among the group's non-NULL values of this column
            w = Window.partitionBy(*keys, F.col(r.column).isNull()).orderBy(*order)
            pos = F.row_number().over(w)
            extra.append(F.when(F.col(r.column).isNotNull(), _render(rule, val, pos, columns)).alias(piece))
            aggs.append(F.expr(f"coalesce(listagg({piece}, '') WITHIN GROUP (ORDER BY {order_sql}), '')").alias(out_name))
        else:
            extra.append(val.alias(piece))
            sep = rule.replace("\\", "\\\\").replace("'", "\\'")
            aggs.append(F.expr(f"coalesce(listagg({piece}, '{sep}') WITHIN GROUP (ORDER BY {order_sql}), '')").alias(out_name))
    prepared = data.select(*[F.col(c) for c in columns], *extra)
    return prepared.groupBy(*keys).agg(*aggs)


def as_records(grouped: DataFrame, group_by: str | list[str]) -> DataFrame:
    """``Data`` rows: text = group keys joined by ' | ', data = the whole row (O-08)."""
    keys = parse_columns(group_by) if isinstance(group_by, str) else list(group_by)
    return grouped.select(F.concat_ws(" | ", *[F.col(k).cast("string") for k in keys]).alias("text"),
                          F.struct(*grouped.columns).alias("data"))
