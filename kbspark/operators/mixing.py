"""Dataset mixing for training sets (O-42, O-43, O-59, O-60, O-67, O-74..O-77).

* ``dataset_weights``: per dataset size n_d, weight ∝ (1 / (n_d + 1e-6)) ** smoothing,
  normalised to sum 1 (per split); explicit weights override.
* ``global_index``: datasets concatenated in name order; a global index g in
  [offset_d, offset_d + n_d) maps to dataset d and local row ``g mod n_d`` (a rotation, still
  one-to-one), so each row gets exactly one global index.
* ``weighted_sample``: N = total rows draws with replacement; draw g picks dataset d with
  probability ∝ w_d · n_d and then a uniform row of d. Uniforms come from a hash of the draw
  id, so the sample is reproducible by any engine and under task retries. Index and draws exist for
  the whole table or per split, in one numbering pass either way.
* ``hash_sample``: the n rows with the smallest seeded hash (a sampling operator).

Consecutive row numbers are computed without a global single-task window: rows are range-
partitioned on the order key, numbered inside each partition, and shifted by the sizes of
the preceding partitions (a table with one row per partition).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from kbspark.operators.joins import hot_key_join
from kbspark.session import materialize

SMOOTHING = 0.3
EPS = 1e-6


def hash_uniform(*parts) -> Column:
    """Uniform in [0, 1) from the md5 of the '|'-free concatenation of ``parts``."""
    key = F.concat(*[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    # 52 bits: every value is an exact double, and any row of a dataset of 10^15 can be drawn
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def consecutive_index(df: DataFrame, order_cols: list[str], n_partitions: int | None = None,
                      name: str = "row_index") -> DataFrame:
    """0-based consecutive index in the total order of ``order_cols`` (must be unique)."""
    n = n_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: rows and sizes must see the same range boundaries, and two plans over the
    # same frame would each sample their own
    ranged = materialize(df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("bigint"), 33)))
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_pos")).drop("_pid", "_pos", "_off"))


def dataset_sizes(df: DataFrame, dataset_col: str = "dataset", split_col: str | None = None) -> DataFrame:
    keys = [split_col, dataset_col] if split_col else [dataset_col]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def dataset_weights(sizes: DataFrame, dataset_col: str = "dataset", split_col: str | None = None,
                    smoothing: float = SMOOTHING, explicit: DataFrame | None = None) -> DataFrame:
    """(split?, dataset, n_rows, weight). ``explicit`` (dataset, weight) replaces the computed
    weights of the datasets it lists (then everything is renormalised)."""
    raw = F.pow(F.lit(1.0) / (F.col("n_rows").cast("double") + F.lit(EPS)), F.lit(smoothing))
    w = sizes.withColumn("_w", raw)
    if explicit is not None:
        w = (w.join(explicit.select(dataset_col, F.col("weight").alias("_x")), dataset_col, "left")
             .withColumn("_w", F.coalesce(F.col("_x"), F.col("_w"))).drop("_x"))
    part = Window.partitionBy(split_col) if split_col else Window.partitionBy()
    return w.withColumn("weight", F.col("_w") / F.sum("_w").over(part)).drop("_w")


def _keys(dataset_col: str, split_col: str | None) -> list[str]:
    return [split_col, dataset_col] if split_col else [dataset_col]


def _beside(rows: DataFrame, small: DataFrame, keys: list[str], salt_by: list[str]) -> DataFrame:
    """``rows`` beside the one row of their dataset: broadcast if there are few datasets, else salted, so
    that a dataset with a third of all rows does not land in one task."""
    return hot_key_join(rows, small, keys, max_broadcast_rows=100_000, salt=8, salt_by=salt_by)


def local_index(df: DataFrame, dataset_col: str, order_col: str, split_col: str | None = None) -> DataFrame:
    """Position of each row inside its dataset, or its dataset of its split (0-based, in ``order_col``
    order). All splits are numbered in one range pass."""
    keys = _keys(dataset_col, split_col)
    g = consecutive_index(df, [*keys, order_col], name="_g")
    starts = g.groupBy(*keys).agg(F.min("_g").alias("_start"))
    return _beside(g, starts, keys, [order_col]).withColumn("local_index", F.col("_g") - F.col("_start")).drop("_g", "_start")


def with_neighbours(df: DataFrame, key: str, order_col: str, cols: list[str]) -> DataFrame:
    """``df`` with ``next_<c>`` and ``prev_<c>``: ``lead`` and ``lag`` of ``cols`` inside each
    ``key`` group (NULL at the group ends). One shuffle on ``key``; the window streams over its
    sorted rows, so a long group costs time in its task but no memory."""
    w = Window.partitionBy(key).orderBy(order_col)
    return df.select("*", *[F.lead(c).over(w).alias("next_" + c) for c in cols], *[F.lag(c).over(w).alias("prev_" + c) for c in cols])


def _offsets(sizes: DataFrame, dataset_col: str, split_col: str | None = None) -> DataFrame:
    part = Window.partitionBy(split_col) if split_col else Window.partitionBy()
    w = part.orderBy(dataset_col).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*_keys(dataset_col, split_col), "n_rows", F.coalesce(F.sum("n_rows").over(w), F.lit(0)).alias("offset"))


def global_index(df: DataFrame, dataset_col: str = "dataset", order_col: str = "id", split_col: str | None = None) -> DataFrame:
    """Every row with (local_index, global_index); see module doc for the mapping. With ``split_col``
    each split has an index of its own, over its own datasets."""
    li = local_index(df, dataset_col, order_col, split_col)
    offs = _offsets(dataset_sizes(df, dataset_col, split_col), dataset_col, split_col)
    j = _beside(li, offs, _keys(dataset_col, split_col), [order_col])
    g = F.col("offset") + F.pmod(F.col("local_index") - F.col("offset"), F.col("n_rows"))
    return j.withColumn("global_index", g).drop("offset")


def _picker(weights: DataFrame, draws: DataFrame, dataset_col: str, split_col: str | None) -> DataFrame:
    """(split?, draw, dataset, local_index) of draws (split?, draw, _u1, _u2): a dataset by binary search
    of ``_u1`` in the cumulated masses of its split, a row of it by ``_u2``. ``weights`` is one row per
    dataset and goes to the tasks as arrays."""
    keys = _keys(dataset_col, split_col)
    table = weights.select(*keys, "n_rows", (F.col("weight") * F.col("n_rows")).alias("_m")).orderBy(*keys).toArrow()
    splits = table[split_col].to_pylist() if split_col else [None] * table.num_rows
    tables = {}
    for split in dict.fromkeys(splits):
        at = np.flatnonzero([x == split for x in splits])
        mass = table["_m"].to_numpy()[at]
        tables[split] = (np.cumsum(mass) / mass.sum(), table["n_rows"].to_numpy()[at], table[dataset_col].combine_chunks().take(pa.array(at)))
    schema = T.StructType([draws.schema[c] for c in ([split_col] if split_col else []) + ["draw"]]
                          + [weights.schema[dataset_col], T.StructField("local_index", T.LongType())])

    def run(batches):
        for b in batches:
            names = b.column("_split").to_pylist() if split_col else [None] * b.num_rows
            u1, u2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_u1", "_u2"))
            for split in dict.fromkeys(names):
                at = np.flatnonzero([x == split for x in names]) if split_col else np.arange(b.num_rows)
                high, n_rows, datasets = tables[split]
                place = np.minimum(np.searchsorted(high, u1[at], side="right"), len(high) - 1)
                local = np.floor(u2[at] * n_rows[place]).astype(np.int64)
                part = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(([part.column("_split")] if split_col else []) + [part.column("draw"), datasets.take(pa.array(place)), pa.array(local)],
                                                 names=schema.fieldNames())

    rows = draws.select(*([F.col(split_col).alias("_split")] if split_col else []), "draw", "_u1", "_u2")
    return rows.mapInArrow(run, schema)


def weighted_sample(df: DataFrame, weights: DataFrame, dataset_col: str = "dataset", order_col: str = "id",
                    seed: str = "mix", split_col: str | None = None) -> DataFrame:
    """N draws with replacement (N = rows of ``df``, or of each split): (split?, draw, dataset, local_index,
    + row columns). No join on the weights; the drawn (dataset, local_index) meet their rows."""
    indexed = global_index(df, dataset_col, order_col, split_col)
    name = [F.col(split_col), F.lit(":")] if split_col else []
    draws = indexed.select(*([split_col] if split_col else []), F.col("global_index").alias("draw"),
                           hash_uniform(*name, F.col("global_index"), F.lit(":" + seed + ":d")).alias("_u1"),
                           hash_uniform(*name, F.col("global_index"), F.lit(":" + seed + ":r")).alias("_u2"))
    picked = _picker(weights, draws, dataset_col, split_col)
    return picked.join(indexed.drop("global_index", "n_rows"), [*_keys(dataset_col, split_col), "local_index"])


def hash_sample(df: DataFrame, n: int, id_col: str, seed: str = "sample", by: str | None = None) -> DataFrame:
    """The ``n`` rows (per ``by`` group) with the smallest seeded hash — a reproducible sample."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":" + seed)))
    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(h, F.col(id_col))
    return df.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= n)
