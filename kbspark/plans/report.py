"""Order dynamics by region and month, with problem regions flagged (O-92).

orders ⋈ customer ⋈ nation ⋈ region → monthly order count and revenue per region → change
against the previous month (``lag``) → in the latest month, regions whose change is below
the average change of all regions. The aggregate is partial map-side, so five hot region keys
cost one small row per task before the shuffle; the nation/region dimensions are broadcast
after a row-count check, the customer join is a regular shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kbspark.operators.joins import bounded_broadcast


def _dim(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    b = bounded_broadcast(df, max_rows)
    return b if b is not None else df


def monthly_by_region(orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    o = orders.select("o_custkey", "o_totalprice", F.date_trunc("month", F.col("o_orderdate")).cast("timestamp")
                      .alias("month"))
    c = customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    geo = _dim(nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
               .join(_dim(region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")), "n_regionkey"))
    j = o.join(c, "o_custkey").join(geo, "c_nationkey")
    m = j.groupBy("r_name", "month").agg(F.count(F.lit(1)).alias("n_orders"),
                                         F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    w = Window.partitionBy("r_name").orderBy("month")
    # the month before, not the row before: a month without orders has no change after it
    follows = F.lag("month").over(w) == F.add_months("month", -1).cast("timestamp")
    return (m.withColumn("prev_revenue", F.when(follows, F.lag("revenue").over(w)))
            .withColumn("revenue_change", F.round(F.col("revenue") - F.col("prev_revenue"), 2)))


def problem_regions(monthly: DataFrame) -> DataFrame:
    latest = monthly.select(F.max("month")).scalar()
    last = monthly.where(F.col("month") == latest)
    avg_change = last.select(F.avg("revenue_change")).scalar()
    return last.select("r_name", "month", "n_orders", "revenue", "revenue_change",
                       F.round(avg_change, 2).alias("avg_change"),
                       F.coalesce(F.col("revenue_change") < avg_change, F.lit(False)).alias("is_problem"))
