"""Gaps and islands over intervals, so that no chromosome meets in one task: rows are ordered inside bins of their start, and
bins know of those before them only how far they reach. An interval longer than a bin is in the bin of its start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 10_000_000


def merge_intervals(df: DataFrame, keys: list[str], pad: int = 0, carry: dict[str, str] | None = None, bin_size: int = BIN) -> DataFrame:
    """Merge intervals (keys, start, end) of a key that start within end + pad; carry: column to aggregate.

    What a bin needs of the bins before it is how far their intervals reach: one row a bin goes over a whole key. An island
    opens in a bin where nothing before it reaches; islands are numbered in their bin, and those of later bins that an
    earlier one reaches into get the number of the last one opened before.
    """
    carry = carry or {}
    rows = df.select(*keys, "start", "end", *carry)
    if set(carry.values()) <= {"sum", "min", "max"}:  # copies become one row before any bin meets in a task
        rows = rows.groupBy(*keys, "start", "end").agg(*[F.expr(f"{f}({c})").alias(c) for c, f in carry.items()]) if carry else rows.distinct()
    rows = rows.withColumn("__bin", F.floor(F.col("start") / bin_size))
    sums = rows.groupBy(*keys, "__bin").agg(F.max("end").alias("__reach"))
    over = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums.withColumn("__before", F.max("__reach").over(over)).drop("__reach"), [*keys, "__bin"])
    w = Window.partitionBy(*keys, "__bin").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    met = F.greatest("__before", F.max("end").over(w))
    rows = rows.withColumn("__new", F.when(met.isNull() | (F.col("start") > met + pad), 1).otherwise(0))
    upto = Window.partitionBy(*keys, "__bin").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__k", F.sum("__new").over(upto))  # 0: belongs to the last island of the bins before
    aggs = [F.expr(f"{f}({c})").alias(c) for c, f in carry.items()]
    parts = rows.groupBy(*keys, "__bin", "__k").agg(F.min("start").alias("start"), F.max("end").alias("end"), *aggs)
    last = parts.where("__k > 0").groupBy(*keys, "__bin").agg(F.max("__k").alias("__last"))
    bins = sums.select(*keys, "__bin").join(last, [*keys, "__bin"], "left")
    opened = F.last(F.when(F.col("__last").isNotNull(), F.struct("__bin", F.col("__last").alias("__k"))), ignorenulls=True).over(over)
    parts = parts.join(bins.select(*keys, "__bin", opened.alias("__opened")), [*keys, "__bin"])
    home = F.when(F.col("__k") > 0, F.struct("__bin", "__k")).otherwise(F.col("__opened"))
    return parts.groupBy(*keys, home.alias("__island")).agg(F.min("start").alias("start"), F.max("end").alias("end"), *[F.expr(f"{f}({c})").alias(c) for c, f in carry.items()]).drop("__island")


def adjacent_islands(df: DataFrame, keys: list[str], carry: dict[str, str] | None = None) -> DataFrame:
    """Merge intervals that abut (start = end + 1) or overlap."""
    return merge_intervals(df, keys, 1, carry)


def subtract(left: DataFrame, right: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Pieces (id_col, keys, start, end) of the left intervals that no right interval covers.

    The right side is merged first, so a left interval meets each covered stretch once, in order.
    """
    from .joins import range_join

    cover = merge_intervals(right, keys)
    hits = range_join(left, cover.select(*keys, F.col("start").alias("c_start"), F.col("end").alias("c_end")), keys, ("start", "end"), ("c_start", "c_end"), how="left")
    w = Window.partitionBy(id_col).orderBy("c_start")
    gap_from = F.coalesce(F.lag("c_end").over(w) + 1, F.col("start"))
    gaps = hits.select(id_col, *keys, gap_from.alias("s"), F.least(F.coalesce(F.col("c_start") - 1, F.col("end")), F.col("end")).alias("e"), F.col("end").alias("limit"), "c_end", F.lead("c_start").over(w).alias("more"))
    tail = gaps.where(F.col("more").isNull() & F.col("c_end").isNotNull()).select(id_col, *keys, (F.col("c_end") + 1).alias("start"), F.col("limit").alias("end"))
    head = gaps.select(id_col, *keys, F.col("s").alias("start"), F.col("e").alias("end"))
    return head.union(tail).where(F.col("start") <= F.col("end"))
