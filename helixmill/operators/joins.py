"""Range joins as equi-joins on (key, bin) with a residual, for either side of any size.

Both sides are expanded to the bins they touch; a pair is kept only in the bin that holds the larger of the two starts, so
it comes out once. Long intervals cost a row a bin; choose the bin near the usual interval length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

BIN = 100_000


def _binned(df: DataFrame, start: Column, end: Column, size: int, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.floor(start / size), F.floor(end / size))))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_on: tuple[str, str], right_on: tuple[str, str], how: str = "inner", bin_size: int = BIN) -> DataFrame:
    """Pairs of rows with equal keys whose closed intervals overlap; columns of both, the right keys dropped.

    how: inner, left (unmatched left rows with nulls) or left_semi.
    """
    (ls, le), (rs, re) = left_on, right_on
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"__{k}")
    # a row a bin isn't in the planner's estimate of a side, so neither side is broadcast by it
    r = _binned(r.where(F.col(rs) <= F.col(re)), F.col(rs), F.col(re), bin_size, "__rbin").hint("merge")
    # the numbers are read by several branches, so they are written once
    marked = stored(left.withColumn("__id", F.monotonically_increasing_id()), "numbered") if how == "left" else left
    l = _binned(marked.where(F.col(ls) <= F.col(le)), F.col(ls), F.col(le), bin_size, "__lbin")  # noqa: E741
    on = F.col("__lbin") == F.col("__rbin")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    on = on & (F.col(ls) <= F.col(re)) & (F.col(le) >= F.col(rs))
    if how == "left_semi":
        return l.join(r, on, "left_semi").drop("__lbin").distinct()
    once = F.floor(F.greatest(F.col(ls), F.col(rs)) / bin_size) == F.col("__lbin")
    out = [*left.columns, *[c for c in right.columns if c not in keys]]
    if how == "inner":
        return l.join(r, on & once).select(*out)
    # a left row is unmatched if it has no pair in any of its bins
    pairs = l.join(r, on & once).select("__id", *out)
    rest = marked.where(F.col(ls) <= F.col(le)).join(l.join(r, on, "left_semi").select("__id").distinct(), "__id", "left_anti")
    nulls = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right.columns if c not in keys]
    return pairs.select(*out).union(rest.select(*left.columns, *nulls))


def point_join(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str, on: tuple[str, str], bin_size: int = 1_000_000) -> DataFrame:
    """Left join of points with the interval that holds them. Intervals of a key must not overlap."""
    s, e = on
    r = _binned(intervals, F.col(s), F.col(e), bin_size, "__bin")
    for k in keys:
        r = r.withColumnRenamed(k, f"__{k}")
    cond = (F.floor(F.col(pos) / bin_size) == F.col("__bin")) & (F.col(pos) >= F.col(s)) & (F.col(pos) <= F.col(e))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    return points.join(r, cond, "left").drop("__bin", *[f"__{k}" for k in keys])


def band_semi_join(left: DataFrame, right: DataFrame, keys: list[str], pos: tuple[str, str], tolerance: int) -> DataFrame:
    """Left rows with a right row of equal keys, both positions (named alike) less than `tolerance` apart."""
    p, q = pos
    near = F.sequence(F.floor(F.col(p) / tolerance) - 1, F.floor(F.col(p) / tolerance) + 1)
    r = right.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(p).alias("__p"), F.col(q).alias("__q")).withColumn("__bin", F.floor(F.col("__p") / tolerance)).distinct()
    l = left.withColumn("__near", F.explode(near))  # noqa: E741
    cond = (F.col("__near") == F.col("__bin")) & (F.abs(F.col(p) - F.col("__p")) < tolerance) & (F.abs(F.col(q) - F.col("__q")) < tolerance)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    return l.join(r, cond, "left_semi").drop("__near").distinct()
