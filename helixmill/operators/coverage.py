"""Raw coverage of intervals by aligned blocks, fixed windows, and the baseline coverage of a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chrom import is_autosome
from .joins import BIN, range_join


def raw_coverage(intervals: DataFrame, blocks: DataFrame, keys: list[str], bin_size: int = BIN) -> DataFrame:
    """intervals (keys, start, end closed, ...) with `bases`: bases of half-open blocks (keys, b_start, b_end) inside."""
    ids = intervals.columns
    closed = blocks.where("b_end > b_start").withColumn("b_last", F.col("b_end") - 1)
    hits = range_join(intervals, closed, keys, ("start", "end"), ("b_start", "b_last"), bin_size=bin_size)
    clipped = F.least(F.col("b_end"), F.col("end") + 1) - F.greatest(F.col("b_start"), F.col("start"))
    sums = hits.groupBy(*ids).agg(F.sum(clipped).alias("bases"))
    return intervals.join(sums, ids, "left").withColumn("bases", F.coalesce("bases", F.lit(0)).cast("long"))


def read_counts(intervals: DataFrame, alignments: DataFrame, keys: list[str], bin_size: int = BIN) -> DataFrame:
    """intervals (keys, start, end closed, ...) with `reads`: half-open alignments (keys, r_start, r_end) that reach into them."""
    ids = intervals.columns
    closed = alignments.where("r_end > r_start").select(*keys, "r_start", (F.col("r_end") - 1).alias("r_last"))
    hits = range_join(intervals, closed, keys, ("start", "end"), ("r_start", "r_last"), bin_size=bin_size)
    counted = hits.groupBy(*ids).agg(F.count("*").alias("reads"))
    return intervals.join(counted, ids, "left").withColumn("reads", F.coalesce("reads", F.lit(0)).cast("long"))


def windows(intervals: DataFrame, size: int) -> DataFrame:
    """Cut closed intervals into windows of `size` bases from their start; the last may be shorter."""
    starts = F.explode(F.sequence(F.col("start"), F.col("end"), F.lit(size).cast("long")))
    cut = intervals.withColumn("w_start", starts)
    return cut.withColumn("w_end", F.least(F.col("w_start") + size - 1, F.col("end"))).drop("start", "end").withColumnsRenamed({"w_start": "start", "w_end": "end"})


def window_size(length: F.Column) -> F.Column:
    """Width of coverage windows by the span shown."""
    return F.when(length >= 1_000_000, 10_000).when(length >= 100_000, 1_000).otherwise(150)


def baseline_segments(segments: DataFrame, least: int) -> DataFrame:
    """Autosomal segments (chrom, start, end, cn, ord) around the 1/2.4 quantile of copy number, in rings of two until they
    hold `least` bases. One row per segment of one sample, so the ranking window is small."""
    ranked = segments.where(is_autosome(F.col("chrom"))).withColumn("rank", F.row_number().over(Window.orderBy("cn", "ord")) - 1)
    n = F.count("*").over(Window.partitionBy())
    ranked = ranked.withColumn("im", F.floor(n / 2.4).cast("int"))
    ring = F.when(F.col("rank") > F.col("im"), F.col("rank") - F.col("im") - 1).otherwise(F.col("im") - F.col("rank"))
    ranked = ranked.withColumn("ring", ring).withColumn("len", F.col("end") - F.col("start") + 1)
    before = F.coalesce(F.sum("len").over(Window.orderBy("ring").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("before", before).where(F.col("before") < least).drop("before", "im", "rank")


def normal_coverage(segments: DataFrame, blocks: DataFrame, least: int) -> DataFrame:
    """One row: n_segments, total_length, bases, normal_cov."""
    rings = baseline_segments(segments, least).select("chrom", "start", "end")
    covered = raw_coverage(rings, blocks, ["chrom"], bin_size=1_000_000)
    n, length, bases = F.count("*"), F.sum(F.col("end") - F.col("start") + 1), F.sum("bases")
    return covered.agg(n.alias("n_segments"), length.alias("total_length"), bases.alias("bases")).withColumn("normal_cov", F.col("bases") / F.col("total_length"))
