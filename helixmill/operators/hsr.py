"""Integration sites of amplified sequence elsewhere in the genome (homogeneously staining regions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..functions.chrom import is_canonical, sort_key
from ..storage import stored
from .calling import pairs_into
from .clustering import KEY, call_breakpoints, cluster, merge_calls
from .joins import point_join, range_join
from .reads import orient


def site_calls(alignments: DataFrame, amplified: DataFrame, normal_cov: float, params: Params = DEFAULT) -> DataFrame:
    """(KEY, pos_a, pos_b, support): exact breakpoints of pairs of which exactly one alignment meets the amplified intervals
    (chrom, start, end), on primary chromosomes, with at least half the normal coverage as support. Calls nearer than the
    match cutoff are one. Alignments follow each other as on the read."""
    least = params.hsr_cluster * normal_cov
    pairs = pairs_into(alignments.where(is_canonical(F.col("chrom"))), amplified, params)
    points = stored(orient(pairs).select("read_id", "gap", "chrom_a", "pos_a", "strand_a", "chrom_b", "pos_b", "strand_b"), "points")
    calls = call_breakpoints(cluster(points, params, least=least), params, least)
    return merge_calls(stored(calls, "calls"), params.match_cutoff, closed=True)


def sites(alignments: DataFrame, amplified: DataFrame, segments: DataFrame, normal_cov: float, params: Params = DEFAULT) -> DataFrame:
    """(chrom, pos, support, KEY, pos_a, pos_b) of the calls with one end in the amplified intervals, extended by the match
    cutoff, and the other, (chrom, pos), outside of them, on a segment (chrom, seg_start, seg_end, cn) of at most
    params.hsr_cn copies or on none, with limited support."""
    wide = amplified.select("chrom", (F.col("start") - params.match_cutoff).alias("i_start"), (F.col("end") + params.match_cutoff).alias("i_end"))
    rows = stored(site_calls(alignments, amplified, normal_cov, params).withColumn("row", F.monotonically_increasing_id()), "sites")
    for side in "ab":
        ends = rows.withColumn("to", F.col(f"pos_{side}")).withColumn("chrom", F.col(f"chrom_{side}"))
        met = range_join(ends, wide, ["chrom"], (f"pos_{side}", "to"), ("i_start", "i_end"), how="left", bin_size=1_000_000)
        rows = met.groupBy(*rows.columns).agg(F.max(F.col("i_start").isNotNull()).alias(f"in_{side}"))
    outer = F.when(F.col("in_a"), F.struct(F.col("chrom_b").alias("chrom"), F.col("pos_b").alias("pos"))).otherwise(F.struct(F.col("chrom_a").alias("chrom"), F.col("pos_a").alias("pos")))
    rows = rows.where("in_a <> in_b").where(F.col("support") <= params.hsr_support * normal_cov).withColumn("o", outer)
    rows = rows.select("o.chrom", "o.pos", "support", *KEY, "pos_a", "pos_b")
    known = point_join(rows, segments.select("chrom", "seg_start", "seg_end", "cn"), ["chrom"], "pos", ("seg_start", "seg_end"))
    cn = F.when((F.col("pos") > F.col("seg_start")) & (F.col("pos") < F.col("seg_end")), F.col("cn")).otherwise(0.0)  # ends of a segment aren't in it
    return known.where(cn <= params.hsr_cn).drop("seg_start", "seg_end", "cn")


def genome_axis(sizes: DataFrame) -> DataFrame:
    """(chrom, x1, x2, middle): chromosomes (chrom, size) side by side on an axis of 100 units, in their order."""
    from pyspark.sql import Window

    w = Window.orderBy(sort_key(F.col("chrom")))  # a row for each chromosome
    total = F.sum("size").over(Window.partitionBy())
    run = F.sum("size").over(w)
    rows = sizes.withColumn("x1", (run - F.col("size")) * 100.0 / total).withColumn("x2", run * 100.0 / total)
    return rows.select("chrom", "x1", "x2", ((F.col("x1") + F.col("x2")) / 2).alias("middle"))


def on_axis(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sites with x, their place on the genome axis; those on chromosomes without a size are left out."""
    axis = genome_axis(sizes).join(sizes, "chrom").select("chrom", (F.col("x1") + F.lit(0.0)).alias("x1"), ((F.col("x2") - F.col("x1")) / F.col("size")).alias("unit"))
    return found.join(axis, "chrom").withColumn("x", F.col("x1") + F.col("pos") * F.col("unit")).drop("x1", "unit")
