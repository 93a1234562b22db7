"""Scores of a reconstruction against the truth: bins, similarity, copy-number ratio, matched edges, roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import band_semi_join, range_join


def genome_bins(*segments: DataFrame) -> DataFrame:
    """(chrom, start, end): stretches between neighbouring distinct ends of all segments (chrom, start, end)."""
    points = None
    for s in segments:
        own = s.select("chrom", F.col("start").alias("p")).union(s.select("chrom", F.col("end").alias("p")))
        points = own if points is None else points.union(own)
    w = Window.partitionBy("chrom").orderBy("p")
    return points.distinct().select("chrom", F.col("p").alias("start"), F.lead("p").over(w).alias("end")).where("end is not null")


def _counts(bins: DataFrame, segments: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Overlaps of half-open bins with half-open segments, by key."""
    b = bins.withColumn("b_last", F.col("end") - 1)
    s = segments.where("end > start").select(*keys, "chrom", F.col("start").alias("s0"), (F.col("end") - 1).alias("s1"))
    met = range_join(b, s, ["chrom"], ("start", "b_last"), ("s0", "s1"), bin_size=1_000_000)
    return met.groupBy("chrom", "start", "end", *keys).agg(F.count("*").alias(name))


def fragment_similarity(truth: DataFrame, cycles: DataFrame) -> DataFrame:
    """(cycle_id, similarity, length_ratio) of each cycle's segments against the true ones, over the bins of both.

    Bins that a cycle doesn't touch count with what the truth has there.
    """
    bins = genome_bins(truth, cycles)
    e1 = _counts(bins, truth, [], "e1").withColumn("len", F.col("end") - F.col("start"))
    e2 = _counts(bins, cycles, ["cycle_id"], "e2")
    total = e1.agg(F.sum(F.col("e1") * F.col("len")).alias("true_len"))
    both = e2.withColumn("len", F.col("end") - F.col("start")).join(e1.drop("len"), ["chrom", "start", "end"], "left").withColumn("e1", F.coalesce("e1", F.lit(0)))
    sums = both.groupBy("cycle_id").agg(F.sum(F.abs(F.col("e1") - F.col("e2")) * F.col("len")).alias("diff"), F.sum(F.greatest("e1", "e2") * F.col("len")).alias("most"), F.sum(F.col("e1") * F.col("len")).alias("met"), F.sum(F.col("e2") * F.col("len")).alias("own"))
    rest = F.col("true_len") - F.col("met")
    sums = sums.join(F.broadcast(total))  # one row
    return sums.select("cycle_id", (1 - (F.col("diff") + rest) / (F.col("most") + rest)).alias("similarity"), ((F.col("own") - F.col("true_len")) / F.col("true_len")).alias("length_ratio"))


def copy_number_ratio(cycles: DataFrame, edges: DataFrame, n: int = 1, least_cn: float = 5.0) -> DataFrame:
    """(cycle_id, ratio): length-weighted copy number of cyclic cycles over that of edges of at least least_cn.

    cycles: (cycle_id, chrom, start, end, iscyclic, weight); only the n largest are kept.
    """
    total = edges.where(F.col("cn") >= least_cn).agg(F.sum(F.col("cn") * F.abs(F.col("end") - F.col("start"))).alias("total"))
    own = cycles.where("iscyclic").groupBy("cycle_id").agg(F.sum(F.col("weight") * F.abs(F.col("end") - F.col("start"))).alias("w"))
    ranked = own.orderBy(F.desc("w"), "cycle_id").limit(n)
    return ranked.join(F.broadcast(total)).select("cycle_id", (F.col("w") / F.col("total")).alias("ratio"))  # one row


def top_ratio(cycles: DataFrame, edges: DataFrame, n: int = 1, least_cn: float = 5.0) -> DataFrame:
    """(ratio): the share of the n largest cyclic cycles together; one if there are no more than n cycles at all."""
    every = copy_number_ratio(cycles, edges, n, least_cn).agg(F.sum("ratio").alias("ratio"))
    count = cycles.where("iscyclic").agg(F.countDistinct("cycle_id").alias("k"))  # one row, as is the other
    return every.join(F.broadcast(count)).select(F.when(F.col("k") <= n, 1.0).otherwise(F.coalesce("ratio", F.lit(0.0))).alias("ratio"))


def matched_edges(truth: DataFrame, found: DataFrame, tolerance: int) -> DataFrame:
    """True edges (chrom1, pos1, strand1, chrom2, pos2, strand2) with a found one near, in either direction."""
    keys = ["chrom1", "strand1", "chrom2", "strand2"]
    turned = found.select(*[F.col(f"{c}{3 - k}").alias(f"{c}{k}") for k in (1, 2) for c in ("chrom", "pos", "strand")])
    return band_semi_join(truth, found.select(*turned.columns).union(turned), keys, ("pos1", "pos2"), tolerance)


def roll_up(scores: DataFrame, group: str, metrics: list[str], best_by: str) -> DataFrame:
    """For each group the best of every metric on its own, and the candidate best by one of them (ties: smaller id)."""
    return scores.groupBy(group).agg(*[F.max(m).alias(m) for m in metrics], F.min_by("candidate", F.struct(-F.col(best_by), F.col("candidate"))).alias("best"))
