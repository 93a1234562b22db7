"""Growing amplicon intervals: widening to copy-number segments, one search level, and the search itself.

Segments: (chrom, seg_idx, seg_start, seg_end, cn), closed and not overlapping. hits: (read_id, chrom, idx).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..functions.chrom import sort_key
from ..storage import stored
from .calling import pairs_between
from .clustering import call_breakpoints, cluster
from .islands import merge_intervals, subtract
from .joins import point_join, range_join
from .reads import orient


def widen(intervals: DataFrame, segments: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Snap intervals (interval_id, chrom, start, end) to the segments of their ends, and past them by the interval delta
    where there is a segment to reach into."""
    d = params.interval_delta
    s = segments.select("chrom", "seg_start", "seg_end")
    one = lambda df, pos, name: point_join(df, s.withColumn(name, F.col("seg_start")), ["chrom"], pos, ("seg_start", "seg_end"))
    low = one(intervals, "start", "l_start").drop("seg_start", "seg_end")
    both = point_join(low, s, ["chrom"], "end", ("seg_start", "seg_end")).withColumnRenamed("seg_end", "r_end").drop("seg_start")
    both = both.withColumn("reach_l", F.col("l_start") - d).withColumn("reach_r", F.col("r_end") + d)
    both = point_join(both, s.withColumn("has_l", F.lit(True)), ["chrom"], "reach_l", ("seg_start", "seg_end")).drop("seg_start", "seg_end")
    both = point_join(both, s.withColumn("has_r", F.lit(True)), ["chrom"], "reach_r", ("seg_start", "seg_end")).drop("seg_start", "seg_end")
    start = F.when(F.col("has_l"), F.col("reach_l")).otherwise(F.coalesce("l_start", "start"))
    end = F.when(F.col("has_r"), F.col("reach_r")).otherwise(F.coalesce("r_end", "end"))
    return both.select("interval_id", "chrom", start.alias("start"), end.alias("end"))


def next_level(frontier: DataFrame, hits: DataFrame, least: int, max_idx_gap: int = 2, segments: DataFrame | None = None, params: Params = DEFAULT, by: tuple[str, ...] = ()) -> DataFrame:
    """Segment stretches (by, chrom, first_idx, last_idx, reads) that share at least `least` reads with the frontier.

    frontier: (by, chrom, idx) of its segments; by: a column whose values are followed apart. Reads reach the join through
    the frontier's segments only. Stretches join segments at most max_idx_gap apart and, if the segments are given, with at
    most max_interval bases between them.
    """
    front = frontier.select(*by, "chrom", "idx").distinct()
    reads = hits.join(front, ["chrom", "idx"]).select(*by, "read_id").distinct()
    others = hits.join(reads, "read_id").join(front, [*by, "chrom", "idx"], "left_anti")
    found = others.groupBy(*by, "chrom", "idx").agg(F.countDistinct("read_id").alias("reads")).where(F.col("reads") >= least)
    w = Window.partitionBy(*by, "chrom").orderBy("idx")
    near = F.col("idx") - F.lag("idx").over(w) <= max_idx_gap
    if segments is not None:
        found = found.join(segments.select("chrom", F.col("seg_idx").alias("idx"), "seg_start", "seg_end"), ["chrom", "idx"])
        near = near & (F.col("seg_start") - F.lag("seg_end").over(w) <= params.max_interval)
    opens = F.when(near, 0).otherwise(1)
    runs = found.withColumn("opens", opens).withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "chrom", "run").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.sum("reads").alias("reads")).drop("run")


def padded(stretches: DataFrame, segments: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Stretches of segments as intervals padded by the interval delta, not below 0."""
    s = segments.select("chrom", "seg_idx", "seg_start", "seg_end")
    first = stretches.join(s.select("chrom", F.col("seg_idx").alias("first_idx"), F.col("seg_start").alias("start")), ["chrom", "first_idx"])
    both = first.join(s.select("chrom", F.col("seg_idx").alias("last_idx"), F.col("seg_end").alias("end")), ["chrom", "last_idx"])
    return both.select("chrom", F.greatest(F.lit(0), F.col("start") - params.interval_delta).alias("start"), (F.col("end") + params.interval_delta).alias("end"))


def refined(ends: DataFrame, segments: DataFrame, by: list[str], params: Params = DEFAULT) -> DataFrame:
    """Intervals (by, chrom, start, end) around the ends (by, chrom, pos) of called breakpoints.

    Ends are taken in the order of segment and position. A run of them breaks at another chromosome, at more than two
    segments, at a gap between segments of more than half of max_interval, at more than max_interval between ends, and
    where neither segment is amplified also at a gap of two or a distance of three interval deltas. A run reaches from its
    first to its last end, each moved out by the interval delta: from the end itself, or from its whole segment if that is
    amplified; but no further than half of max_interval from the end nor beyond the chromosome's segments, and only to
    where there is a segment.
    """
    d, most = params.interval_delta, params.max_interval
    s = segments.select("chrom", "seg_idx", "seg_start", "seg_end", "cn")
    rows = point_join(ends.select(*by, "chrom", "pos"), s, ["chrom"], "pos", ("seg_start", "seg_end")).where("seg_idx is not null")
    w = Window.partitionBy(*by).orderBy(sort_key(F.col("chrom")), "seg_idx", "pos")
    last = lambda c: F.lag(c).over(w)
    gap, far = F.col("seg_start") - last("seg_end"), F.col("pos") - last("pos")
    plain = (F.col("cn") < params.interval_cn) & (last("cn") < params.interval_cn)
    breaks = (F.col("chrom") != last("chrom")) | (F.col("seg_idx") - last("seg_idx") > 2) | (gap > most / 2) | (far > most) | (plain & ((gap > 2 * d) | (far > 3 * d)))
    rows = rows.withColumn("opens", F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("seg_idx", "pos", "seg_start", "seg_end", "cn")
    runs = rows.groupBy(*by, "chrom", "run").agg(F.min(at).alias("l"), F.max(at).alias("r"))
    bounds = s.groupBy("chrom").agg(F.min("seg_start").alias("low"), F.max("seg_end").alias("high"))
    runs = runs.join(bounds, "chrom")
    rich = lambda side: F.col(f"{side}.cn") >= params.interval_cn
    left = F.greatest(F.when(rich("l"), F.col("l.seg_start")).otherwise(F.col("l.pos")) - d, "low")
    left = F.when((F.col("l.cn") != 0) & (F.col("l.pos") - most // 2 > left), F.col("l.pos") - most // 2).otherwise(left)
    right = F.least(F.when(rich("r"), F.col("r.seg_end")).otherwise(F.col("r.pos")) + d, "high", F.col("r.pos") + most // 2)
    runs = runs.select(*by, "chrom", left.alias("start"), right.alias("end"), F.col("l.seg_start").alias("l_start"), F.col("r.seg_end").alias("r_end"))
    for side, there in (("start", "l_start"), ("end", "r_end")):
        met = point_join(runs, s.select("chrom", "seg_start", "seg_end"), ["chrom"], side, ("seg_start", "seg_end"))
        runs = met.withColumn(side, F.when(F.col("seg_start").isNull(), F.col(there)).otherwise(F.col(side))).drop("seg_start", "seg_end")
    return runs.select(*by, "chrom", "start", "end")


def called_stretches(frontier: DataFrame, stretches: DataFrame, alignments: DataFrame, segments: DataFrame, least: int, params: Params = DEFAULT) -> DataFrame:
    """(chrom, start, end): stretches (interval_id, chrom, first_idx, last_idx) refined by the breakpoints that link them with
    the frontier's interval (interval_id, chrom, start, end) they were found from. A call's end in the stretch is what the
    new interval is made around; ends outside of both are refined among themselves."""
    s = segments.select("chrom", "seg_idx", "seg_start", "seg_end")
    new = stretches.join(s.select("chrom", F.col("seg_idx").alias("first_idx"), F.col("seg_start").alias("start_n")), ["chrom", "first_idx"])
    new = new.join(s.select("chrom", F.col("seg_idx").alias("last_idx"), F.col("seg_end").alias("end_n")), ["chrom", "last_idx"])
    old = frontier.select("interval_id", F.col("chrom").alias("chrom_o"), F.col("start").alias("start_o"), F.col("end").alias("end_o"))
    links = stored(new.join(old, "interval_id").select(F.monotonically_increasing_id().alias("link_id"), F.col("chrom").alias("chrom_n"), "start_n", "end_n", "chrom_o", "start_o", "end_o"), "links")
    points = orient(pairs_between(alignments, links, params)).select("link_id", "read_id", "gap", "chrom_a", "pos_a", "strand_a", "chrom_b", "pos_b", "strand_b")
    clusters = cluster(stored(points, "points"), params, least=least, by=("link_id",))
    calls = call_breakpoints(clusters, params, least, by=("link_id",)).join(links, "link_id")
    within = lambda e, s: (F.col(f"chrom_{e}") == F.col(f"chrom_{s}")) & F.col(f"pos_{e}").between(F.col(f"start_{s}"), F.col(f"end_{s}"))
    end = lambda e, kind: F.struct(F.lit(kind).alias("kind"), F.col(f"chrom_{e}").alias("chrom"), F.col(f"pos_{e}").alias("pos"))
    kind = lambda e: F.when(within(e, "n"), "new").otherwise("other")
    ends = F.when(within("a", "o") & within("b", "n"), F.array(end("b", "new"))).when(within("b", "o") & within("a", "n"), F.array(end("a", "new")))
    ends = ends.otherwise(F.array(F.struct(kind("a").alias("kind"), F.col("chrom_a").alias("chrom"), F.col("pos_a").alias("pos")), F.struct(kind("b").alias("kind"), F.col("chrom_b").alias("chrom"), F.col("pos_b").alias("pos"))))
    return refined(calls.select("link_id", F.inline(ends)), segments, ["link_id", "kind"], params).select("chrom", "start", "end")


def search(seeds: DataFrame, hits: DataFrame, segments: DataFrame, least: int, params: Params = DEFAULT, alignments: DataFrame | None = None) -> DataFrame:
    """Breadth-first search from seed intervals (chrom, start, end) over shared reads, a batch a level.

    Stretches that share reads with an interval are refined by the breakpoints between the two (called_stretches), if the
    alignments are given, else padded. A level's new intervals are what the known ones leave of it; the search ends when a
    level adds nothing, however deep that is: known intervals only grow. Only that fact reaches the driver.
    """
    s = segments.select("chrom", "seg_idx", "seg_start", "seg_end")

    def segments_of(intervals: DataFrame) -> DataFrame:
        met = range_join(intervals.select("interval_id", "chrom", "start", "end"), s, ["chrom"], ("start", "end"), ("seg_start", "seg_end"), bin_size=1_000_000)
        return met.select("interval_id", "chrom", F.col("seg_idx").alias("idx")).distinct()

    number = lambda df: stored(df.withColumn("interval_id", F.monotonically_increasing_id()), "frontier")
    known = stored(merge_intervals(seeds, ["chrom"], 1), "intervals")
    frontier = number(known)
    while True:
        met = segments_of(frontier)
        if alignments is None:
            new = padded(next_level(met, hits, least, segments=segments, params=params), segments, params)
        else:
            level = stored(next_level(met, hits, least, segments=segments, params=params, by=("interval_id",)), "stretches")
            new = called_stretches(frontier, level, alignments, segments, least, params)
        new = new.withColumn("interval_id", F.monotonically_increasing_id())
        new = stored(subtract(new, known, ["chrom"], "interval_id").select("chrom", "start", "end").distinct(), "level")
        if not new.limit(1).count():
            return known
        frontier = number(merge_intervals(new, ["chrom"], 1))
        known = stored(merge_intervals(known.select("chrom", "start", "end").union(new), ["chrom"], 1), "intervals")
