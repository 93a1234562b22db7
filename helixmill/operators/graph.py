"""Breakpoint graphs: split points, sequence, concordant and discordant edges, support, statistics.

Intervals: (amplicon_id, chrom, start, end), closed. Breakpoints: ends with chrom, pos and strand; a forward end closes
the sequence edge at its position, a reverse end opens one there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .joins import range_join


def ends_of(breakpoints: DataFrame) -> DataFrame:
    """Distinct ends (chrom, pos, strand) of breakpoints with sides a and b."""
    side = lambda s: breakpoints.select(F.col(f"chrom_{s}").alias("chrom"), F.col(f"pos_{s}").alias("pos"), F.col(f"strand_{s}").alias("strand"))
    return side("a").union(side("b")).distinct()


def split_points(intervals: DataFrame, ends: DataFrame, bin_size: int = 1_000_000) -> DataFrame:
    """(amplicon_id, chrom, start, end, cut): positions after which an interval is cut; a reverse end cuts before itself."""
    cut = F.when(F.col("strand") == "+", F.col("pos")).otherwise(F.col("pos") - 1)
    cuts = ends.select("chrom", cut.alias("cut")).distinct()
    cuts = cuts.withColumn("cut_to", F.col("cut"))
    met = range_join(intervals, cuts, ["chrom"], ("start", "end"), ("cut", "cut_to"), bin_size=bin_size)
    return met.where((F.col("cut") >= F.col("start")) & (F.col("cut") < F.col("end"))).select(*intervals.columns, "cut")


def sequence_edges(intervals: DataFrame, cuts: DataFrame) -> DataFrame:
    """(amplicon_id, chrom, start, end): the pieces between an interval's split points."""
    keys = ["amplicon_id", "chrom", "start", "end"]
    opens = intervals.select(*keys, F.col("start").alias("s")).union(cuts.select(*keys, (F.col("cut") + 1).alias("s"))).distinct()
    w = Window.partitionBy(*keys).orderBy("s")
    return opens.select("amplicon_id", "chrom", F.col("s").alias("seq_start"), F.coalesce(F.lead("s").over(w) - 1, F.col("end")).alias("seq_end")).withColumnsRenamed({"seq_start": "start", "seq_end": "end"})


def concordant_edges(cuts: DataFrame) -> DataFrame:
    """(amplicon_id, chrom, pos1, pos2): joints of neighbouring pieces, forward end to the reverse end one base on."""
    return cuts.select("amplicon_id", "chrom", F.col("cut").alias("pos1"), (F.col("cut") + 1).alias("pos2")).distinct()


def discordant_edges(breakpoints: DataFrame, intervals: DataFrame) -> DataFrame:
    """Breakpoints with both ends in intervals of one amplicon, with its id."""
    for side in "ab":
        breakpoints = breakpoints.withColumn(f"to_{side}", F.col(f"pos_{side}"))
    out = breakpoints
    for side in "ab":
        own = intervals.select(F.col("amplicon_id").alias(f"amp_{side}"), F.col("chrom").alias(f"chrom_{side}"), F.col("start").alias(f"s_{side}"), F.col("end").alias(f"e_{side}"))
        out = range_join(out, own, [f"chrom_{side}"], (f"pos_{side}", f"to_{side}"), (f"s_{side}", f"e_{side}"), bin_size=1_000_000).drop(f"s_{side}", f"e_{side}")
    return out.where("amp_a = amp_b").withColumnRenamed("amp_a", "amplicon_id").drop("amp_b", "to_a", "to_b")


def read_spans(alignments: DataFrame, margin: int) -> DataFrame:
    """(read_id, chrom, lo, hi): the positions p for which a read covers p, p + 1 and the bases margin + 1 away on either side,
    by alignments (read_id, chrom, r_start, r_end), half-open; a read's spans don't meet.

    p - margin - 1 lies in a stretch i of what the read covers, p and p + 1 in a stretch j, p + margin + 1 in a stretch k.
    Other stretches than j itself are near it, so there are few.
    """
    cover = alignments.where("r_end > r_start").select("read_id", "chrom", F.col("r_start").cast("long").alias("s"), (F.col("r_end") - 1).cast("long").alias("e"))
    w = Window.partitionBy("read_id", "chrom").orderBy("s", "e")
    rows = cover.withColumn("reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach") + 1), 1).otherwise(0)
    rows = rows.withColumn("k", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = rows.groupBy("read_id", "chrom", "k").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    own = stretches.groupBy("read_id", "chrom").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("own"))
    far, one = margin + 1, F.size("own") == 1
    each = own.withColumn("j", F.explode("own"))
    left = F.filter("own", lambda x: (x["e"] + far >= F.col("j.s")) & (x["s"] <= F.col("j.s")))
    right = F.filter("own", lambda x: (x["s"] - far <= F.col("j.e")) & (x["s"] >= F.col("j.s")))
    each = each.withColumn("i", F.explode(F.when(one, F.col("own")).otherwise(left)))
    each = each.withColumn("k", F.explode(F.when(one, F.col("own")).otherwise(right)))
    lo = F.greatest(F.col("i.s") + far, F.col("j.s"), F.col("k.s") - far)
    hi = F.least(F.col("i.e") + far, F.col("j.e") - 1, F.col("k.e") - far)
    return each.select("read_id", "chrom", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")


def held(spans: DataFrame, points: DataFrame, bin_size: int = 100_000) -> DataFrame:
    """points (chrom, pos, distinct) with `n`: how many spans (chrom, lo, hi), closed, hold them.

    Running sums of spans opened less spans closed, in order inside bins; across bins goes one row a bin.
    """
    counted = spans.groupBy("chrom", "lo", "hi").agg(F.count("*").alias("n"))
    steps = counted.select("chrom", F.inline(F.array(F.struct(F.col("lo").alias("pos"), F.col("n").alias("d")), F.struct((F.col("hi") + 1).alias("pos"), (-F.col("n")).alias("d")))))
    steps = steps.groupBy("chrom", "pos").agg(F.sum("d").alias("d")).withColumn("asked", F.lit(0))
    marks = points.select("chrom", F.col("pos").cast("long").alias("pos"), F.lit(0).cast("long").alias("d"), F.lit(1).alias("asked"))
    rows = steps.union(marks).groupBy("chrom", "pos").agg(F.sum("d").alias("d"), F.max("asked").alias("asked"))
    rows = stored(rows.withColumn("bin", F.floor(F.col("pos") / bin_size)), "steps")
    before = F.coalesce(F.sum("d").over(Window.partitionBy("chrom").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = rows.groupBy("chrom", "bin").agg(F.sum("d").alias("d")).select("chrom", "bin", before.alias("before"))
    here = F.sum("d").over(Window.partitionBy("chrom", "bin").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("here", here).where("asked = 1").join(bins, ["chrom", "bin"]).select("chrom", "pos", (F.col("before") + F.col("here")).alias("n"))


def concordant_support(joints: DataFrame, alignments: DataFrame, excluded: DataFrame, margin: int = 100) -> DataFrame:
    """joints (chrom, pos1, pos2) with reads: reads that cover both ends and `margin` bases beyond on each side, without
    those (read_id, chrom, pos) that support a discordant edge at one of the ends.

    alignments: (read_id, chrom, r_start, r_end), half-open; copies don't matter. For joints one base wide no pair of a joint
    and a read is made: the spans of reads that hold a joint are counted, and those of excluded reads, which meet the joint
    by its position, taken away. Other joints are met with the alignments pair by pair.
    """
    wide = joints.where("pos2 <> pos1 + 1")
    one = _held_support(joints.where("pos2 = pos1 + 1"), alignments, excluded, margin)
    return one.union(_met_support(wide, alignments, excluded, margin)) if wide.limit(1).count() else one


def _held_support(joints: DataFrame, alignments: DataFrame, excluded: DataFrame, margin: int) -> DataFrame:
    spans = read_spans(alignments, margin)
    points = joints.select("chrom", F.col("pos1").alias("pos")).distinct()
    ends = points.select("chrom", F.col("pos").alias("joint"), F.explode(F.array("pos", F.col("pos") + 1)).alias("pos"))
    out = excluded.select("read_id", "chrom", F.col("pos").cast("long").alias("pos")).join(ends, ["chrom", "pos"])
    out = out.select("read_id", "chrom", "joint").repartition("read_id", "chrom").distinct()
    out = out.join(spans, ["read_id", "chrom"]).where("joint between lo and hi").groupBy("chrom", "joint").agg(F.count("*").alias("out"))
    found = held(spans, points).join(out.withColumnRenamed("joint", "pos"), ["chrom", "pos"], "left")
    found = found.select("chrom", F.col("pos").alias("pos1"), (F.col("n") - F.coalesce("out", F.lit(0))).alias("reads"))
    return joints.join(found, ["chrom", "pos1"], "left").select(*joints.columns, F.coalesce("reads", F.lit(0)).cast("long").alias("reads"))


def _met_support(joints: DataFrame, alignments: DataFrame, excluded: DataFrame, margin: int) -> DataFrame:
    reach = joints.select("chrom", "pos1", "pos2", (F.col("pos1") - margin - 1).alias("from"), (F.col("pos2") + margin).alias("to"))
    cover = alignments.where("r_end > r_start").select("read_id", "chrom", "r_start", (F.col("r_end") - 1).alias("r_last"))
    met = range_join(reach, cover, ["chrom"], ("from", "to"), ("r_start", "r_last"))
    covers = lambda c, bit: F.when((F.col(c) >= F.col("r_start")) & (F.col(c) <= F.col("r_last")), bit).otherwise(0)
    mask = covers("pos1", 1) + covers("pos2", 2) + covers("from", 4) + covers("to", 8)
    full = met.groupBy("chrom", "pos1", "pos2", "read_id").agg(F.bit_or(mask).alias("seen")).where(F.col("seen") == 15)
    used = excluded.select("read_id", "chrom", F.col("pos").alias("used")).distinct()
    for end in ("pos1", "pos2"):
        full = full.join(used.withColumnRenamed("used", end), ["read_id", "chrom", end], "left_anti")
    counted = full.groupBy("chrom", "pos1", "pos2").agg(F.count("*").alias("reads"))
    return joints.join(counted, ["chrom", "pos1", "pos2"], "left").select(*joints.columns, F.coalesce("reads", F.lit(0)).cast("long").alias("reads"))


def statistics(sequence: DataFrame, concordant: DataFrame, discordant: DataFrame, intervals: DataFrame) -> DataFrame:
    """One row per amplicon: numbers of edges and nodes, size and chromosomes. Every sequence edge has two nodes. An interval
    has two end nodes, and each of these a source and an end edge in both directions."""
    one = sequence.groupBy("amplicon_id").agg(F.count("*").alias("n_sequence"), F.sum(F.col("end") - F.col("start") + 1).alias("size"), F.countDistinct("chrom").alias("n_chromosomes"))
    for df, name in ((concordant, "n_concordant"), (discordant, "n_discordant"), (intervals, "n_intervals")):
        one = one.join(df.groupBy("amplicon_id").agg(F.count("*").alias(name)), "amplicon_id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    inner = F.col("n_sequence") + F.col("n_concordant") + F.col("n_discordant")
    return one.withColumn("n_nodes", 2 * F.col("n_sequence")).withColumn("n_nonsource", inner).withColumn("n_source", 4 * F.col("n_intervals")).withColumn("n_edges", inner + 4 * F.col("n_intervals"))


def faults(sequence: DataFrame, concordant: DataFrame, discordant: DataFrame) -> DataFrame:
    """(amplicon_id, kind, fault) of edges that a graph can't have: sequence edges that end before they start or overlap another
    of their chromosome, concordant edges whose ends aren't one base apart or aren't ends of pieces, and discordant edges
    with an end that is no end of a piece."""
    w = Window.partitionBy("amplicon_id", "chrom").orderBy("start", "end")
    rows = sequence.withColumn("before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    bad = F.when(F.col("end") < F.col("start"), "ends before it starts").when(F.col("before") >= F.col("start"), "overlaps another")
    out = rows.withColumn("fault", bad).where("fault is not null").select("amplicon_id", F.lit("sequence").alias("kind"), "fault")
    nodes = sequence.select("amplicon_id", "chrom", F.inline(F.array(F.struct(F.col("start").alias("pos"), F.lit("-").alias("strand")), F.struct(F.col("end").alias("pos"), F.lit("+").alias("strand")))))

    def loose(edges: DataFrame, kind: str, ends: list[tuple[Column, Column, Column]]) -> DataFrame:
        each = edges.select("amplicon_id", F.inline(F.array(*[F.struct(a.alias("chrom"), b.alias("pos"), c.alias("strand")) for a, b, c in ends])))
        return each.join(nodes, ["amplicon_id", "chrom", "pos", "strand"], "left_anti").select("amplicon_id", F.lit(kind).alias("kind"), F.lit("has an end at no piece").alias("fault"))

    c = F.col
    out = out.union(concordant.where("pos2 <> pos1 + 1").select("amplicon_id", F.lit("concordant"), F.lit("its ends aren't neighbours")))
    out = out.union(loose(concordant, "concordant", [(c("chrom"), c("pos1"), F.lit("+")), (c("chrom"), c("pos2"), F.lit("-"))]))
    return out.union(loose(discordant, "discordant", [(c(f"chrom_{s}"), c(f"pos_{s}"), c(f"strand_{s}")) for s in "ab"]))
