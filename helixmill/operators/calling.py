"""Pairs of split alignments that may be breakpoints: inside intervals, between two intervals, into intervals, and deletions.

Alignments as in operators.reads, with r_start the larger end on the reverse strand. An alignment meets an interval if
r_start <= end and r_end >= start, as written: forward ones by overlap, reverse ones only if the interval holds them. That
is how the results were defined, and they must be the same.

Reads are followed by windows over their own alignments, intervals are met by range joins; no side is assumed small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..functions.cigar import large_gaps
from .joins import range_join
from .reads import READ_ORDER

FIELDS = ["chrom", "r_start", "r_end", "strand", "mapq", "q_start", "q_end", "nm_rate"]


def _per_read() -> WindowSpec:
    return Window.partitionBy("read_id").orderBy("i")


def numbered(alignments: DataFrame) -> DataFrame:
    """Alignments with i: their place in the read, from 0."""
    return alignments.withColumn("i", F.row_number().over(Window.partitionBy("read_id").orderBy(*READ_ORDER)) - 1)


def meeting(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Pairs of numbered alignments (read_id, i) and intervals (chrom, start, end, and any others) that they meet."""
    own = rows.select("read_id", "i", "chrom", "r_start", "r_end", F.least("r_start", "r_end").alias("lo"), F.greatest("r_start", "r_end").alias("hi"))
    there = intervals.withColumnsRenamed({"start": "i_start", "end": "i_end"})
    met = range_join(own, there, ["chrom"], ("lo", "hi"), ("i_start", "i_end"), bin_size=1_000_000)
    return met.where("r_start <= i_end and r_end >= i_start").drop("chrom", "r_start", "r_end", "lo", "hi")


def _followed(rows: DataFrame, *more: str) -> DataFrame:
    """rows with the fields of the next alignment (f1) and of the one after it (f2), and the gaps on the read."""
    for k in (1, 2):
        for c in ["i", *FIELDS, *more]:
            rows = rows.withColumn(f"{c}_{k}", F.lead(c, k).over(_per_read()))
    return rows.withColumn("gap_1", F.col("q_start_1") - F.col("q_end")).withColumn("gap_2", F.col("q_start_2") - F.col("q_end"))


def _good(params: Params, k: int) -> Column:
    return (F.col("mapq") >= params.min_mapq) & (F.col(f"mapq_{k}") >= params.min_mapq)


def _pairs(rows: DataFrame, k: int, *more: str) -> DataFrame:
    """Rows as pairs of their alignment and the one k places on."""
    ends = [F.col(c).alias(f"{c}1") for c in FIELDS] + [F.col(f"{c}_{k}").alias(f"{c}2") for c in FIELDS]
    return rows.select("read_id", "i", F.col(f"i_{k}").alias("j"), F.col(f"gap_{k}").alias("gap"), *ends, *more)


def _neighbours(rows: DataFrame, first: Column, second: Column, params: Params, *more: str) -> DataFrame:
    """Pairs (i, i + 1) for which `first` holds, and pairs (i, i + 2) around a badly mapped alignment for which `second` holds
    where neither pair with that alignment was taken."""
    rows = rows.withColumn("taken", F.coalesce(first, F.lit(False)))
    rows = rows.withColumn("taken_1", F.lead("taken").over(_per_read()))
    span = ~F.col("taken") & ~F.coalesce("taken_1", F.lit(False)) & (F.col("mapq_1") < params.gap_mapq) & _good(params, 2) & second
    return _pairs(rows.where("taken"), 1, *more).unionByName(_pairs(rows.where(F.coalesce(span, F.lit(False))), 2, *more))


def pairs_within(alignments: DataFrame, intervals: DataFrame, params: Params = DEFAULT, least_gap: int = 100) -> DataFrame:
    """Pairs of alignments in the same interval that don't follow each other on the reference.

    intervals: (idx, chrom, start, end); an alignment belongs to the one of smallest idx that it meets. Neighbouring pairs
    need different strands, or a gap on the reference that differs from the one on the read by more than `least_gap` and a
    fifth of the latter. Pairs around a badly mapped alignment need the same strand, or such a gap.
    """
    rows = numbered(alignments)
    home = meeting(rows, intervals).groupBy("read_id", "i").agg(F.min("idx").alias("idx"))
    rows = _followed(rows.join(home.select("read_id").distinct(), "read_id", "left_semi").join(home, ["read_id", "i"], "left"), "idx")

    def differ(k: int) -> Column:
        gap = F.col(f"gap_{k}")
        return F.abs(F.abs(F.col(f"r_start_{k}") - F.col("r_end")) - gap) > F.greatest(F.lit(float(least_gap)), F.abs(gap * 0.2))

    near = (F.col("gap_1") + params.match_cutoff >= 0) & _good(params, 1) & (F.col("idx") == F.col("idx_1"))
    first = near & ((F.col("strand") != F.col("strand_1")) | differ(1))
    second = (F.col("idx") == F.col("idx_2")) & ((F.col("strand") == F.col("strand_2")) | differ(2))
    return _neighbours(rows, first, second, params, "idx")


def pairs_between(alignments: DataFrame, links: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Pairs of alignments that lead from one interval of a link to the other, in either direction, with link_id.

    links: (link_id, chrom_n, start_n, end_n, chrom_o, start_o, end_o).
    """
    rows = numbered(alignments)
    side = lambda s, bit: links.select("link_id", F.col(f"chrom_{s}").alias("chrom"), F.col(f"start_{s}").alias("start"), F.col(f"end_{s}").alias("end"), F.lit(bit).alias("side"))
    met = meeting(rows, side("n", 1).union(side("o", 2))).groupBy("read_id", "i", "link_id").agg(F.bit_or("side").alias("sides"))
    rows = _followed(rows.join(met.select("read_id").distinct(), "read_id", "left_semi"))
    both = rows.join(met, ["read_id", "i"])
    crosses = lambda x, y: (F.col(x).bitwiseAND(1) > 0) & (F.col(y).bitwiseAND(2) > 0) | (F.col(x).bitwiseAND(2) > 0) & (F.col(y).bitwiseAND(1) > 0)

    def to(k: int) -> DataFrame:
        there = met.select("read_id", F.col("i").alias(f"i_{k}"), "link_id", F.col("sides").alias("sides_to"))
        return both.join(there, ["read_id", f"i_{k}", "link_id"]).where(crosses("sides", "sides_to"))

    first = _pairs(to(1).where((F.col("gap_1") + params.match_cutoff >= 0) & _good(params, 1)), 1, "link_id")
    second = to(2).where((F.col("mapq_1") < params.gap_mapq) & _good(params, 2))
    taken = first.select("read_id", "link_id", F.explode(F.array(F.col("i"), F.col("i") - 1)).alias("i"))  # of either pair with i + 1
    return first.unionByName(_pairs(second.join(taken, ["read_id", "link_id", "i"], "left_anti"), 2, "link_id"))


def pairs_into(alignments: DataFrame, intervals: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Pairs of alignments of which exactly one meets any of the intervals (chrom, start, end)."""
    rows = numbered(alignments)
    home = meeting(rows, intervals).select("read_id", "i").distinct().withColumn("inside", F.lit(True))
    rows = rows.join(home.select("read_id").distinct(), "read_id", "left_semi").join(home, ["read_id", "i"], "left")
    rows = _followed(rows.withColumn("inside", F.coalesce("inside", F.lit(False))), "inside")
    return _neighbours(rows, _good(params, 1) & (F.col("inside") != F.col("inside_1")), F.col("inside") != F.col("inside_2"), params)


def small_deletions(records: DataFrame, intervals: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Breakpoints of large gaps inside single alignments of records (read_id, chrom, pos, cigar, mapq) that overlap an
    interval (chrom, start, end), once for each such interval: the later end on the reverse strand is node a."""
    rows = records.where(F.col("mapq") >= params.min_mapq).withColumn("gaps", large_gaps(F.col("cigar"), F.col("pos"), params.min_deletion)).where(F.size("gaps") > 0)
    last = F.col("pos") + F.aggregate(F.transform(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1)), lambda n: n.cast("long")), F.lit(0).cast("long"), lambda s, n: s + n) - 1
    rows = rows.withColumn("last", last)
    there = intervals.select("chrom", F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    met = range_join(rows, there, ["chrom"], ("pos", "last"), ("i_start", "i_end"), bin_size=1_000_000)
    one = met.select("read_id", "chrom", F.explode("gaps").alias("g"))
    a, b = F.greatest("g.next_start", "g.curr_end"), F.least("g.next_start", "g.curr_end")
    return one.select("read_id", F.lit(0).cast("long").alias("gap"), F.col("chrom").alias("chrom_a"), a.alias("pos_a"), F.lit("-").alias("strand_a"), F.col("chrom").alias("chrom_b"), b.alias("pos_b"), F.lit("+").alias("strand_b"))


def accepted_calls(calls: DataFrame, intervals: DataFrame, least: int, normal_cov: float = 0.0, params: Params = DEFAULT) -> DataFrame:
    """The calls (KEY, cluster, call, pos_a, pos_b, support) that become breakpoints outside of a refinement, with the
    amplicons of their ends: of a cluster the first call only, if it has support and both ends are in intervals
    (amplicon_id, chrom, start, end); calls whose ends aren't are passed over, a call without support ends the search.
    """
    few = (F.col("support") < least) & (F.col("support") < max(normal_cov * params.min_bp_support, 3.0))
    rows = calls.withColumn("few", few).withColumn("row", F.monotonically_increasing_id())
    for s in "ab":
        ends = rows.withColumn("chrom", F.col(f"chrom_{s}")).withColumn("to", F.col(f"pos_{s}"))
        there = intervals.select("chrom", F.col("start").alias("i_start"), F.col("end").alias("i_end"), F.col("amplicon_id").alias("amp"))
        met = range_join(ends, there, ["chrom"], (f"pos_{s}", "to"), ("i_start", "i_end"), how="left", bin_size=1_000_000)
        rows = met.groupBy(*rows.columns).agg(F.min("amp").alias(f"amp_{s}"))
    inside = F.col("amp_a").isNotNull() & F.col("amp_b").isNotNull()
    key = ["chrom_a", "chrom_b", "strand_a", "strand_b", "cluster"]
    w = Window.partitionBy(*key).orderBy("call").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max((F.col("few") | inside).cast("int")).over(w), F.lit(0))
    return rows.withColumn("ended", ended).where(~F.col("few") & inside & (F.col("ended") == 0)).drop("few", "row", "ended")
