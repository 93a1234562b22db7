"""Split alignments of reads: supplementary tags, neighbouring pairs, orientation of breakpoints, statistics.

Alignments: (read_id, q_start, q_end, chrom, r_start, r_end, strand, mapq, nm_rate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..functions.chrom import sort_key
from ..functions.cigar import query_bounds

READ_ORDER = ["q_start", "q_end", "chrom", "r_start", "strand", "mapq", "nm_rate"]


def from_sa_tags(tags: DataFrame) -> DataFrame:
    """Alignments from (read_id, sa): `chrom,pos,strand,CIGAR,mapq,NM;` lists. Positions become 0-based and closed; on the
    reverse strand r_start is the larger end. A read with a record lacking a soft clip or a match is dropped whole."""
    one = tags.select("read_id", F.explode(F.array_distinct(F.filter(F.split("sa", ";"), lambda x: x != ""))).alias("sa")).distinct()
    t = F.split("sa", ",")
    rows = one.select("read_id", t[0].alias("chrom"), t[1].cast("long").alias("pos"), t[2].alias("strand"), t[3].alias("cigar"), t[4].cast("int").alias("mapq"), F.element_at(t, -1).cast("double").alias("nm"))
    fine = F.col("cigar").contains("S") & (F.col("cigar").contains("M") | F.col("cigar").contains("="))
    bad = rows.where(~fine).select("read_id").distinct()
    rows = rows.join(bad, "read_id", "left_anti").withColumn("q", query_bounds(F.col("cigar"), F.col("strand")))
    low, high = F.col("pos") - 1, F.col("pos") + F.col("q.ref_len") - 2
    forward = F.col("strand") == "+"
    return rows.select("read_id", "q.q_start", "q.q_end", "chrom", F.when(forward, low).otherwise(high).alias("r_start"), F.when(forward, high).otherwise(low).alias("r_end"), "strand", "mapq", (F.col("nm") / (F.col("q.q_end") - F.col("q.q_start"))).alias("nm_rate"))


def _neighbours(alignments: DataFrame, step: int) -> DataFrame:
    w = Window.partitionBy("read_id").orderBy(*READ_ORDER)
    names = ["chrom", "r_start", "r_end", "strand", "mapq", "q_start", "q_end", "nm_rate"]
    out = alignments.withColumn("i", F.row_number().over(w) - 1)
    for c in names:
        out = out.withColumn(f"{c}2", F.lead(c, step).over(w))
    return out.withColumnsRenamed({c: f"{c}1" for c in names}).where("chrom2 is not null").withColumn("gap", F.col("q_start2") - F.col("q_end1"))


def supports(params: Params = DEFAULT) -> Column:
    """Both ends well mapped, and not overlapping by more than the match cutoff on the read."""
    return (F.col("gap") + params.match_cutoff >= 0) & (F.col("mapq1") >= params.min_mapq) & (F.col("mapq2") >= params.min_mapq)


def adjacent_pairs(alignments: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Consecutive alignments of a read that may support a breakpoint."""
    return _neighbours(alignments, 1).where(supports(params))


def spanning_pairs(alignments: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Pairs (i - 1, i + 1) around a badly mapped alignment, where neither neighbouring pair supports a breakpoint."""
    w = Window.partitionBy("read_id").orderBy(*READ_ORDER)
    ok = (F.lead("q_start").over(w) - F.col("q_end") + params.match_cutoff >= 0) & (F.col("mapq") >= params.min_mapq) & (F.lead("mapq").over(w) >= params.min_mapq)
    marked = alignments.withColumn("used", F.coalesce(ok, F.lit(False)))
    pairs = _neighbours(alignments, 2)
    flags = marked.withColumn("i", F.row_number().over(w) - 1).select("read_id", "i", "used", F.lead("used").over(w).alias("used_next"), F.lead("mapq").over(w).alias("mapq_mid"))
    joined = pairs.join(flags, ["read_id", "i"])
    free = ~F.col("used") & ~F.coalesce("used_next", F.lit(False))
    good = (F.col("mapq_mid") < params.gap_mapq) & (F.col("mapq1") >= params.min_mapq) & (F.col("mapq2") >= params.min_mapq)
    return joined.where(free & good).drop("used", "used_next", "mapq_mid")


def orient(pairs: DataFrame, pos1: str = "r_end1", pos2: str = "r_start2") -> DataFrame:
    """Breakpoints (chrom_a, pos_a, strand_a, chrom_b, pos_b, strand_b, reversed) with node a the higher end."""
    k1, k2 = sort_key(F.col("chrom1")), sort_key(F.col("chrom2"))
    keep = (k2 < k1) | ((k2 == k1) & (F.col(pos2) < F.col(pos1)))
    other = F.translate("strand2", "+-", "-+")
    first = F.struct(F.col("chrom1").alias("chrom"), F.col(pos1).alias("pos"), F.col("strand1").alias("strand"))
    second = F.struct(F.col("chrom2").alias("chrom"), F.col(pos2).alias("pos"), other.alias("strand"))
    a, b = F.when(keep, first).otherwise(second), F.when(keep, second).otherwise(first)
    out = pairs.withColumn("a", a).withColumn("b", b).withColumn("reversed", keep)
    for side in "ab":
        for c in ("chrom", "pos", "strand"):
            out = out.withColumn(f"{c}_{side}", F.col(f"{side}.{c}"))
    return out.drop("a", "b")


def ordered_nodes(chrom1: Column, pos1: Column, strand1: Column, chrom2: Column, pos2: Column, strand2: Column) -> tuple[Column, Column]:
    """The lower and the higher end of an edge: by chromosome, position, then reverse before forward strand."""
    node = lambda c, p, s: F.struct(sort_key(c).alias("k"), p.alias("pos"), F.when(s == "-", 0).otherwise(1).alias("o"), c.alias("chrom"), s.alias("strand"))
    x, y = node(chrom1, pos1, strand1), node(chrom2, pos2, strand2)
    return F.least(x, y), F.greatest(x, y)


def is_close(chrom_a: str, pos_a: str, strand_a: str, chrom_b: str, pos_b: str, strand_b: str, distance: int = 200) -> Column:
    """Whether two breakpoints, with column prefixes x_ and y_, have the same chromosomes and strands and ends nearer than
    `distance`."""
    same = [F.col(f"x_{c}") == F.col(f"y_{c}") for c in (chrom_a, chrom_b, strand_a, strand_b)]
    near = [F.abs(F.col(f"x_{p}") - F.col(f"y_{p}")) < distance for p in (pos_a, pos_b)]
    return same[0] & same[1] & same[2] & same[3] & near[0] & near[1]


def is_self_loop(edge: str = "") -> Column:
    """Whether an edge (chrom1, pos1, strand1, chrom2, pos2, strand2) joins a node with itself."""
    e = lambda c: F.col(f"{edge}{c}")
    return (e("chrom1") == e("chrom2")) & (e("pos1") == e("pos2")) & (e("strand1") == e("strand2"))


def joins_pieces(chrom1: Column, pos1: Column, pos2: Column, chrom: Column, end: Column, start: Column) -> Column:
    """Whether an edge leads from the end of one sequence edge to the start of another."""
    return (chrom1 == chrom) & (pos1 == end) & (pos2 == start)


def edit_distance(alignments: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation of the edit rate."""
    return alignments.groupBy(*by).agg(F.count("*").alias("n"), F.avg("nm_rate").alias("mean"), F.stddev_pop("nm_rate").alias("std"))


def segment_hits(alignments: DataFrame, segments: DataFrame) -> DataFrame:
    """Alignments with the index of the segment (chrom, seg_start, seg_end, seg_idx) that holds each end, or null."""
    from .joins import point_join

    s = segments.select("chrom", "seg_start", "seg_end", "seg_idx")
    low = point_join(alignments, s, ["chrom"], "r_start", ("seg_start", "seg_end")).withColumnRenamed("seg_idx", "idx_start").drop("seg_start", "seg_end")
    return point_join(low, s, ["chrom"], "r_end", ("seg_start", "seg_end")).withColumnRenamed("seg_idx", "idx_end").drop("seg_start", "seg_end")


def shared_reads(hits: DataFrame, least: int = 1) -> DataFrame:
    """Pairs of different segments (chrom, idx) that share reads, with their number.

    hits: (read_id, chrom, idx). A read's segments are few, so pairs are made inside the read, by an equi-join on it.
    """
    one = hits.where("idx is not null").select("read_id", "chrom", "idx").distinct()
    x = one.select("read_id", F.struct("chrom", "idx").alias("x"))
    y = one.select("read_id", F.struct("chrom", "idx").alias("y"))
    pairs = x.join(y, "read_id").where(F.col("x") < F.col("y"))
    out = pairs.groupBy("x", "y").agg(F.count("*").alias("reads")).where(F.col("reads") >= least)
    return out.select(F.col("x.chrom").alias("chrom1"), F.col("x.idx").alias("idx1"), F.col("y.chrom").alias("chrom2"), F.col("y.idx").alias("idx2"), "reads")
