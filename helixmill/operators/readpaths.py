"""Paths of reads through a breakpoint graph: concordant reads, and chains of reads' breakpoints.

Sequence edges: (amplicon_id, seq_idx, chrom, start, end), numbered from 1 along each interval; edge e<k> is joined to
e<k+1> by the concordant edge c<k>. A path is an array such as [e1, c1, e2, d3, e7].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calling import numbered
from .joins import range_join
from .paths import is_valid, support


def edge_ranges(alignments: DataFrame, sequence: DataFrame, ids: list[str], least: int = 500) -> DataFrame:
    """(ids, amplicon_id, lo, hi): the edges an alignment covers; edges at its ends count from `least` bases of overlap on
    edges of at least that length. alignments: (ids, chrom, r_start, r_end half-open)."""
    a = alignments.where("r_end > r_start").select(*ids, "chrom", "r_start", (F.col("r_end") - 1).alias("r_last"))
    met = range_join(a, sequence, ["chrom"], ("r_start", "r_last"), ("start", "end"))
    overlap = F.least("r_last", "end") - F.greatest("r_start", "start") + 1
    long_enough = (overlap >= least) & (F.col("end") - F.col("start") + 1 >= least)
    return met.where(long_enough).groupBy(*ids, "amplicon_id").agg(F.min("seq_idx").alias("lo"), F.max("seq_idx").alias("hi"))


def run_of_edges(first: Column, last: Column) -> Column:
    """Edges from first to last in either direction, with the concordant edges between them."""
    name = lambda kind, k: F.concat(F.lit(kind), k.cast("string"))
    up = F.transform(F.sequence(first, last), lambda k: F.when(k < last, F.array(name("e", k), name("c", k))).otherwise(F.array(name("e", k))))
    down = F.transform(F.sequence(first, last), lambda k: F.when(k > last, F.array(name("e", k), name("c", k - 1))).otherwise(F.array(name("e", k))))
    return F.flatten(F.when(first <= last, up).otherwise(down))


def concordant_paths(alignments: DataFrame, sequence: DataFrame, ids: list[str], least: int = 500, min_mapq: int = 20) -> DataFrame:
    """(ids, amplicon_id, path) of well-mapped alignments that cover three sequence edges and more."""
    r = edge_ranges(alignments.where(F.col("mapq") >= min_mapq), sequence, ids, least).where("hi - lo >= 2")
    return r.select(*ids, "amplicon_id", run_of_edges(F.col("lo"), F.col("hi")).alias("path"))


def breakpoint_paths(steps: DataFrame) -> DataFrame:
    """(read_id, amplicon_id, chain, path): paths through one or several breakpoints of a read.

    steps: a row for each breakpoint i of a read (read_id, amplicon_id, i, d_idx, a_idx, b_idx, strand1, strand2, lo1, hi1,
    lo2, hi2): the discordant edge from sequence edge a_idx to b_idx, and the edge ranges of the alignments before and
    after it with the strands they run on. Breakpoints i and i + 1 share an alignment and make one path; a path that
    passes a discordant edge twice is left out.
    """
    w = Window.partitionBy("read_id", "amplicon_id").orderBy("i")
    opens = F.when(F.col("i") - F.lag("i").over(w) == 1, 0).otherwise(1)
    rows = steps.withColumn("opens", opens).withColumn("chain", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.struct("i", "d_idx", "a_idx", "b_idx", "strand1", "strand2", "lo1", "hi1", "lo2", "hi2")
    chains = rows.groupBy("read_id", "amplicon_id", "chain").agg(F.sort_array(F.collect_list(one)).alias("s"))
    chains = chains.where(F.size(F.array_distinct("s.d_idx")) == F.size("s"))
    head, tail = F.col("s")[0], F.element_at("s", -1)
    before = run_of_edges(F.when(head["strand1"] == "+", F.least(head["lo1"], head["a_idx"])).otherwise(F.greatest(head["hi1"], head["a_idx"])), head["a_idx"])
    after = run_of_edges(tail["b_idx"], F.when(tail["strand2"] == "+", F.greatest(tail["hi2"], tail["b_idx"])).otherwise(F.least(tail["lo2"], tail["b_idx"])))
    bridge = F.transform(F.sequence(F.lit(0), F.size("s") - 1), lambda k: F.concat(F.array(F.concat(F.lit("d"), F.col("s")[k]["d_idx"].cast("string"))), F.when(k < F.size("s") - 1, run_of_edges(F.col("s")[k]["b_idx"], F.col("s")[k + 1]["a_idx"])).otherwise(F.array().cast("array<string>"))))
    return chains.select("read_id", "amplicon_id", "chain", F.concat(before, F.flatten(bridge), after).alias("path"))


def pieces(alignments: DataFrame) -> DataFrame:
    """(read_id, place, chrom, lo, hi, strand, q_start, q_end): the stretches of reads along the reference, in the direction of
    travel. Alignments as in operators.reads; a column `gaps`, array of struct(next_start, curr_end) in the order of the
    reference (cigar.large_gaps), cuts an alignment at its deletions."""
    a = numbered(alignments)
    lo, hi = F.least("r_start", "r_end"), F.greatest("r_start", "r_end")
    gaps = F.coalesce("gaps", F.array().cast("array<struct<next_start:bigint,curr_end:bigint>>")) if "gaps" in a.columns else F.array().cast("array<struct<next_start:bigint,curr_end:bigint>>")
    a = a.withColumns({"__lo": lo, "__hi": hi, "__g": gaps})
    part = lambda k: F.struct(F.when(k == 0, F.col("__lo")).otherwise(F.get("__g", k - 1)["next_start"]).alias("lo"), F.when(k == F.size("__g"), F.col("__hi")).otherwise(F.get("__g", k)["curr_end"]).alias("hi"))
    parts = F.transform(F.sequence(F.lit(0), F.size("__g")), part)
    rows = a.select("read_id", "i", "chrom", "strand", "q_start", "q_end", F.posexplode(F.when(F.col("strand") == "-", F.reverse(parts)).otherwise(parts)).alias("sub", "p"))
    place = F.row_number().over(Window.partitionBy("read_id").orderBy("i", "sub")) - 1
    return rows.select("read_id", place.alias("place"), "i", "chrom", "p.lo", "p.hi", "strand", "q_start", "q_end")


def steps(parts: DataFrame, sequence: DataFrame, discordant: DataFrame, least: int = 500, tolerance: int = 100) -> DataFrame:
    """The steps that breakpoint_paths() takes, for every passage from a piece of a read to the next along a discordant edge.

    parts: pieces(); sequence: numbered edges; discordant: (amplicon_id, d_idx, chrom_a, pos_a, strand_a, chrom_b, pos_b,
    strand_b). A passage is along the edge, in either direction, whose ends are both nearer than the tolerance, the nearest
    if there are several. Of reads with several passages, those whose alignments overlap by more than the tolerance on the
    read are left out.
    """
    w = Window.partitionBy("read_id").orderBy("place")
    forward = F.col("strand") == "+"
    out = F.struct("chrom", F.when(forward, F.col("hi")).otherwise(F.col("lo")).alias("pos"), "strand")
    enter = F.struct("chrom", F.when(forward, F.col("lo")).otherwise(F.col("hi")).alias("pos"), F.translate("strand", "+-", "-+").alias("strand"))
    rows = parts.withColumn("x", out).withColumn("y", F.lead(enter).over(w)).withColumn("strand2", F.lead("strand").over(w))
    rows = rows.withColumn("overlap", F.when(F.lead("i").over(w) != F.col("i"), F.col("q_end") - F.lead("q_start").over(w))).where("y is not null")
    ends = lambda s, t: [F.col(f"{c}_{s}").alias(f"{c}_x") for c in ("chrom", "pos", "strand")] + [F.col(f"{c}_{t}").alias(f"{c}_y") for c in ("chrom", "pos", "strand")]
    both = discordant.select("amplicon_id", "d_idx", *ends("a", "b")).union(discordant.select("amplicon_id", "d_idx", *ends("b", "a"))).distinct()
    bins = F.explode(F.sequence(F.floor(F.col("x.pos") / tolerance) - 1, F.floor(F.col("x.pos") / tolerance) + 1))
    near = F.lit(True)
    for e in "xy":
        near = near & (F.col(f"{e}.chrom") == F.col(f"chrom_{e}")) & (F.col(f"{e}.strand") == F.col(f"strand_{e}")) & (F.abs(F.col(f"{e}.pos") - F.col(f"pos_{e}")) < tolerance)
    met = rows.select("read_id", "place", "strand", "strand2", "x", "y", "overlap", bins.alias("bin")).join(both.withColumn("of", F.floor(F.col("pos_x") / tolerance)), (F.col("bin") == F.col("of")) & (F.col("x.chrom") == F.col("chrom_x")) & near)
    off = F.abs(F.col("x.pos") - F.col("pos_x")) + F.abs(F.col("y.pos") - F.col("pos_y"))
    one = F.struct(off.alias("off"), "d_idx", "chrom_x", "pos_x", "strand_x", "chrom_y", "pos_y", "strand_y", "strand", "strand2", "overlap")
    best = met.groupBy("read_id", "place", "amplicon_id").agg(F.min(one).alias("m")).select("read_id", "place", "amplicon_id", "m.*")
    tip = sequence.select("amplicon_id", "seq_idx", "chrom", F.inline(F.array(F.struct(F.col("start").alias("pos"), F.lit("-").alias("strand")), F.struct(F.col("end").alias("pos"), F.lit("+").alias("strand")))))
    for e, name in (("x", "a_idx"), ("y", "b_idx")):
        own = tip.select("amplicon_id", F.col("seq_idx").alias(name), *[F.col(c).alias(f"{c}_{e}") for c in ("chrom", "pos")], F.col("strand").alias(f"strand_{e}"))
        best = best.join(own, ["amplicon_id", f"chrom_{e}", f"pos_{e}", f"strand_{e}"])
    cover = edge_ranges(parts.select("read_id", "place", "chrom", F.col("lo").alias("r_start"), (F.col("hi") + 1).alias("r_end")), sequence, ["read_id", "place"], least)
    best = best.join(cover.withColumnsRenamed({"lo": "lo1", "hi": "hi1"}), ["read_id", "place", "amplicon_id"], "left")
    best = best.join(cover.select("read_id", (F.col("place") - 1).alias("place"), "amplicon_id", F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), ["read_id", "place", "amplicon_id"], "left")
    many = Window.partitionBy("read_id", "amplicon_id")
    worst = parts.withColumn("o", F.when(F.lead("i").over(w) != F.col("i"), F.col("q_end") - F.lead("q_start").over(w))).groupBy("read_id").agg(F.max("o").alias("worst"))
    best = best.withColumn("n", F.count("*").over(many)).join(worst, "read_id").where((F.col("n") == 1) | F.col("worst").isNull() | (F.col("worst") <= tolerance))
    given = lambda c, other: F.coalesce(c, other).alias(c)
    return best.select("read_id", "amplicon_id", F.col("place").alias("i"), "d_idx", "a_idx", "b_idx", F.col("strand").alias("strand1"), "strand2", given("lo1", "a_idx"), given("hi1", "a_idx"), given("lo2", "b_idx"), given("hi2", "b_idx"))


def constraints(alignments: DataFrame, sequence: DataFrame, discordant: DataFrame, least: int = 500, tolerance: int = 100, min_mapq: int = 20, fewest: int = 5) -> DataFrame:
    """(amplicon_id, path, support) of all reads: those along discordant edges, and the concordant ones that pass none of them;
    valid paths of at least `fewest` edges, a path and its reverse being one."""
    along = steps(pieces(alignments), sequence, discordant, least, tolerance)
    found = breakpoint_paths(along).select("read_id", "amplicon_id", "path")
    low, high = F.least("r_start", "r_end"), F.greatest("r_start", "r_end")
    spans = alignments.select("read_id", "q_start", "q_end", "chrom", "strand", "mapq", low.alias("r_start"), (high + 1).alias("r_end"))
    plain = concordant_paths(spans, sequence, ["read_id", "q_start", "q_end", "r_start"], least, min_mapq)
    plain = plain.join(along.select("read_id").distinct(), "read_id", "left_anti").select("read_id", "amplicon_id", "path")
    every = found.union(plain).where((F.size("path") >= fewest) & is_valid(F.col("path")))
    return support(every, "amplicon_id")


def number_edges(sequence: DataFrame) -> DataFrame:
    """Sequence edges with seq_idx: their place in the amplicon, from 1."""
    from ..functions.chrom import sort_key

    w = Window.partitionBy("amplicon_id").orderBy(sort_key(F.col("chrom")), "start")
    return sequence.withColumn("seq_idx", F.row_number().over(w).cast("long"))
