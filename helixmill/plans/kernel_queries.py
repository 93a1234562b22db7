"""Copy-number fit, multiplicities, walks and comparisons: queries over the test tables.

Two stretches of each chromosome are amplicons; their graphs have some twenty discordant edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import testbed as t
from ..operators import coverage, graph, kernels, paths, readpaths, reads
from ..registry import query
from ..storage import stored

COVERAGE = 40.0
POINT = ["chrom_a", "pos_a", "strand_a", "chrom_b", "pos_b", "strand_b"]


def alignments(spark, sf_dir) -> DataFrame:
    """The reads folded onto two stretches of each chromosome, beginning at one of three places and 1500 bases long, so that
    many reads share their ends. As supplementary tags give them: on the reverse strand r_start is the larger end."""
    a = t.alignments(spark, sf_dir)
    low = F.floor(F.col("r_start") / 1_000_000) % 2 * 1_000_000 + F.floor((F.col("q_end") - F.col("q_start")) / 90 / 17) * 1000
    back = F.col("strand") == "-"
    a = a.withColumn("low", low)
    return a.withColumns({"r_start": F.when(back, F.col("low") + 1500).otherwise(F.col("low")), "r_end": F.when(back, F.col("low")).otherwise(F.col("low") + 1500)}).drop("low")


def bins(rows) -> DataFrame:
    """Intervals around the reads' stretches, one amplicon each."""
    at = F.floor(F.least("r_start", "r_end") / 1_000_000)
    key = F.regexp_replace("chrom", "chr", "").cast("long") * 100 + at
    return rows.select(key.alias("amplicon_id"), "chrom", (at * 1_000_000).alias("start"), (at * 1_000_000 + 5_999).alias("end")).distinct()


def edges(spark, sf_dir) -> DataFrame:
    """The edges of all amplicons' graphs, as a written table."""
    rows = stored(alignments(spark, sf_dir), "alignments")
    plain = rows.withColumns({"r_start": F.least("r_start", "r_end"), "r_end": F.greatest("r_start", "r_end")})
    b = stored(reads.orient(reads.adjacent_pairs(rows)).select("read_id", *POINT), "breakpoints")
    inside = b.where((F.col("chrom_a") == F.col("chrom_b")) & (F.floor(F.col("pos_a") / 1_000_000) == F.floor(F.col("pos_b") / 1_000_000)))
    calls = inside.groupBy(*POINT).agg(F.count("*").alias("reads")).where("reads >= 3 and pos_a <> pos_b")
    own = stored(bins(rows), "bins")
    found = stored(graph.discordant_edges(calls, own), "discordant")
    cuts = stored(graph.split_points(own, graph.ends_of(found)), "cuts")
    pieces = stored(graph.sequence_edges(own, cuts), "pieces")
    blocks = plain.select("chrom", F.col("r_start").alias("b_start"), F.col("r_end").alias("b_end"))
    covered = coverage.raw_coverage(coverage.read_counts(pieces, plain, ["chrom"], bin_size=2_000), blocks, ["chrom"], bin_size=2_000)
    joints = graph.concordant_edges(cuts)
    used = inside.select("read_id", F.inline(F.array(*[F.struct(F.col(f"chrom_{s}").alias("chrom"), F.col(f"pos_{s}").alias("pos")) for s in "ab"])))
    support = graph.concordant_support(joints.select("chrom", "pos1", "pos2").distinct(), plain, used)
    return stored(kernels.edge_table(covered, joints.join(support, ["chrom", "pos1", "pos2"]), found), "edges")


def constraints(spark, sf_dir, fitted: DataFrame) -> DataFrame:
    """The maximal paths of reads through the amplicons' graphs, along discordant edges and along none."""
    seq = readpaths.number_edges(fitted.where("kind = 'sequence'").select("amplicon_id", F.col("chrom1").alias("chrom"), F.col("pos1").alias("start"), F.col("pos2").alias("end")))
    ends = ["chrom1", "pos1", "strand1", "chrom2", "pos2", "strand2"]
    d = fitted.where("kind = 'discordant'").withColumn("d_idx", F.row_number().over(Window.partitionBy("amplicon_id").orderBy(*ends)))
    d = d.select("amplicon_id", "d_idx", *[F.col(c).alias(f"{c[:-1]}_{'a' if c[-1] == '1' else 'b'}") for c in ends])
    found = readpaths.constraints(stored(alignments(spark, sf_dir), "alignments"), stored(seq, "sequence"), d, least=20)
    return kernels.path_constraints(stored(paths.maximal(found), "maximal"), seq, d)


@query()
def cn_fit(spark, sf_dir):
    return stored(kernels.fit_copy_number(edges(spark, sf_dir), COVERAGE), "fitted")


@query()
def multiplicities(spark, sf_dir):
    return kernels.edge_multiplicities(edges(spark, sf_dir))


@query()
def greedy_cycles(spark, sf_dir):
    fitted = cn_fit(spark, sf_dir)
    return kernels.decompose(fitted, "greedy", constraints(spark, sf_dir, fitted))


@query()
def fewest_cycles(spark, sf_dir):
    fitted = cn_fit(spark, sf_dir)
    return kernels.decompose(fitted, "fewest", constraints(spark, sf_dir, fitted))


@query()
def walk_legality(spark, sf_dir):
    fitted = cn_fit(spark, sf_dir)
    return kernels.legality(fitted, kernels.decompose(fitted, constraints=constraints(spark, sf_dir, fitted)))


@query()
def path_constraints(spark, sf_dir):
    """The maximal paths of reads through each amplicon's graph, with the edges they pass."""
    return constraints(spark, sf_dir, edges(spark, sf_dir))


@query()
def constraint_satisfaction(spark, sf_dir):
    """How many path constraints the greedy walks of each amplicon satisfy."""
    fitted = cn_fit(spark, sf_dir)
    return kernels.satisfaction(fitted, constraints(spark, sf_dir, fitted))


def _true_cycles(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    info = t.walk_info(spark, sf_dir)
    heaviest = info.withColumn("r", F.row_number().over(Window.partitionBy("amplicon_id").orderBy(F.desc("weight"), "cycle_id"))).where("r = 1")
    rows = t.walks(spark, sf_dir).withColumn("end", F.col("end") + 1)
    every = rows.join(info.select("cycle_id", "amplicon_id"), "cycle_id")
    truth = rows.join(heaviest.select("cycle_id", "amplicon_id"), "cycle_id")
    return every, truth.toDF(*[f"true_{c}" for c in truth.columns])  # own names: both sides come from one table


@query()
def lcs_score(spark, sf_dir):
    every, truth = _true_cycles(spark, sf_dir)
    return kernels.compare_cycles(every, truth).select("amplicon_id", "cycle_id", "overlap", "overlap_share")


@query()
def triplet_score(spark, sf_dir):
    every, truth = _true_cycles(spark, sf_dir)
    return kernels.compare_cycles(every, truth).select("amplicon_id", "cycle_id", "triplets")


@query()
def euler_walks(spark, sf_dir):
    """The order of each greedy walk, found again from how often it passes its edges."""
    fitted = cn_fit(spark, sf_dir)
    rows = kernels.walk_passes(fitted, constraints(spark, sf_dir, fitted))
    return kernels.order_walks(fitted, rows)
