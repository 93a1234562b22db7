"""Plot geometry as tables: layout of intervals, arcs, bars, gene lanes and axis limits."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chrom import sort_key
from .joins import range_join

MARGIN = 1.5
EXTENSION = 1.5  # how far connectors of walks reach beyond their segments
#: Colours by the strands of an edge, and limits of axes, arcs and text.
COLOURS = {"+-": "red", "++": "magenta", "-+": "#8b4513", "--": "teal", "interchromosomal": "blue"}
COVERAGE_HEADROOM, ARC_PADDING, LEAST_APEX, MOST_APEX = 1.25, 0.05, 1.25, 2.0
GENE_FONT, MOST_TEXT_SCALE = 12.0, 2.0


def layout(intervals: DataFrame, plot: str, margin: float = MARGIN, order: list[str] | None = None) -> DataFrame:
    """Intervals side by side on an axis of 100 units, with x1 and x2; one group of rows a plot. They are in genomic order, or
    in that of the columns `order` and in genomic order where these are equal."""
    w = Window.partitionBy(plot).orderBy(*(order or []), sort_key(F.col("chrom")), "start")
    length = F.col("end") - F.col("start") + 1
    total = F.sum(length).over(Window.partitionBy(plot))
    run = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))
    offset = (F.row_number().over(w) - 1) * margin
    rows = intervals.withColumns({"__run": run, "__total": total, "__off": offset, "__len": length})
    return rows.withColumn("x1", (F.col("__run") - F.col("__len")) * 100 / F.col("__total") + F.col("__off")).withColumn("x2", F.col("__run") * 100 / F.col("__total") + F.col("__off")).drop("__run", "__total", "__off", "__len")


def place(points: DataFrame, laid: DataFrame, plot: str, pos: str, name: str) -> DataFrame:
    """x of positions (plot, chrom, pos) on the intervals that hold them."""
    own = laid.select(plot, "chrom", F.col("start").alias("i0"), F.col("end").alias("i1"), "x1", "x2")
    met = range_join(points.withColumn("__to", F.col(pos)), own, [plot, "chrom"], (pos, "__to"), ("i0", "i1"), bin_size=1_000_000)
    x = F.col("x1") + (F.col(pos) - F.col("i0")) * (F.col("x2") - F.col("x1")) / (F.col("i1") - F.col("i0") + 1)
    return met.withColumn(name, x).drop("__to", "i0", "i1", "x1", "x2")


def segment_bars(segments: DataFrame, laid: DataFrame, plot: str) -> DataFrame:
    """(plot, x_from, x_to, cn) of sequence edges (plot, chrom, start, end, cn)."""
    left = place(segments, laid, plot, "start", "x_from")
    return place(left, laid, plot, "end", "x_to").select(plot, "x_from", "x_to", "cn")


def line_width(n: Column, most: Column) -> Column:
    """Width of a discordant edge by its reads: up to 4, for `most` of at least 4; 1 if no edge has reads."""
    return F.when(most <= 0, 1.0).otherwise(4 * F.least(F.lit(1.0), F.greatest(n, F.lit(0)) / F.greatest(most, F.lit(4))))


def arc_height(distance: Column, width: Column, most_cn: Column) -> Column:
    """Apex of an arc: from 1.25 to 2 times the largest copy number (1 at least), by its share of the plot's width."""
    share = F.least(F.greatest(distance, F.lit(0.0)) / F.greatest(width, F.lit(1.0)), F.lit(1.0))
    return F.greatest(most_cn, F.lit(1.0)) * (LEAST_APEX + (MOST_APEX - LEAST_APEX) * share)


def gene_font_size(multiplier: float, base: float = GENE_FONT) -> float:
    """Point size of gene names; both numbers must be finite and not negative, and so must the result."""
    size = multiplier * base
    if not all(math.isfinite(x) and x >= 0 for x in (multiplier, base, size)):
        raise ValueError(f"no font size: {multiplier} times {base}")
    return size


def text_scale(multiplier: float) -> float:
    """How much the canvas grows with the text: 1 to 2."""
    gene_font_size(multiplier)
    return min(max(1.0, multiplier), MOST_TEXT_SCALE)


def separators(laid: DataFrame, plot: str, margin: float = MARGIN) -> DataFrame:
    """(plot, x, kind): lines between neighbouring intervals, kind chromosome where it changes, else interval."""
    w = Window.partitionBy(plot).orderBy("x1")
    before = F.lag("chrom").over(w)
    rows = laid.withColumn("kind", F.when(before != F.col("chrom"), "chromosome").when(before.isNotNull(), "interval"))
    return rows.where("kind is not null").select(plot, (F.col("x1") - margin / 2).alias("x"), "kind")


def in_region(rows: DataFrame, region: str, chrom: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """Rows that overlap a region such as chr1:100-200 (commas in numbers are allowed)."""
    found = re.fullmatch(r"([^:]+):([\d,]+)-([\d,]+)", region)
    if not found:
        raise ValueError(f"not a region: {region}")
    low, high = (int(found[k].replace(",", "")) for k in (2, 3))
    return rows.where((F.col(chrom) == found[1]) & (F.col(start) <= high) & (F.col(end) >= low))


def first_cycles(cycles: DataFrame, n: int | None = None, cyclic_only: bool = False) -> DataFrame:
    """Cycles (cycle_id, iscyclic, ...) of number at most n, without paths if only cycles are asked for."""
    if n is not None:
        cycles = cycles.where(F.col("cycle_id") <= n)
    return cycles.where("iscyclic") if cyclic_only else cycles


def arcs(edges: DataFrame, laid: DataFrame, plot: str, most_cn: DataFrame | None = None, margin: float = MARGIN, region: str | None = None) -> DataFrame:
    """(plot, x_from, x_to, strands, colour, width, height) of discordant edges (plot, chrom1, pos1, strand1, chrom2, pos2,
    strand2, reads) with both ends in intervals; height by most_cn (plot, cn), 1 where it isn't given. With a region, only
    edges with an end in it."""
    most = F.max("reads").over(Window.partitionBy(plot))
    rows = edges.withColumn("width", line_width(F.col("reads"), most)).withColumn("strands", F.concat("strand1", "strand2"))
    if region:
        ends = [in_region(rows, region, f"chrom{k}", f"pos{k}", f"pos{k}") for k in (1, 2)]
        rows = ends[0].unionByName(ends[1].exceptAll(in_region(ends[1], region, "chrom1", "pos1", "pos1")))
    rows = place(rows.withColumn("chrom", F.col("chrom1")), laid, plot, "pos1", "x_from")
    rows = place(rows.withColumn("chrom", F.col("chrom2")), laid, plot, "pos2", "x_to")
    wide = laid.groupBy(plot).agg((100 + (F.count("*") + 1) * F.lit(margin)).alias("__wide"))
    rows = rows.join(wide, plot)
    rows = rows.join(most_cn.select(plot, F.col("cn").alias("__cn")), plot, "left") if most_cn is not None else rows.withColumn("__cn", F.lit(1.0))
    colour = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    height = arc_height(F.abs(F.col("x_to") - F.col("x_from")), F.col("__wide"), F.coalesce("__cn", F.lit(1.0)))
    return rows.select(plot, "x_from", "x_to", "strands", colour[F.col("strands")].alias("colour"), "width", height.alias("height"))


def gene_lanes(genes: DataFrame, intervals: DataFrame, low: float = 0.15, high: float = 0.75) -> DataFrame:
    """Genes clipped to the intervals they meet, at heights spread evenly over the genes of an amplicon."""
    i = intervals.select("amplicon_id", "chrom", F.col("start").alias("i0"), F.col("end").alias("i1"))
    met = range_join(genes, i, ["chrom"], ("start", "end"), ("i0", "i1"), bin_size=1_000_000)
    met = met.select("amplicon_id", "gene", F.greatest("start", "i0").alias("start"), F.least("end", "i1").alias("end"))
    n = F.count("*").over(Window.partitionBy("amplicon_id"))
    at = F.row_number().over(Window.partitionBy("amplicon_id").orderBy("start", "gene")) - 1
    return met.withColumn("height", F.when(n > 1, low + (high - low) * at / (n - 1)).otherwise(low))


def axis_fit(rows: DataFrame, cn: str, cov: str, headroom: float = 1.2) -> DataFrame:
    """Least-squares factor through the origin between copy number and coverage, and the limits of both axes."""
    factor, top = F.sum(F.col(cn) * F.col(cov)) / F.sum(F.col(cn) * F.col(cn)), F.max(cn)
    fitted = rows.agg(factor.alias("factor"), top.alias("cn_max"))
    return fitted.withColumn("cn_ymax", headroom * F.col("cn_max")).withColumn("cov_ymax", F.col("cn_ymax") * F.col("factor"))


def axis_limits(sums: DataFrame, cutoff: float = math.inf, headroom: float = COVERAGE_HEADROOM, padding: float = ARC_PADDING) -> DataFrame:
    """sums (max_coverage, max_cn, cn_squares, cn_coverage, max_apex) with coverage_ymax, cn_ymax and expansion: the axes are
    fitted so that coverage = factor * copies, and both grow alike if arcs need more room."""
    c = F.col
    natural = F.least(F.lit(headroom) * F.greatest(c("max_coverage"), F.lit(0.0)), F.lit(max(cutoff, 0.0)))
    coverage = F.greatest(natural, F.lit(1.0))
    fitted = F.when((c("cn_squares") > 0) & (c("cn_coverage") > 0), coverage * c("cn_squares") / c("cn_coverage")).otherwise(F.greatest(F.lit(headroom) * F.greatest(c("max_cn"), F.lit(0.0)), F.lit(1.0)))
    needed = F.greatest(fitted, F.greatest(c("max_apex"), F.lit(0.0)) * (1 + padding))
    return sums.withColumn("expansion", needed / fitted).withColumn("coverage_ymax", coverage * needed / fitted).withColumn("cn_ymax", needed)


def coverage_of_edges(segments: DataFrame, laid: DataFrame, plot: str) -> DataFrame:
    """(plot, x_from, x_to, coverage): the mean coverage of sequence edges (plot, chrom, start, end, bases), for plots without
    alignments."""
    rows = place(place(segments, laid, plot, "start", "x_from"), laid, plot, "end", "x_to")
    return rows.select(plot, "x_from", "x_to", (F.col("bases") / (F.col("end") - F.col("start") + 1)).alias("coverage"))


def legend(coverage: str = "Graph average coverage") -> list[tuple[str, str, str]]:
    """(shape, colour, text) of the graph's legend."""
    return [("bar", "silver", coverage), ("line", "black", "Predicted segment CN"), *[("arc", c, f"Discordant edge {k}") for k, c in COLOURS.items()]]


def ticks(laid: DataFrame, plot: str) -> DataFrame:
    """(plot, x, label): interval starts, middles with the chromosome, and ends."""
    rows = F.array(
        F.struct(F.col("x1").alias("x"), F.format_number("start", 0).alias("label")),
        F.struct(((F.col("x1") + F.col("x2")) / 2).alias("x"), F.col("chrom").alias("label")),
        F.struct(F.col("x2").alias("x"), F.format_number("end", 0).alias("label")),
    )
    return laid.select(plot, F.inline(rows))


def cycle_blocks(segments: DataFrame, laid: DataFrame, plot: str) -> DataFrame:
    """Blocks of walks (plot, cycle_id, ord, chrom, start, end, strand) with x_from, x_to and a row y that sinks by 2 at each
    turn: where the next segment doesn't continue in the direction of travel."""
    left = place(segments, laid, plot, "start", "x_from")
    rows = place(left, laid, plot, "end", "x_to")
    w = Window.partitionBy(plot, "cycle_id").orderBy("ord")
    before = F.lag("strand").over(w)
    onward = (before == F.col("strand")) & F.when(F.col("strand") == "+", F.lag("x_to").over(w) <= F.col("x_from")).otherwise(F.lag("x_from").over(w) >= F.col("x_to"))
    turn = F.when(before.isNull() | onward, 0).otherwise(1)
    rows = rows.withColumn("turn", turn)
    return rows.withColumn("y", -2 * F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("turn")


def stacked(blocks: DataFrame, plot: str) -> DataFrame:
    """Blocks of cycle_blocks() one walk below the other, in the order of their numbers: y falls by 2 at each bend and by 4 after
    each walk, from -2; with top and bottom, the rows of its first and last block."""
    own = blocks.groupBy(plot, "cycle_id").agg(F.min("y").alias("__low"))
    w = Window.partitionBy(plot).orderBy("cycle_id")
    start = own.withColumn("__top", -2 + F.coalesce(F.sum(F.col("__low") - 4).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = blocks.join(start, [plot, "cycle_id"])
    return rows.withColumn("y", F.col("y") + F.col("__top")).withColumn("top", F.col("__top")).withColumn("bottom", F.col("__top") + F.col("__low")).drop("__top", "__low")


def _line(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("double").alias("x_from"), y1.cast("double").alias("y_from"), x2.cast("double").alias("x_to"), y2.cast("double").alias("y_to"))


def _through(*points: tuple[Column, Column]) -> Column:
    """The straight lines from point to point."""
    return F.array(*[_line(*a, *b) for a, b in zip(points, points[1:])])


def connectors(blocks: DataFrame, plot: str) -> DataFrame:
    """(plot, cycle_id, ord, part, x_from, y_from, x_to, y_to): lines of walks whose blocks are stacked().

    Between neighbours: straight if the next continues in the direction of travel, a turn around the further end if the
    strand changes, else back in the gap between two rows. Paths have a stub at either end. Cycles are closed around the
    side, beyond everything of the walk; a walk of one block needs one extension for that, others two.
    """
    w = Window.partitionBy(plot, "cycle_id").orderBy("ord")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c, e = F.col, EXTENSION
    rows = blocks.withColumns({f"n_{x}": F.lead(x).over(w) for x in ("x_from", "x_to", "strand")} | {f"f_{x}": F.first(x).over(full) for x in ("x_from", "x_to", "strand")})
    rows = rows.withColumns({"left": F.min("x_from").over(full), "right": F.max("x_to").over(full), "many": F.count("*").over(full) > 1, "first": F.lag("ord").over(w).isNull(), "last": c("n_strand").isNull()})
    up, middle, down = c("y") + 0.5, c("y") - 0.5, c("y") - 1.5
    x1, x2, n1, n2 = c("x_from"), c("x_to"), c("n_x_from"), c("n_x_to")
    far, near = F.greatest(x2, n2) + e, F.least(x1, n1) - e
    pair = F.concat("strand", "n_strand")
    between = (
        F.when(pair == "+-", _through((x2, up), (far, up), (far, down), (n2, down))).when(pair == "-+", _through((x1, up), (near, up), (near, down), (n1, down)))
        .when((pair == "++") & (x2 <= n1), _through((x2, up), (n1, up))).when(pair == "++", _through((x2, up), (x2 + e, up), (x2 + e, middle), (n1 - e, middle), (n1 - e, down), (n1, down)))
        .when((pair == "--") & (x1 >= n2), _through((x1, up), (n2, up))).when(pair == "--", _through((x1, up), (x1 - e, up), (x1 - e, middle), (n2 + e, middle), (n2 + e, down), (n2, down)))
    )
    head = F.when(c("first") & ~c("iscyclic"), F.when(c("strand") == "+", _through((x1 - 2 * e, up), (x1, up))).otherwise(_through((x2, up), (x2 + 2 * e, up))))
    tail = F.when(c("last") & ~c("iscyclic"), F.when(c("strand") == "+", _through((x2, up), (x2 + 2 * e, up))).otherwise(_through((x1 - 2 * e, up), (x1, up))))
    beyond = F.when(c("many"), 2 * e).otherwise(e)
    low, high, top = c("left") - beyond, c("right") + beyond, c("top") + 0.5
    round_ = F.concat("f_strand", "strand")  # the first segment's strand, then the last's
    closing = F.when(
        c("last") & c("iscyclic"),
        F.when(round_ == "-+", _through((c("f_x_to"), top), (high, top), (high, up), (x2, up))).when(round_ == "+-", _through((c("f_x_from"), top), (low, top), (low, up), (x1, up)))
        .when(round_ == "--", _through((c("f_x_to"), top), (high, top), (high, middle), (x1 - e, middle), (x1 - e, up), (x1, up)))
        .otherwise(_through((c("f_x_from"), top), (low, top), (low, middle), (x2 + e, middle), (x2 + e, up), (x2, up))),
    )
    parts = F.array(*[F.struct(F.lit(name).alias("part"), F.coalesce(lines, F.array().cast("array<struct<x_from:double,y_from:double,x_to:double,y_to:double>>")).alias("lines")) for name, lines in (("between", between), ("head", head), ("tail", tail), ("closing", closing))])
    each = rows.select(plot, "cycle_id", "ord", F.inline(parts))
    return each.select(plot, "cycle_id", "ord", "part", F.inline("lines"))


def cycle_labels(blocks: DataFrame, plot: str) -> DataFrame:
    """(plot, cycle_id, y, separator, label) of stacked() blocks with cn and length: the label stands between a walk's first and last
    row, the separator two below the last; its copy number is the least of its segments."""
    own = blocks.groupBy(plot, "cycle_id", "iscyclic", "top", "bottom").agg(F.min("cn").alias("cn"), F.sum(F.col("cn") * F.col("length")).alias("weighted"))
    kind = F.when(F.col("iscyclic"), "cycle").otherwise("path")
    label = F.concat(kind, F.lit(" "), F.col("cycle_id").cast("string"), F.lit(":\nCN = "), F.format_string("%.2f", "cn"), F.lit("\nweighted-CN = "), F.format_string("%.2e", "weighted"))
    return own.select(plot, "cycle_id", ((F.col("top") + F.col("bottom")) / 2).alias("y"), (F.col("bottom") - 2).alias("separator"), label.alias("label"))


def exons(genes: DataFrame, intervals: DataFrame, zoom: float = 1.0, least: float = 0.2) -> DataFrame:
    """(amplicon_id, gene, start, end, least_width) of the exons of genes (gene, chrom, exons: array of struct(s, e)) that meet the
    intervals, clipped to them; least_width: how narrow one may be drawn."""
    one = genes.select("gene", "chrom", F.explode("exons").alias("x")).select("gene", "chrom", F.col("x.s").alias("start"), F.col("x.e").alias("end"))
    i = intervals.select("amplicon_id", "chrom", F.col("start").alias("i0"), F.col("end").alias("i1"))
    met = range_join(one, i, ["chrom"], ("start", "end"), ("i0", "i1"), bin_size=1_000_000)
    return met.select("amplicon_id", "gene", F.greatest("start", "i0").alias("start"), F.least("end", "i1").alias("end"), F.lit(least * zoom).alias("least_width"))


def plot_data(plot: str, intervals: DataFrame, edges: DataFrame, cycles: DataFrame | None = None, genes: DataFrame | None = None, region: str | None = None, n_cycles: int | None = None, cyclic_only: bool = False) -> dict[str, DataFrame]:
    """All tables of a plot by name: intervals, bars, coverage, arcs, separators, ticks, axes, and genes, blocks, connectors and
    labels where there is something to draw them from.

    intervals: (plot, chrom, start, end); edges: as in graph files, with plot, cn, reads, bases; cycles: (plot, cycle_id,
    iscyclic, ord, chrom, start, end, strand, cn).
    """
    if region:
        intervals = in_region(intervals, region)
    laid = layout(intervals, plot)
    seq = edges.where("kind = 'sequence'").select(plot, F.col("chrom1").alias("chrom"), F.col("pos1").alias("start"), F.col("pos2").alias("end"), "cn", "bases")
    most = seq.groupBy(plot).agg(F.max("cn").alias("cn"))
    out = {"intervals": laid, "bars": segment_bars(seq, laid, plot), "coverage": coverage_of_edges(seq, laid, plot), "separators": separators(laid, plot), "ticks": ticks(laid, plot)}
    out["arcs"] = arcs(edges.where("kind = 'discordant'"), laid, plot, most, region=region)
    cov = F.col("bases") / (F.col("end") - F.col("start") + 1)
    sums = seq.groupBy(plot).agg(F.max(cov).alias("max_coverage"), F.max("cn").alias("max_cn"), F.sum(F.col("cn") * F.col("cn")).alias("cn_squares"), F.sum(F.col("cn") * cov).alias("cn_coverage"))
    apex = out["arcs"].groupBy(plot).agg(F.max("height").alias("max_apex"))
    out["axes"] = axis_limits(sums.join(apex, plot, "left").withColumn("max_apex", F.coalesce("max_apex", F.lit(0.0))))
    if genes is not None:
        out["genes"] = gene_lanes(genes, intervals.withColumnRenamed(plot, "amplicon_id") if plot != "amplicon_id" else intervals)
    if cycles is not None:
        own = first_cycles(cycles, n_cycles, cyclic_only).withColumn("length", F.col("end") - F.col("start") + 1)
        out["blocks"] = stacked(cycle_blocks(own, laid, plot), plot)
        out["connectors"], out["labels"] = connectors(out["blocks"], plot), cycle_labels(out["blocks"], plot)
    return out
