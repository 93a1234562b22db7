"""Text sinks: graph, cycles, BED, seed, score and summary files, one folder a data set.

Lines are made and ordered by DataFrame operations and written partitioned by amplicon; only the summary, a few lines an
amplicon, is made into one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import formats
from ..functions.chrom import sort_key
from ..operators.reads import ordered_nodes


def _node(chrom: str, pos: str, strand: str) -> Column:
    return F.concat(F.col(chrom), F.lit(":"), F.col(pos).cast("string"), F.col(strand))


def _titles(ids: DataFrame, *titles: tuple[int, str]) -> DataFrame:
    """A line for each amplicon and title, at its section."""
    none = F.struct(sort_key(F.lit("")).alias("k"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(0).alias("o"))
    rows = F.array(*[F.struct(F.lit(k).alias("section"), F.lit(t).alias("line")) for k, t in titles])
    return ids.select("amplicon_id").distinct().select("amplicon_id", F.inline(rows)).select("amplicon_id", "section", none.alias("place"), "line")


def path_text(path: Column) -> Column:
    """A path constraint, array of struct(edge, strand, n), as text: e1+:1,c1-:2,..."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["edge"], x["strand"], F.lit(":"), x["n"].cast("string"))), ",")


def graph_lines(edges: DataFrame, constraints: DataFrame | None = None, sources: DataFrame | None = None, program: str = formats.PROGRAM) -> DataFrame:
    """(amplicon_id, section, place, line) of graph files: sequence edges by place, source edges (amplicon_id, chrom, pos, strand,
    cn), concordant edges, discordant edges with the lower end first and by both ends, and path constraints (amplicon_id,
    pc_idx, path, support) if they are given: the longest, or all."""
    low, high = ordered_nodes(*[F.col(c) for c in ("chrom1", "pos1", "strand1", "chrom2", "pos2", "strand2")])
    e = edges.withColumn("x", low).withColumn("y", high)
    show = lambda n: F.concat(F.col(f"{n}.chrom"), F.lit(":"), F.col(f"{n}.pos").cast("string"), F.col(f"{n}.strand"))
    cn = F.col("cn").cast("string")
    seq = F.concat_ws("\t", F.lit("sequence"), _node("chrom1", "pos1", "strand1"), _node("chrom2", "pos2", "strand2"), cn, (F.col("bases") / F.col("length")).cast("string"), F.col("length").cast("string"), F.col("reads").cast("string"))
    lower = F.when(F.col("kind") == "concordant", F.concat(_node("chrom1", "pos1", "strand1"), F.lit("->"), _node("chrom2", "pos2", "strand2"))).otherwise(F.concat(show("x"), F.lit("->"), show("y")))
    joint = F.concat_ws("\t", "kind", lower, cn, F.col("reads").cast("string"))
    section = F.when(F.col("kind") == "sequence", 2).when(F.col("kind") == "concordant", 5).otherwise(6)
    first = F.when(F.col("kind") == "discordant", F.struct(F.col("x.k").alias("k"), F.col("x.pos").alias("p"), F.col("y.pos").alias("q"), F.col("x.o").alias("o")))
    place = F.coalesce(first, F.struct(sort_key(F.col("chrom1")).alias("k"), F.col("pos1").alias("p"), F.col("pos2").alias("q"), F.lit(0).alias("o")))
    out = e.select("amplicon_id", section.alias("section"), place.alias("place"), F.when(F.col("kind") == "sequence", seq).otherwise(joint).alias("line"))
    out = out.unionByName(_titles(edges, (0, formats.header(program)), (1, formats.GRAPH_SEQUENCE), (3, formats.GRAPH_BREAKPOINT)))
    if sources is not None:
        line = F.concat_ws("\t", F.lit("source"), F.concat(F.lit("0-->"), _node("chrom", "pos", "strand")), cn, F.lit("-1"))
        at = F.struct(sort_key(F.col("chrom")).alias("k"), F.col("pos").alias("p"), F.col("pos").alias("q"), F.lit(0).alias("o"))
        out = out.unionByName(sources.select("amplicon_id", F.lit(4).alias("section"), at.alias("place"), line.alias("line")))
    if constraints is not None:
        at = F.struct(sort_key(F.lit("")).alias("k"), F.col("pc_idx").cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(0).alias("o"))
        line = F.concat_ws("\t", F.lit("path_constraint"), path_text(F.col("path")), F.col("support").cast("string"))
        out = out.unionByName(_titles(edges, (7, formats.GRAPH_PATHS))).unionByName(constraints.select("amplicon_id", F.lit(8).alias("section"), at.alias("place"), line.alias("line")))
    return out


def write_graphs(lines: DataFrame, path: str) -> None:
    """A folder amplicon_id=<n> for each amplicon, its lines in order."""
    lines.repartition("amplicon_id").sortWithinPartitions("amplicon_id", "section", "place").select("amplicon_id", "line").write.partitionBy("amplicon_id").text(path)


def cycle_lines(walks: DataFrame, segments: DataFrame, sequence: DataFrame | None = None, intervals: DataFrame | None = None, constraints: DataFrame | None = None, all_paths: bool = False, method: str = "greedy", program: str = formats.PROGRAM) -> DataFrame:
    """(amplicon_id, section, place, line) of cycles files: intervals, segments by number, path constraints, and walks by weight;
    paths run from 0+ to 0-.

    walks: (amplicon_id, rank, iscyclic, weight[, satisfied: numbers of the constraints it satisfies, from 1]); segments:
    (amplicon_id, rank, ord, chrom, start, end, strand). sequence: all edges (amplicon_id, chrom, start, end) that are
    numbered, else those of the segments; constraints: (amplicon_id, pc_idx from 0, path, support).
    """
    by_place = Window.partitionBy("amplicon_id").orderBy(sort_key(F.col("chrom")), "start", "end")
    own = (segments if sequence is None else sequence).select("amplicon_id", "chrom", "start", "end").distinct()
    named = own.withColumn("n", F.row_number().over(by_place))
    line = lambda *parts: F.concat_ws("\t", *[F.lit(x) if k == 0 else F.col(x).cast("string") for k, x in enumerate(parts)])
    row = lambda df, section, place, text: df.select("amplicon_id", F.lit(section).alias("section"), F.col(place).cast("int").alias("place"), text.alias("line"))
    titles = [(0, formats.header(program, method=method)), (2, formats.CYCLE_SEGMENTS), (6, formats.CYCLE_WALKS)]
    out = row(named, 3, "n", line("Segment", "n", "chrom", "start", "end"))
    if intervals is not None:
        out = out.unionByName(row(intervals.withColumn("n", F.row_number().over(by_place)), 1, "n", line("Interval", "n", "chrom", "start", "end")))
    satisfied = "satisfied" in walks.columns and constraints is not None and not all_paths
    if constraints is not None:
        titles.append((4, formats.CYCLE_ALL_PATHS if all_paths else formats.CYCLE_LONGEST_PATHS))
        text = F.concat(F.lit("Path constraint "), (F.col("pc_idx") + 1).cast("string"), F.lit("\t"), path_text(F.col("path")), F.lit("\tSupport="), F.col("support").cast("string"))
        if satisfied:
            met = walks.select("amplicon_id", F.explode(F.transform("satisfied", lambda x: x - 1)).alias("pc_idx")).distinct().withColumn("met", F.lit(True))
            constraints = constraints.join(met, ["amplicon_id", "pc_idx"], "left")
            text = F.concat(text, F.when(F.col("met"), "\tSatisfied").otherwise("\tUnsatisfied"))
        out = out.unionByName(row(constraints, 5, "pc_idx", text))
        titled = constraints
    else:
        titled = walks
    steps = segments.join(named, ["amplicon_id", "chrom", "start", "end"]).groupBy("amplicon_id", "rank").agg(F.sort_array(F.collect_list(F.struct("ord", F.concat(F.col("n").cast("string"), F.col("strand")).alias("s")))).alias("steps"))
    rows = walks.join(steps, ["amplicon_id", "rank"])
    text = F.array_join("steps.s", ",")
    text = F.when(F.col("iscyclic"), text).otherwise(F.concat(F.lit("0+,"), text, F.lit(",0-")))
    head = F.when(F.col("iscyclic"), F.lit("Cycle=")).otherwise(F.lit("Path="))
    whole = F.concat(head, F.col("rank").cast("string"), F.lit(";Copy_count="), F.col("weight").cast("string"), F.lit(";Segments="), text)
    if satisfied:
        whole = F.concat(whole, F.lit(";Path_constraints_satisfied="), F.array_join(F.transform("satisfied", lambda x: x.cast("string")), ","))
    out = out.unionByName(row(rows, 7, "rank", whole))
    for section, title in titles:
        ids = (titled if section == 4 else walks).select("amplicon_id").distinct()
        out = out.unionByName(ids.select("amplicon_id", F.lit(section).alias("section"), F.lit(0).alias("place"), F.lit(title).alias("line")))
    return out


def write_bed(rows: DataFrame, path: str, *columns: str) -> None:
    """Tab-separated values without header, in the order of the columns."""
    rows.select(*columns).write.option("sep", "\t").csv(path)


def call_lines(segments: DataFrame) -> DataFrame:
    """Copy-number calls (chrom, start, end, cn) with six significant digits."""
    return segments.select("chrom", "start", "end", F.regexp_replace(F.format_string("%.6g", "cn"), r"(\.\d*?)0+$", "$1").alias("cn"))


def seed_lines(seeds: DataFrame) -> DataFrame:
    """Seeds (chrom, start, end) as rows of a BED file, in genomic order."""
    return seeds.select("chrom", "start", "end").orderBy(sort_key(F.col("chrom")), "start")


def score_rows(scores: DataFrame) -> DataFrame:
    """The score table with the share of breakpoint edges found and the class of the amplicon (the name up to the first _)."""
    accuracy = F.col("n_breakpoint_edges_covered") / F.when(F.col("n_breakpoint_edges") > 0, F.col("n_breakpoint_edges"))
    return scores.withColumn("breakpoint_accuracy", accuracy).withColumn("breakpoint_class", F.element_at(F.split("amplicon", "_"), 1))


def write_scores(scores: DataFrame, path: str) -> None:
    """Tab-separated values with a header."""
    score_rows(scores).write.option("sep", "\t").option("header", True).csv(path)


def amplicon_summaries(statistics: DataFrame, intervals: DataFrame, solutions: DataFrame | None = None) -> DataFrame:
    """(amplicon_id, text): the section of a run summary for each amplicon.

    statistics: as from graph.statistics; intervals: (amplicon_id, chrom, start, end); solutions: (amplicon_id, solved, model,
    k, alpha, total_weights, resolution, n_constraints, gap, bound, iscyclic, walk), of which the heaviest walk's line is the
    last. Amplicons without a row there are unperformed.
    """
    number = lambda c: F.format_number(F.col(c), 0)
    place = F.concat(F.lit("\tAmplicon "), F.col("amplicon_id").cast("string"), F.lit(" > "), "chrom", F.lit(":"), number("start"), F.lit("-"), number("end"))
    own = intervals.groupBy("amplicon_id").agg(F.sort_array(F.collect_list(F.struct(sort_key(F.col("chrom")).alias("k"), "start", place.alias("line")))).alias("rows"), F.sum(F.col("end") - F.col("start") + 1).alias("total"))
    rows = statistics.join(own, "amplicon_id")
    if solutions is None:
        rows = rows.withColumn("solved", F.lit(None).cast("boolean"))
        detail = F.lit("")
    else:
        rows = rows.join(solutions, "amplicon_id", "left")
        shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
        model = F.concat(F.lit("\tModelMetadata: "), F.col("model"), F.lit(", k="), shown("k"), F.lit(", alpha="), shown("alpha"), F.lit(", total_weights="), shown("total_weights"), F.lit(", resolution="), shown("resolution"), F.lit(", num_path_constraints="), shown("n_constraints"), F.lit("\n"))
        model = F.when(F.col("model").isNotNull(), model).otherwise("")
        gap = F.when(F.col("gap") > formats.GAP_PERCENT, F.concat(F.lit(f"\t{formats.SUBOPTIMAL} (Relative MIP Gap: "), F.format_string("%.5f", "gap"), F.lit("%)\n"))).otherwise("")
        bound = F.when(F.col("bound").isNotNull(), F.concat(F.lit("\tUpper Bound: "), F.format_string("%.5f", "bound"), F.lit("\n"))).otherwise("")
        walk = F.when(F.col("walk").isNotNull(), F.concat(F.lit("\tHeaviest graph walk solved was a "), F.when(F.col("iscyclic"), "cycle").otherwise("path"), F.lit(".\n\t"), F.col("walk"), F.lit("\n"))).otherwise("")
        detail = F.when(F.col("solved"), F.concat(model, gap, bound, walk)).when(~F.col("solved"), model).otherwise("")
    status = F.when(F.col("solved"), "SUCCESS").when(~F.col("solved"), "FAILURE").otherwise("UNPERFORMED")
    lines = [F.lit("AmpliconID = "), F.col("amplicon_id").cast("string"), F.lit("\n#Intervals = "), F.size("rows").cast("string"), F.lit("\nAmplicon Intervals:\n"), F.array_join("rows.line", "\n"), F.lit("\nTotal Amplicon Size: "), number("total")]
    for title, c in (("# Chromosomes", "n_chromosomes"), ("# Sequence Edges", "n_sequence"), ("# Concordant Edges", "n_concordant"), ("# Discordant Edges", "n_discordant"), ("# Non-Source Edges", "n_nonsource"), ("# Source Edges", "n_source")):
        lines += [F.lit(f"\n{title}: "), F.col(c).cast("string")]
    return rows.select("amplicon_id", "solved", F.concat(*lines, F.lit("\nCycle Decomposition Status: "), status, F.lit("\n"), detail).alias("text"))


def summary_text(sections: DataFrame, time_limit: int = 21600, solver: tuple[str, int, int] | None = None, usage: list[tuple[str, float, float]] | None = None, program: str = formats.PROGRAM, version: str = formats.__version__) -> str:
    """The run summary from amplicon_summaries(), made on the driver: about a dozen lines an amplicon.

    solver: (name, threads, seconds limit) and usage: (call, peak GB, seconds) of a profiled run.
    """
    rows = list(sections.orderBy("amplicon_id").toLocalIterator())
    out = f"{program} {version}\n{sum(bool(r.solved) for r in rows)}/{len(rows)} amplicons solved.\nRuntime Limit: {time_limit} s\nProfiling Enabled: {usage is not None}\n"
    out += "".join(f"{formats.SEPARATOR}\n{r.text}" for r in rows)
    if solver:
        out += f"{formats.SEPARATOR}\n{formats.SOLVER_HEADER}\nSolver: {solver[0]}\nThreads: {solver[1]}\nTime Limit: {solver[2]} s\n"
    if usage is not None:
        out += f"{formats.SEPARATOR}\n{formats.RESOURCE_HEADER}\n" + "".join(f"{call} | Peak RAM: {gb:.5f} GB | Runtime: {s:.5f} s\n" for call, gb, s in sorted(usage))
    return out


def model_text(edges: DataFrame, constraints: DataFrame | None = None) -> DataFrame:
    """(amplicon_id, value): what the solver of an amplicon gets, as JSON: its edges, and its path constraints if any."""
    own = edges.groupBy("amplicon_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in edges.columns if c != "amplicon_id"]))).alias("edges"))
    if constraints is not None:
        some = constraints.groupBy("amplicon_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in constraints.columns if c != "amplicon_id"]))).alias("constraints"))
        own = own.join(some, "amplicon_id", "left")
    return own.select("amplicon_id", F.to_json(F.struct("*")).alias("value"))
