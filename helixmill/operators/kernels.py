"""The kernels of one amplicon a task: copy-number fit, multiplicities, walks, comparison of cycles.

Edges: (amplicon_id, kind, chrom1, pos1, strand1, chrom2, pos2, strand2, length, bases, reads[, cn]); kind is sequence,
concordant or discordant; a sequence edge runs from its reverse start to its forward end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..solve import compare, copynumber, multiplicity, walks

EDGE = ["kind", "chrom1", "pos1", "strand1", "chrom2", "pos2", "strand2"]
EDGES = "amplicon_id long, kind string, chrom1 string, pos1 long, strand1 string, chrom2 string, pos2 long, strand2 string, length long, bases long, reads long"
KINDS = ["sequence", "concordant", "discordant"]


def edge_table(sequence: DataFrame, concordant: DataFrame, discordant: DataFrame) -> DataFrame:
    """One table of sequence (amplicon_id, chrom, start, end, bases, reads), concordant (amplicon_id, chrom, pos1, pos2,
    reads) and discordant edges (amplicon_id, a and b ends, reads)."""
    c, zero = F.col, F.lit(0).cast("long")
    s = sequence.select("amplicon_id", F.lit("sequence").alias("kind"), c("chrom").alias("chrom1"), c("start").alias("pos1"), F.lit("-").alias("strand1"), c("chrom").alias("chrom2"), c("end").alias("pos2"), F.lit("+").alias("strand2"), (c("end") - c("start") + 1).alias("length"), "bases", "reads")
    j = concordant.select("amplicon_id", F.lit("concordant").alias("kind"), c("chrom").alias("chrom1"), "pos1", F.lit("+").alias("strand1"), c("chrom").alias("chrom2"), "pos2", F.lit("-").alias("strand2"), zero.alias("length"), zero.alias("bases"), "reads")
    d = discordant.select("amplicon_id", F.lit("discordant").alias("kind"), c("chrom_a").alias("chrom1"), c("pos_a").alias("pos1"), c("strand_a").alias("strand1"), c("chrom_b").alias("chrom2"), c("pos_b").alias("pos2"), c("strand_b").alias("strand2"), zero.alias("length"), zero.alias("bases"), "reads")
    return s.unionByName(j).unionByName(d)


def _sorted(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple]]:
    pdf = pdf.assign(_k=pdf["kind"].map(KINDS.index)).sort_values(["_k", *EDGE[1:]], kind="stable").drop(columns="_k").reset_index(drop=True)
    return pdf, [((a, b, c), (d, e, f)) for a, b, c, d, e, f in zip(pdf["chrom1"], pdf["pos1"], pdf["strand1"], pdf["chrom2"], pdf["pos2"], pdf["strand2"])]


def _end_nodes(nodes: list[tuple], kinds: list[str]) -> set:
    """Nodes of sequence edges without a breakpoint edge."""
    joined = {n for e, k in zip(nodes, kinds) if k != "sequence" for n in e}
    return {n for e, k in zip(nodes, kinds) if k == "sequence" for n in e} - joined


def fit_copy_number(edges: DataFrame, cov: float) -> DataFrame:
    """edges with cn, three decimals."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, nodes = _sorted(pdf)
        at = {k: np.flatnonzero(pdf["kind"] == k) for k in KINDS}
        pick = lambda k: [nodes[x] for x in at[k]]
        s, c, d = (pick(k) for k in KINDS)
        one = pdf.iloc[at["sequence"]]
        cn = copynumber.fit(s, one["length"].tolist(), one["bases"].tolist(), c, pdf["reads"].iloc[at["concordant"]].tolist(), d, pdf["reads"].iloc[at["discordant"]].tolist(), _end_nodes(nodes, pdf["kind"].tolist()), cov)
        return pdf.assign(cn=np.round(cn, 3))

    return edges.groupBy("amplicon_id").applyInPandas(run, EDGES + ", cn double")


def edge_multiplicities(edges: DataFrame, most: int = 5) -> DataFrame:
    """Discordant edges with the most passes a walk may make."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, _ = _sorted(pdf)
        return pdf.assign(bound=np.array(multiplicity.multiplicities(pdf["reads"].tolist(), most), dtype=np.int64))

    return edges.where("kind = 'discordant'").groupBy("amplicon_id").applyInPandas(run, EDGES + ", bound long")


def as_graph(pdf: pd.DataFrame) -> walks.Graph:
    pdf, nodes = _sorted(pdf)
    kinds = pdf["kind"].tolist()
    seq = [k for k, x in enumerate(kinds) if x == "sequence"]
    rest = [k for k, x in enumerate(kinds) if x != "sequence"]
    reads = [int(pdf["reads"].iloc[k]) for k in rest if kinds[k] == "discordant"]
    bounds = iter(multiplicity.multiplicities(reads))
    bound = [next(bounds) if kinds[k] == "discordant" else 10 for k in rest]
    cn = pdf["cn"].tolist()
    return walks.Graph([nodes[k] for k in seq], [float(pdf["length"].iloc[k]) for k in seq], [nodes[k] for k in rest], [cn[k] for k in [*seq, *rest]], bound, _end_nodes(nodes, kinds))


def path_constraints(paths: DataFrame, sequence: DataFrame, discordant: DataFrame | None = None) -> DataFrame:
    """(amplicon_id, path, EDGE, n): how often each path (amplicon_id, path as text) passes each edge, by its ends.

    sequence: numbered sequence edges (readpaths.number_edges); c<k> joins e<k> to the piece that starts a base on;
    discordant: (amplicon_id, d_idx, a and b ends) of the edges d<k>.
    """
    c, name = F.col, lambda kind: F.concat(F.lit(kind), F.col("seq_idx").cast("string")).alias("edge")
    e = sequence.select("amplicon_id", name("e"), F.lit("sequence").alias("kind"), c("chrom").alias("chrom1"), c("start").alias("pos1"), F.lit("-").alias("strand1"), c("chrom").alias("chrom2"), c("end").alias("pos2"), F.lit("+").alias("strand2"))
    j = sequence.select("amplicon_id", name("c"), F.lit("concordant").alias("kind"), c("chrom").alias("chrom1"), c("end").alias("pos1"), F.lit("+").alias("strand1"), c("chrom").alias("chrom2"), (c("end") + 1).alias("pos2"), F.lit("-").alias("strand2"))
    passed = paths.select("amplicon_id", "path", F.explode(F.split("path", ",")).alias("edge"))
    every = e.union(j)
    if discordant is not None:
        ends = [c(f"{x}_{side}").alias(f"{x}{k}") for k, side in ((1, "a"), (2, "b")) for x in ("chrom", "pos", "strand")]
        every = every.union(discordant.select("amplicon_id", F.concat(F.lit("d"), c("d_idx").cast("string")), F.lit("discordant"), *ends))
    return passed.join(every, ["amplicon_id", "edge"], "left").groupBy("amplicon_id", "path", *EDGE).agg(F.count("*").alias("n"))


def _asked(pdf: pd.DataFrame, constraints: pd.DataFrame) -> list[Counter]:
    """The constraints of an amplicon in the numbering of its sorted edges; one with an edge the graph lacks is left out."""
    at = {e: k for k, e in enumerate(_sorted(pdf)[0][EDGE].itertuples(index=False, name=None))}
    out = []
    for _, one in constraints.groupby("path"):
        n = dict(zip(one[EDGE].itertuples(index=False, name=None), one["n"]))
        if all(e in at for e in n):
            out.append(Counter({at[e]: int(k) for e, k in n.items()}))
    return out


def _by_amplicon(edges: DataFrame, constraints: DataFrame | None, run, schema: str) -> DataFrame:
    """run(edges, constraints as Counters) on each amplicon's edges."""
    if constraints is None:
        return edges.groupBy("amplicon_id").applyInPandas(lambda pdf: run(pdf, []), schema)
    columns = [f.split()[0] for f in schema.split(", ")]
    both = edges.groupBy("amplicon_id").cogroup(constraints.groupBy("amplicon_id"))
    return both.applyInPandas(lambda pdf, asked: run(pdf, _asked(pdf, asked)) if len(pdf) else pd.DataFrame(columns=columns), schema)


def decompose(edges: DataFrame, mode: str = "greedy", constraints: DataFrame | None = None) -> DataFrame:
    """Walks of each amplicon: (amplicon_id, walk, iscyclic, weight, ord, chrom, start, end, strand).

    mode: greedy, or fewest, which reduces the greedy walks to few that cover nine tenths. constraints: path_constraints.
    """

    def run(pdf: pd.DataFrame, asked: list[Counter]) -> pd.DataFrame:
        g = as_graph(pdf)
        found = [(w, x) for w, x, _ in walks.greedy(g, asked)]
        if mode == "fewest":
            found = walks.fewest(g, [w for w, _ in found], constraints=asked)
        rows = []
        for k, (w, x) in enumerate(sorted(found, key=lambda f: -f[1]), 1):
            for at, (edge, enter) in enumerate(w.steps, 1):
                (chrom, start, _), (_, end, _) = g.sequence[edge]
                rows.append((pdf["amplicon_id"].iloc[0], k, w.cyclic, round(x, 4), at, chrom, start, end, "+" if enter == g.sequence[edge][0] else "-"))
        return pd.DataFrame(rows, columns=["amplicon_id", "walk", "iscyclic", "weight", "ord", "chrom", "start", "end", "strand"])

    return _by_amplicon(edges, constraints, run, "amplicon_id long, walk int, iscyclic boolean, weight double, ord int, chrom string, start long, end long, strand string")


def order_walks(edges: DataFrame, passes: DataFrame) -> DataFrame:
    """An order for each multiset of edges (amplicon_id, walk, iscyclic, edge, n): (amplicon_id, walk, ord, edge, strand), in
    the numbering of the sorted edge table; no rows for a multiset that no walk passes."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left):
            g = as_graph(left)
            for walk, one in right.sort_values("walk").groupby("walk"):
                found = walks.euler(Counter(dict(zip(one["edge"].tolist(), one["n"].tolist()))), g, bool(one["iscyclic"].iloc[0]))
                if found:
                    rows += [(key[0], walk, k, e, "+" if enter == g.sequence[e][0] else "-") for k, (e, enter) in enumerate(found.steps, 1)]
        return pd.DataFrame(rows, columns=["amplicon_id", "walk", "ord", "edge", "strand"])

    return edges.groupBy("amplicon_id").cogroup(passes.groupBy("amplicon_id")).applyInPandas(run, "amplicon_id long, walk int, ord int, edge int, strand string")


def compare_cycles(cycles: DataFrame, truth: DataFrame, group: str = "amplicon_id") -> DataFrame:
    """(group, cycle_id, overlap, overlap_share, triplets) of each cycle with the true one of its group.

    Cycles: (group, cycle_id, ord, chrom, start, end, strand), ends not included; truth has the same with the prefix true_. Segments are cut at all ends of
    both, so the order of common pieces is compared; the share is of the total length of both, each piece at its larger count.
    """

    def cut(segments: list[tuple], points: dict[str, list[int]]) -> list[tuple]:
        out = []
        for chrom, s, e, strand in segments:
            inner = [p for p in points[chrom] if s <= p <= e]
            parts = [((chrom, a, b), strand) for a, b in zip(inner, inner[1:])]
            out += parts if strand == "+" else parts[::-1]
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = lambda xs: [(x["chrom"], x["start"], x["end"], x["strand"]) for x in xs] if xs is not None else []
        for f in frames:
            rows = []
            for g, cycle_id, own, true in f.itertuples(index=False):
                own, true = read(own), read(true)
                points: dict[str, set] = {}
                for c, s, e, _ in [*true, *own]:
                    points.setdefault(c, set()).update((s, e))
                ordered = {c: sorted(p) for c, p in points.items()}
                a, b = cut(true, ordered), cut(own, ordered)
                size = {p: p[2] - p[1] for p, _ in [*a, *b]}
                na, nb = Counter(p for p, _ in a), Counter(p for p, _ in b)
                total = sum(max(na[p], nb[p]) * size[p] for p in size)
                common = set(na) & set(nb)
                best = compare.cycle_overlap([x for x in a if x[0] in common], [x for x in b if x[0] in common], size)
                rows.append((g, cycle_id, int(best), round(best / total, 9) if total else 0.0, round(compare.triplet_share(true, own), 9)))
            yield pd.DataFrame(rows, columns=[group, "cycle_id", "overlap", "overlap_share", "triplets"])

    listed = lambda df, prefix, *by: df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("ord", "chrom", "start", "end", "strand")]))).alias(f"{prefix}segments"))
    own = listed(cycles, "", group, "cycle_id")  # a cycle is a row, so the cycles of a group are spread over tasks
    both = own.join(listed(truth, "true_", f"true_{group}"), F.col(group) == F.col(f"true_{group}"), "left")
    return both.select(group, "cycle_id", "segments", "true_segments").mapInPandas(run, f"{group} long, cycle_id long, overlap long, overlap_share double, triplets double")


def legality(edges: DataFrame, segments: DataFrame) -> DataFrame:
    """Checks of walks (amplicon_id, walk, iscyclic, weight, ord, chrom, start, end, strand) in DataFrame operations: for each
    edge (EDGE) the copies that walks take, and whether they stay within its copy number. The joint between two segments is
    the edge from the end where the first is left to the one where the next is entered; two edges between the same ends
    share their copies."""
    w = Window.partitionBy("amplicon_id", "walk").orderBy("ord")
    forward = F.col("strand") == "+"
    leave = F.struct("chrom", F.when(forward, F.col("end")).otherwise(F.col("start")).alias("pos"), "strand")
    enter = F.struct("chrom", F.when(forward, F.col("start")).otherwise(F.col("end")).alias("pos"), F.translate("strand", "+-", "-+").alias("strand"))
    rows = segments.withColumn("x", leave).withColumn("enter", enter)
    to = F.coalesce(F.lead("enter").over(w), F.when(F.col("iscyclic"), F.first("enter").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    rows = rows.withColumn("y", to).where("y is not null")
    pair = lambda x, y: (F.least(x, y).alias("low"), F.greatest(x, y).alias("high"))
    joints = rows.select("amplicon_id", F.lit(False).alias("own"), *pair(F.col("x"), F.col("y")), "weight")
    node = lambda c, p, s: F.struct(F.col(c).alias("chrom"), F.col(p).alias("pos"), s.alias("strand"))
    passed = segments.select("amplicon_id", F.lit(True).alias("own"), *pair(node("chrom", "start", F.lit("-")), node("chrom", "end", F.lit("+"))), "weight")
    taken = joints.union(passed).groupBy("amplicon_id", "own", "low", "high").agg(F.sum("weight").alias("taken"))
    ends = pair(node("chrom1", "pos1", F.col("strand1")), node("chrom2", "pos2", F.col("strand2")))
    named = edges.select("amplicon_id", *EDGE, "cn", (F.col("kind") == "sequence").alias("own"), *ends)
    total = F.sum("cn").over(Window.partitionBy("amplicon_id", "own", "low", "high"))
    out = named.withColumn("total", total).join(taken, ["amplicon_id", "own", "low", "high"], "left").withColumn("taken", F.coalesce("taken", F.lit(0.0)))
    return out.select("amplicon_id", *EDGE, "cn", "taken", (F.col("taken") <= F.col("total") + 2e-3).alias("legal"))


def satisfaction(edges: DataFrame, constraints: DataFrame) -> DataFrame:
    """(amplicon_id, n_constraints, n_satisfied): how many path constraints the greedy walks of an amplicon satisfy."""

    def run(pdf: pd.DataFrame, asked: list[Counter]) -> pd.DataFrame:
        met = set().union(*(got for _, _, got in walks.greedy(as_graph(pdf), asked)))
        return pd.DataFrame({"amplicon_id": [pdf["amplicon_id"].iloc[0]], "n_constraints": [len(asked)], "n_satisfied": [len(met)]})

    return _by_amplicon(edges, constraints, run, "amplicon_id long, n_constraints int, n_satisfied int")


def walk_passes(edges: DataFrame, constraints: DataFrame | None = None) -> DataFrame:
    """How often each greedy walk passes each edge: (amplicon_id, walk, iscyclic, edge, n)."""

    def run(pdf: pd.DataFrame, asked: list[Counter]) -> pd.DataFrame:
        g = as_graph(pdf)
        rows = [(pdf["amplicon_id"].iloc[0], k, w.cyclic, e, n) for k, (w, _, _) in enumerate(walks.greedy(g, asked), 1) for e, n in sorted(w.passes(len(g.sequence)).items())]
        return pd.DataFrame(rows, columns=["amplicon_id", "walk", "iscyclic", "edge", "n"])

    return _by_amplicon(edges, constraints, run, "amplicon_id long, walk int, iscyclic boolean, edge int, n int")
