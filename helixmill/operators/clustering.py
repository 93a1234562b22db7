"""Breakpoint clusters and calls.

First-fit single linkage is sequential within a key (chromosomes and strands), but a cluster never crosses a stretch of
the cutoff without breakpoints. So a key is first cut, in DataFrame operations, at empty bins along each axis in turn;
the exact fold then runs on the small pieces, and one frequent key doesn't meet in one task.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from .pieces import fold

KEY = ["chrom_a", "chrom_b", "strand_a", "strand_b"]


def cut_at_gaps(points: DataFrame, keys: list[str], pos: str, cutoff: int, name: str, count: str | None = None) -> DataFrame:
    """Adds a piece number: pieces of a key are separated by at least one empty bin of the cutoff's width. count: name of a
    column for the number of points of the key."""
    binned = points.withColumn("__bin", F.floor(F.col(pos) / cutoff))
    bins = binned.groupBy(*keys, "__bin").agg(F.count("*").alias("__points"))
    w = Window.partitionBy(*keys).orderBy("__bin")
    opens = F.when(F.col("__bin") - F.lag("__bin").over(w) <= 1, 0).otherwise(1)
    pieces = bins.withColumn("opens", opens).withColumn(name, F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if count:
        pieces = pieces.withColumn(count, F.sum("__points").over(Window.partitionBy(*keys)))
    return binned.join(pieces.drop("opens", "__points"), [*keys, "__bin"]).drop("__bin")


def first_fit(pos1: np.ndarray, pos2: np.ndarray, cutoff: float) -> np.ndarray:
    """Cluster number of each point: the first cluster with a member nearer than the cutoff on both axes, else a new one.

    Points are kept in cells of the cutoff's width. All points of one cell are near each other, so a cell's own clusters
    need no comparison, and of the eight around only clusters before them do.
    """
    cluster = np.empty(len(pos1), dtype=np.int64)
    cells: dict[tuple[int, int], dict[int, list[tuple[int, int]]]] = {}
    n = 0
    around = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y]
    for k, (a, b) in enumerate(zip(pos1.tolist(), pos2.tolist())):
        i, j = int(a // cutoff), int(b // cutoff)
        own = cells.setdefault((i, j), {})
        best = min(own, default=n)
        for x, y in around:
            for c, members in cells.get((i + x, j + y), {}).items():
                if c < best and any(abs(a - p) < cutoff and abs(b - q) < cutoff for p, q in members):
                    best = c
        cluster[k] = best
        own.setdefault(best, []).append((a, b))
        n = max(n, best + 1)
    return cluster


def cluster(points: DataFrame, params: Params = DEFAULT, order: list[str] | None = None, least: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """points with `cluster` (text: piece and number). Keys with fewer than `least` points are one cluster, unexamined.

    order: columns that fix the sequence of points for the fold. by: columns whose values are clustered apart. points should be a stored table: it is read several times.
    """
    order = order or ["read_id", "pos_a", "pos_b"]
    least = params.min_cluster if least is None else least
    cutoff = params.cluster_cutoff
    key = [*by, *KEY]
    rows = cut_at_gaps(points, key, "pos_a", cutoff, "__p1", "__n")
    rows = cut_at_gaps(rows, [*key, "__p1"], "pos_b", cutoff, "__p2")
    columns = points.columns

    def number(pdf: pd.DataFrame, groups: list[tuple[int, int]]) -> pd.DataFrame:
        a, b = pdf["pos_a"].to_numpy(), pdf["pos_b"].to_numpy()
        found = np.concatenate([first_fit(a[s:e], b[s:e], cutoff) for s, e in groups])
        pdf["cluster"] = ["all" if n < least else f"{x}.{y}.{z}" for n, x, y, z in zip(pdf["__n"], pdf["__p1"], pdf["__p2"], found)]
        return pdf[[*columns, "cluster"]]

    schema = points.select(*columns).withColumn("cluster", F.lit("")).schema
    return fold(rows, [*key, "__p1", "__p2"], order, number, schema)


def summarise(clusters: DataFrame, least: int = 1) -> DataFrame:
    found = clusters.groupBy(*KEY, "cluster").agg(F.count("*").alias("n"), F.min("pos_a").alias("min_a"), F.max("pos_a").alias("max_a"), F.min("pos_b").alias("min_b"), F.max("pos_b").alias("max_b"))
    return found.where(F.col("n") >= least)


def _centre(values: list[int], forward: bool) -> int:
    top = Counter(values).most_common(2)
    if len(top) == 1 or top[0][1] > top[1][1]:
        return int(top[0][0])
    middle = float(np.median(values))
    return int(middle) if len(values) % 2 else int(math.ceil(middle) if forward else math.floor(middle))


def match_one(a: int, b: int, at: tuple[int, int], strands: tuple[str, str], gap: float, cutoff: float) -> bool:
    rest, ok = gap, []
    for pos, centre, strand in zip((a, b), at, strands):
        short = centre - cutoff - pos + 1 if strand == "+" and pos <= centre - cutoff else pos - centre - cutoff + 1 if strand == "-" and pos >= centre + cutoff else None
        near = abs(pos - centre) < cutoff
        if gap <= 0:
            ok.append((near, False))
        else:
            rest -= short or 0
            ok.append((near, short is not None))
    return all(near or (paid and rest >= 0) for near, paid in ok)


def call(pos_a: list[int], pos_b: list[int], gaps: list[float], strands: tuple[str, str], cutoff: float) -> tuple[tuple[int, int], list[int]]:
    """The exact breakpoint of a cluster and the members that support it, in order."""
    inside = np.ones(len(pos_a), dtype=bool)
    for x in (np.asarray(pos_a, float), np.asarray(pos_b, float)):
        window = 3 * max(x.std(), cutoff / 2.99)
        inside &= np.abs(x - x.mean()) <= window
    kept = np.flatnonzero(inside)
    at = tuple(_centre([p[k] for k in kept], s == "+") if len(kept) else (0 if s == "+" else 1_000_000_000) for p, s in zip((pos_a, pos_b), strands))
    return at, [k for k in range(len(pos_a)) if match_one(pos_a[k], pos_b[k], at, strands, gaps[k] * 1.2, cutoff)]


def peel(pos_a: list[int], pos_b: list[int], gaps: list[float], strands: tuple[str, str], least: int, cutoff: float) -> list[tuple[int, int, list[int]]]:
    """Calls of a cluster: the members that support none so far are tried again while there are enough."""
    rest, out = list(range(len(pos_a))), []
    while len(rest) >= least:
        at, got = call([pos_a[k] for k in rest], [pos_b[k] for k in rest], [gaps[k] for k in rest], strands, cutoff)
        if not got:
            break
        out.append((*at, [rest[k] for k in got]))
        taken = set(got)
        rest = [x for k, x in enumerate(rest) if k not in taken]
    return out


def call_breakpoints(clusters: DataFrame, params: Params = DEFAULT, least: int | None = None, order: list[str] | None = None, by: tuple[str, ...] = (), all_calls: bool = False) -> DataFrame:
    """(by, KEY, cluster, call, pos_a, pos_b, support): exact breakpoints with at least `least` supporting members, or with
    all_calls those without as well."""
    order = order or ["read_id", "pos_a", "pos_b"]
    least = params.min_cluster if least is None else least
    names = [*by, *KEY, "cluster"]

    def run(pdf: pd.DataFrame, groups: list[tuple[int, int]]) -> pd.DataFrame:
        a, b, g = (pdf[c].tolist() for c in ("pos_a", "pos_b", "gap"))
        keys = list(pdf[names].itertuples(index=False, name=None))
        out = []
        for s, e in groups:
            found = peel(a[s:e], b[s:e], g[s:e], keys[s][-3:-1], least, params.match_cutoff)
            out += [(*keys[s], k, x, y, len(got)) for k, (x, y, got) in enumerate(found) if all_calls or len(got) >= least]
        return pd.DataFrame(out, columns=[*names, "call", "pos_a", "pos_b", "support"])

    kinds = "".join(f"{c} {clusters.schema[c].dataType.simpleString()}, " for c in names)
    return fold(clusters, names, order, run, kinds + "call int, pos_a long, pos_b long, support long")


def centres(clusters: DataFrame, cutoff: float) -> DataFrame:
    """(KEY, cluster, pos_a, pos_b, n_inside): the centre of every cluster in DataFrame operations.

    Members outside three windows of the mean on either axis are left out; on each axis the centre is the single most
    frequent position, else the median, rounded up on the forward strand and down on the reverse one.
    """
    group = [*KEY, "cluster"]
    stats = clusters.groupBy(*group).agg(*[f(f"pos_{s}").alias(f"{n}_{s}") for s in "ab" for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    rows = clusters.join(stats, group)
    for s in "ab":
        window = 3 * F.greatest(F.col(f"std_{s}"), F.lit(cutoff / 2.99))
        rows = rows.where(F.col(f"pos_{s}").between(F.col(f"mean_{s}") - window, F.col(f"mean_{s}") + window))
    out = rows.groupBy(*group).agg(F.expr("percentile(pos_a, 0.5)").alias("mid_a"), F.expr("percentile(pos_b, 0.5)").alias("mid_b"), F.count("*").alias("n_inside"))
    for s in "ab":
        counts = rows.groupBy(*group, f"pos_{s}").agg(F.count("*").alias("c"))
        top = counts.groupBy(*group).agg(F.max(F.struct("c", f"pos_{s}")).alias("t"), F.max("c").alias("most"))
        ties = counts.join(top.select(*group, "most"), group).where("c = most").groupBy(*group).agg(F.count("*").alias("ties"))
        out = out.join(top.select(*group, F.col(f"t.pos_{s}").alias("at")), group).join(ties, group)
        middle = F.when(F.col(f"strand_{s}") == "+", F.ceil(f"mid_{s}")).otherwise(F.floor(f"mid_{s}"))
        out = out.withColumn(f"pos_{s}", F.when(F.col("ties") == 1, F.col("at")).otherwise(middle).cast("long")).drop("at", "ties", f"mid_{s}")
    return out.select(*group, "pos_a", "pos_b", "n_inside")


def min_cluster_size(normal_cov: float, params: Params = DEFAULT) -> int:
    return max(params.min_cluster, int(params.min_bp_support * normal_cov))


def merge_calls(calls: DataFrame, distance: int = 200, closed: bool = False) -> DataFrame:
    """Calls of a key nearer than `distance` on both axes become one, with their supports added: each joins the first kept one
    that it is near, in the order of position. closed: node a may be as far as `distance`."""

    def merge(pdf: pd.DataFrame, groups: list[tuple[int, int]]) -> pd.DataFrame:
        rows, out = pdf[[*KEY, "pos_a", "pos_b", "support"]].values.tolist(), []
        for s, e in groups:
            kept: list[list] = []
            for r in rows[s:e]:
                near = next((x for x in kept if abs(x[4] - r[4]) < distance + closed and abs(x[5] - r[5]) < distance), None)
                if near is None:
                    kept.append(r)
                else:
                    near[6] += r[6]
            out += kept
        return pd.DataFrame(out, columns=[*KEY, "pos_a", "pos_b", "support"])

    cut = cut_at_gaps(cut_at_gaps(calls, KEY, "pos_a", distance, "__p1"), [*KEY, "__p1"], "pos_b", distance, "__p2")
    return fold(cut, [*KEY, "__p1", "__p2"], ["pos_a", "pos_b", "support"], merge, "chrom_a string, chrom_b string, strand_a string, strand_b string, pos_a long, pos_b long, support long")
