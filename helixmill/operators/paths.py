"""Path constraints from reads: validity, canonical direction, support, and the maximal ones.

A path is an array of strings: the edge types and numbers it passes, e.g. e1, c1, e2.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_valid(path: Column) -> Column:
    """Odd, at least three edges, sequence edges (e) at even places only, which puts them at both ends."""
    kinds = F.transform(path, lambda x, i: (F.substring(x, 1, 1) == "e") == (i % 2 == 0))
    return (F.size(path) >= 3) & (F.size(path) % 2 == 1) & F.forall(kinds, lambda k: k)


def canonical(path: Column) -> Column:
    """A path and its reverse are one."""
    return F.least(path, F.reverse(path))


def edge_counts(path: Column) -> Column:
    """Sorted array of struct(edge, n): how often the path passes each edge."""
    return F.transform(F.array_sort(F.array_distinct(path)), lambda e: F.struct(e.alias("edge"), F.size(F.filter(path, lambda x: x == e)).alias("n")))


def as_text(path: Column) -> Column:
    """A path, array of struct(edge, strand), as text of edges, strands and how often the path passes the edge: e2+:1,c2-:1,..."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["edge"], x["strand"], F.lit(":"), F.size(F.filter(path, lambda y: y["edge"] == x["edge"])).cast("string"))), ",")


def longest_unsatisfied(found: DataFrame, by: list[str]) -> DataFrame:
    """Of the candidate orders of a walk (by, candidate, n_paths, length, support: the path constraints it leaves unsatisfied, their
    total length and support) the one that leaves the fewest, then the shortest, then the least supported; ties by candidate."""
    return found.groupBy(*by).agg(F.min_by("candidate", F.struct("n_paths", "length", "support", "candidate")).alias("candidate"))


def support(paths: DataFrame, *by: str) -> DataFrame:
    """(by, path, support): number of reads of (by, read_id, path) for each path up to reversal."""
    return paths.groupBy(*by, canonical(F.col("path")).alias("path")).agg(F.count("*").alias("support"))


def maximal(supported: DataFrame, group: str = "amplicon_id") -> DataFrame:
    """(group, path, support): paths of a group whose edges, with multiplicity, are no sub-multiset of another path's.

    Paths are tried from the last to the first, in text order; a path that goes lifts the first path that holds it to its
    own support if that is larger. One amplicon's distinct paths are one task: they are few, and containment needs all.
    """
    kind = supported.schema[group].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(text=[",".join(p) for p in pdf["path"]]).sort_values("text", kind="stable")
        counts = [Counter(p) for p in pdf["path"]]
        holders: dict[str, list[int]] = {}  # paths by edge, in order: a path can only be held by paths that have its rarest edge
        for row, c in enumerate(counts):
            for e in c:
                holders.setdefault(e, []).append(row)
        support, alive = pdf["support"].to_numpy().copy(), np.ones(len(pdf), dtype=bool)
        for row in range(len(pdf) - 1, -1, -1):
            own = counts[row]
            some = holders[min(own, key=lambda e: (len(holders[e]), e))]
            parent = next((k for k in some if k != row and alive[k] and all(counts[k][e] >= n for e, n in own.items())), None)
            if parent is not None:
                support[parent] = max(support[parent], support[row])
                alive[row] = False
        return pd.DataFrame({group: pdf[group].to_numpy()[alive], "path": pdf["text"].to_numpy()[alive], "support": support[alive]})

    return supported.groupBy(group).applyInPandas(run, f"{group} {kind}, path string, support long")
