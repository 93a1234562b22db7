"""Connected components by alternating star contractions: every step is a partial aggregate and an equi-join.

Each round is a written table, so lineage stays short and lost executors cost one round. Ids are longs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of the undirected edges (u, v). Rounds go on until one
    changes nothing."""
    u, v = F.col("u"), F.col("v")
    now = stored(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.union(now.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(small, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        now = stored(rest.union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return now.select(u.alias("node"), v.alias("component")).union(now.select(v, v)).distinct()


def merge_connected(intervals: DataFrame, links: DataFrame) -> DataFrame:
    """Intervals (interval_id, amplicon_id, ...) with the ids of amplicons that links join made one, the smallest.

    links: (interval_a, interval_b); an end outside all intervals is null and is skipped.
    """
    ids = intervals.select("interval_id", "amplicon_id")
    a = links.join(ids.withColumnsRenamed({"interval_id": "interval_a", "amplicon_id": "u"}), "interval_a")
    both = a.join(ids.withColumnsRenamed({"interval_id": "interval_b", "amplicon_id": "v"}), "interval_b")
    found = connected_components(both.select("u", "v"))
    out = intervals.join(found, F.col("amplicon_id") == F.col("node"), "left")
    return out.withColumn("amplicon_id", F.coalesce("component", "amplicon_id")).drop("node", "component")


def merge_touching(intervals: DataFrame, connections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intervals (interval_id, amplicon_id, chrom, start, end) that overlap or abut become one, with the smallest ids of its parts;
    connections (interval_a, interval_b, breakpoints: array) lead to the merged ones, those of the same pair joined."""
    w = Window.partitionBy("chrom").orderBy("start", "end", "interval_id")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("opens", F.when(before.isNull() | (F.col("start") > before + 1), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy("chrom", "run").agg(F.min("interval_id").alias("interval_id"), F.min("amplicon_id").alias("amplicon_id"), F.min("start").alias("start"), F.max("end").alias("end"))
    names = rows.select("chrom", "run", F.col("interval_id").alias("old")).join(merged.select("chrom", "run", "interval_id"), ["chrom", "run"]).select("old", F.col("interval_id").alias("new"))
    out = connections
    for side in ("interval_a", "interval_b"):
        out = out.join(names.withColumnRenamed("old", side), side).drop(side).withColumnRenamed("new", side)
    low, high = F.least("interval_a", "interval_b"), F.greatest("interval_a", "interval_b")
    joined = out.groupBy(low.alias("interval_a"), high.alias("interval_b")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("breakpoints")))).alias("breakpoints"))
    return merged.select("interval_id", "amplicon_id", "chrom", "start", "end"), joined
