"""Cycles and paths as ordered segments: BED conversion, ranking, breakpoint edges.

Segments: (cycle_id, ord, chrom, start, end, strand).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chrom import sort_key


def merge_steps(segments: DataFrame) -> DataFrame:
    """Consecutive segments that abut in the direction of travel become one (cycle_id, ord, chrom, start, end, strand).

    Whether two neighbours abut doesn't change by merging, so islands of abutting neighbours give the same pieces.
    """
    w = Window.partitionBy("cycle_id").orderBy("ord")
    same = (F.col("chrom") == F.lag("chrom").over(w)) & (F.col("strand") == F.lag("strand").over(w))
    forward = (F.col("strand") == "+") & (F.lag("end").over(w) + 1 == F.col("start"))
    backward = (F.col("strand") == "-") & (F.lag("start").over(w) - 1 == F.col("end"))
    rows = segments.withColumn("opens", F.when(same & (forward | backward), 0).otherwise(1))
    rows = rows.withColumn("piece", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("cycle_id", "piece", "chrom", "strand").agg(F.min("ord").alias("ord"), F.min("start").alias("start"), F.max("end").alias("end")).drop("piece")


def to_bed(segments: DataFrame, cycles: DataFrame, wrap: bool = True) -> DataFrame:
    """(cycle_id, ord, chrom, start, end, strand, iscyclic, weight) of merged segments; with wrap the last piece of a
    cycle joins its first where they abut. cycles: (cycle_id, iscyclic, weight)."""
    rows = merge_steps(segments).join(cycles, "cycle_id")
    if wrap:
        w = Window.partitionBy("cycle_id").orderBy("ord")
        n = F.count("*").over(Window.partitionBy("cycle_id"))
        at = F.row_number().over(w)
        full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        f = {c: F.first(c).over(full) for c in ("chrom", "start", "end", "strand")}
        z = {c: F.last(c).over(full) for c in ("chrom", "start", "end", "strand")}
        same = F.col("iscyclic") & (n > 1) & (f["chrom"] == z["chrom"]) & (f["strand"] == z["strand"])
        plus = same & (f["strand"] == "+") & (z["end"] + 1 == f["start"])
        minus = same & (f["strand"] == "-") & (z["start"] - 1 == f["end"])
        rows = rows.withColumns({"at": at, "n": n, "plus": plus, "minus": minus, "z_start": z["start"], "z_end": z["end"]})
        rows = rows.where(~((F.col("plus") | F.col("minus")) & (F.col("at") == F.col("n"))))
        first = F.col("at") == 1
        rows = rows.withColumn("start", F.when(first & F.col("plus"), F.col("z_start")).otherwise(F.col("start")))
        rows = rows.withColumn("end", F.when(first & F.col("minus"), F.col("z_end")).otherwise(F.col("end")))
    return rows.select("cycle_id", F.row_number().over(Window.partitionBy("cycle_id").orderBy("ord")).alias("ord"), "chrom", "start", "end", "strand", "iscyclic", "weight")


def rotate_to_least(rows: DataFrame) -> DataFrame:
    """Segments of to_bed() with those of cycles turned so that the smallest (chromosome, start) comes first; a cycle that runs on
    the reverse strand there is turned around. A path whose last segment is the smaller end is reversed, and its strands are
    turned if it would begin on the reverse one."""
    w = Window.partitionBy("cycle_id")
    place = F.struct(sort_key(F.col("chrom")).alias("k"), F.col("start").alias("s"))
    one = F.struct("ord", "strand", place.alias("at"))
    rows = rows.withColumn("least", F.min_by(one, F.struct(place, F.col("end"), F.col("ord"))).over(w)).withColumn("n", F.count("*").over(w))
    rows = rows.withColumn("head", F.min_by(one, "ord").over(w)).withColumn("tail", F.max_by(one, "ord").over(w))
    around = F.col("iscyclic") & (F.col("least.strand") == "-")
    back = ~F.col("iscyclic") & (F.col("tail.at") < F.col("head.at"))
    n, at, first = F.col("n"), F.col("ord"), F.col("least.ord")
    turned = F.when(around, F.pmod(first - at, n) + 1).when(F.col("iscyclic"), F.pmod(at - first, n) + 1).when(back, n + 1 - at).otherwise(at)
    strand = F.when(around | (back & (F.col("tail.strand") == "-")), F.translate("strand", "+-", "-+")).otherwise(F.col("strand"))
    return rows.withColumn("ord", turned.cast("int")).withColumn("strand", strand).drop("least", "n", "head", "tail")


def rank(cycles: DataFrame, group: str = "amplicon_id") -> DataFrame:
    """Cycles numbered by weight, heaviest first; ties by id."""
    return cycles.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("weight"), "cycle_id")))


def breakpoint_edges(segments: DataFrame, cycles: DataFrame) -> DataFrame:
    """Distinct joints between consecutive segments, the last with the first in cycles, lower end first."""
    rows = segments.join(cycles.select("cycle_id", "iscyclic"), "cycle_id")
    w = Window.partitionBy("cycle_id").orderBy("ord")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    enter = F.struct("chrom", F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end")).alias("pos"), F.when(F.col("strand") == "+", "-").otherwise("+").alias("strand"))
    leave = F.struct("chrom", F.when(F.col("strand") == "+", F.col("end")).otherwise(F.col("start")).alias("pos"), F.col("strand").alias("strand"))
    rows = rows.withColumn("enter", enter).withColumn("leave", leave)
    rows = rows.withColumn("to", F.coalesce(F.lead("enter").over(w), F.when(F.col("iscyclic"), F.first("enter").over(full)))).where("to is not null")
    x, y = F.least("leave", "to"), F.greatest("leave", "to")
    return rows.select(x.alias("x"), y.alias("y")).select(*[F.col(f"{s}.{c}").alias(f"{c}{k}") for k, s in ((1, "x"), (2, "y")) for c in ("chrom", "pos", "strand")]).distinct()
