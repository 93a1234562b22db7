"""Seed intervals from copy-number segments, with chromosome-arm correction.

Input segments: (ord, chrom, start, end, cn) in file order; `end` as stored in the file. Arms: (chrom, c_start, c_end,
size): the centromere and the chromosome's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Params


def centromeres(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Arms from centromere regions (chrom, start, end): a chromosome's regions must overlap or abut, else an error."""
    w = Window.partitionBy("chrom").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.when(F.col("start") > reach, F.raise_error(F.concat(F.lit("centromere of "), F.col("chrom"), F.lit(" is not contiguous"))))
    checked = regions.withColumn("gap", gap.cast("string"))
    hull = checked.groupBy("chrom").agg(F.min("start").alias("c_start"), F.max("end").alias("c_end"), F.max("gap").alias("gap"))
    return hull.join(sizes.select("chrom", "size"), "chrom").where("gap is null").drop("gap")


def _side() -> Column:
    return F.when(F.col("end") <= F.col("c_start"), "p").when(F.col("start") >= F.col("c_end"), "q")


def arm_copy_number(segments: DataFrame, arms: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(chrom, arm, ccn): copy number at the quantile of segment length, or the normal one where segments cover too little."""
    rows = segments.join(arms, "chrom").withColumn("arm", _side()).where("arm is not null")
    rows = rows.withColumn("len", F.col("end") - F.col("start") + 1)
    rows = rows.withColumn("arm_size", F.when(F.col("arm") == "p", F.col("c_start")).otherwise(F.col("size") - F.col("c_end")))
    by = Window.partitionBy("chrom", "arm")
    rows = rows.withColumn("total", F.sum("len").over(by)).withColumn("run", F.sum("len").over(by.orderBy("cn", "ord")))
    reached = F.min(F.when(F.col("run") >= params.arm_quantile * F.col("total"), F.struct("run", "cn")))
    found = rows.groupBy("chrom", "arm").agg(reached.alias("at"), F.max("total").alias("total"), F.max("arm_size").alias("arm_size"))
    ccn = F.when(F.col("total") < params.arm_cover * F.col("arm_size"), params.normal_cn).otherwise(F.col("at.cn"))
    return found.select("chrom", "arm", ccn.alias("ccn"))


def candidate_runs(segments: DataFrame, arms: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(chrom, run, segs, c_start, c_end): runs of amplified segments clear of the centromere, gaps up to max_seg_gap."""
    rows = segments.join(arms, "chrom", "left")
    clear = F.col("c_start").isNull() | (F.col("end") <= F.col("c_start")) | (F.col("start") >= F.col("c_end"))
    rows = rows.where((F.col("cn") >= params.gain) & clear)
    w = Window.partitionBy("chrom").orderBy("ord")
    opens = F.when(F.col("start") - F.lag("end").over(w) <= params.max_seg_gap, 0).otherwise(1)
    rows = rows.withColumn("opens", opens).withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    segs = F.sort_array(F.collect_list(F.struct("ord", "start", "end", "cn")))
    return rows.groupBy("chrom", "run", "c_start", "c_end").agg(segs.alias("segs"))


def seeds(segments: DataFrame, arms: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(chrom, start, end): seed intervals, end closed.

    Inside a run, segments below the arm's cutoff are dropped and the others merged again. The length of the first
    segment of all counts one more than that of later ones; a segment that follows a written interval opens the next one
    with length 0, and one after a gap is skipped while the open interval is still too short.
    """
    ccn = arm_copy_number(segments, arms, params)
    runs = candidate_runs(segments, arms, params)
    for arm in "pq":
        own = ccn.where(F.col("arm") == arm).select("chrom", F.col("ccn").alias(f"ccn_{arm}"))
        runs = runs.join(own, "chrom", "left")
    first, last = F.col("segs")[0], F.element_at("segs", -1)
    length = F.aggregate("segs", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"] + 1)
    cutoff = F.when(length > params.large_seed, F.lit(params.large_seed_factor * params.gain)).otherwise(F.lit(params.gain))
    shift = F.when(last["end"] <= F.col("c_start"), F.coalesce("ccn_p", F.lit(params.normal_cn)) - params.normal_cn)
    shift = shift.when(first["start"] >= F.col("c_end"), F.coalesce("ccn_q", F.lit(params.normal_cn)) - params.normal_cn)
    runs = runs.withColumn("cutoff", cutoff + F.coalesce(shift, F.lit(0.0)))
    kept = F.filter("segs", lambda x: x["cn"] >= F.col("cutoff"))
    seed = "struct<start:bigint,end:bigint>"
    none = F.lit(None).cast("long")
    init = F.struct(none.alias("s"), none.alias("e"), F.lit(0).cast("long").alias("sum"), F.array().cast(f"array<{seed}>").alias("out"))

    def state(s: Column, e: Column, total: Column, out: Column) -> Column:
        return F.struct(s.alias("s"), e.alias("e"), total.alias("sum"), out.alias("out"))

    def flush(a: Column) -> Column:
        return F.concat(a["out"], F.array(F.struct(a["s"].alias("start"), (a["e"] - 1).alias("end"))))

    def step(a: Column, x: Column) -> Column:
        full = a["sum"] >= params.min_seed_size
        opened = state(x["start"], x["end"], x["end"] - x["start"] + 1, a["out"])
        grown = state(a["s"], x["end"], a["sum"] + x["end"] - x["start"], a["out"])
        written = state(x["start"], x["end"], F.lit(0).cast("long"), flush(a))
        return F.when(a["s"].isNull(), opened).when(x["start"] - a["e"] <= params.max_seg_gap, grown).when(full, written).otherwise(a)

    def end(a: Column) -> Column:
        return F.when(a["s"].isNotNull() & (a["sum"] >= params.min_seed_size), flush(a)).otherwise(a["out"])

    return runs.select("chrom", F.inline(F.aggregate(kept, init, step, end)))
