"""Copy-number segments, seeds, centromeres, ratios: tabular sources with explicit columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    fields = F.split(F.trim("value"), r"\s+")
    return lines.select("ord", fields.alias("f")).where((F.col("f")[0] != "") & (F.col("f")[0] != "chromosome") & ~F.col("f")[0].startswith("#"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(ord, chrom, start, end, cn, log2_cn): `.cns` files hold log2 ratios in the fifth column, `.bed` files copies in the last."""
    rows = _rows(spark, path)
    f = F.col("f")
    if path.endswith(".cns"):
        log2 = f[4].cast("double")
        cn = 2 * F.pow(F.lit(2.0), log2)
    elif path.endswith(".bed"):
        cn = F.element_at(f, -1).cast("double")
        log2 = F.log2(cn / 2)
    else:
        raise ValueError(f"neither .cns nor .bed: {path}")
    return rows.select("ord", f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), cn.alias("cn"), log2.alias("log2_cn"))


def read_bed3(spark: SparkSession, path: str) -> DataFrame:
    """(ord, chrom, start, end): seeds, or centromere regions."""
    f = F.col("f")
    return _rows(spark, path).select("ord", f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"))


def read_ratios(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, number, start, end, cn, middle) of a `.cnr` file, header skipped; number: X counts as 23 and Y as 24."""
    f = F.col("f")
    cn = 2 * F.pow(F.lit(2.0), f[5].cast("double"))
    start, end = f[1].cast("long"), f[2].cast("long")
    name = F.regexp_replace(f[0], "^chr", "")
    number = F.when(name == "X", 23).when(name == "Y", 24).otherwise(F.expr("try_cast(regexp_replace(f[0], '^chr', '') as int)"))
    return _rows(spark, path).select(f[0].alias("chrom"), number.alias("number"), start.alias("start"), end.alias("end"), cn.alias("cn"), ((start + end) / 2).alias("middle"))
