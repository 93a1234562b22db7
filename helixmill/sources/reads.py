"""Reads: SAM text, FASTQ records and quality figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, flag, chrom, start, mapq, cigar, query_length, has_seq, sa, nm): alignment lines of SAM text; start 0-based."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.size(c) >= 11))
    tag = lambda name, kind: F.nullif(F.regexp_extract("value", rf"\t{name}:{kind}:([^\t]*)", 1), F.lit(""))
    return rows.select(
        c[0].alias("read_id"), c[1].cast("int").alias("flag"), c[2].alias("chrom"), (c[3].cast("long") - 1).alias("start"), c[4].cast("int").alias("mapq"), c[5].alias("cigar"),
        F.when(c[9] == "*", 0).otherwise(F.length(c[9])).alias("query_length"), (c[9] != "*").alias("has_seq"), tag("SA", "Z").alias("sa"), tag("NM", "i").cast("int").alias("nm"),
    )


def read_contig_list(spark: SparkSession, path: str) -> DataFrame:
    """(chrom) of a list of further contigs: the first column, lines beginning with # left out."""
    rows = spark.read.text(path).select(F.trim("value").alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    return rows.select(F.split("line", r"\s+")[0].alias("chrom")).distinct()


def header_contigs(spark: SparkSession, path: str, extra: DataFrame | None = None) -> DataFrame:
    """(chrom, size) of the canonical contigs in a SAM header, and of those in the list `extra` (chrom)."""
    from ..functions.chrom import is_canonical

    rows = spark.read.text(path).where(F.col("value").startswith("@SQ"))
    rows = rows.select(F.regexp_extract("value", r"\tSN:([^\t]*)", 1).alias("chrom"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("size"))
    if extra is None:
        return rows.where(is_canonical(F.col("chrom")))
    named = rows.join(extra.select("chrom").distinct().withColumn("__more", F.lit(True)), "chrom", "left")
    return named.where(is_canonical(F.col("chrom")) | F.col("__more")).drop("__more")


def primary_lengths(records: DataFrame) -> DataFrame:
    """(read_id, length) from primary records: flag below 256."""
    return records.where("flag < 256").groupBy("read_id").agg(F.max("query_length").alias("length"))


def chimeric_tags(records: DataFrame) -> DataFrame:
    """(read_id, sa) of reads that have a primary record."""
    return records.where("sa is not null").select("read_id", "sa").join(primary_lengths(records).select("read_id"), "read_id", "left_semi")


def counts_for_coverage(records: DataFrame, all_flags: bool = True, min_mapq: int = 0) -> DataFrame:
    """Records that count for coverage: not unmapped, secondary, failed or duplicate, mapped well enough, with sequence."""
    ok = (F.col("mapq") >= min_mapq) & F.col("has_seq")
    return records.where(ok & (F.col("flag").bitwiseAND(F.lit(0x704)) == 0) if all_flags else ok)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, length, mean_quality) of four-line records. A record ends where a line begins with @ after the quality line,
    so files are split anywhere between records and no file is read as one row."""
    lines = spark.read.option("lineSep", "\n@").text(path).select(F.split("value", "\n").alias("line"))
    # a quality line may begin with @ too: then the record has too few lines, and the next row has what is missing
    whole = lines.where((F.size("line") >= 4) & F.element_at("line", 3).startswith("+"))
    at = lambda n: F.element_at("line", n)
    rows = whole.select(F.regexp_extract(at(1), r"^@?(\S+)", 1).alias("read_id"), at(2).alias("seq"), at(4).alias("qual"))
    broken = lines.where((F.size("line") == 3) & F.element_at("line", 3).startswith("+"))
    return _scored(rows).unionByName(_scored(_joined(spark, path)) if broken.limit(1).count() else _scored(rows.limit(0)))


def _joined(spark: SparkSession, path: str) -> DataFrame:
    """Records whose quality line begins with @, from the lines around them in file order."""
    rows = spark.read.option("lineSep", "\n@").text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.split("value", "\n").alias("line"))
    w = Window.partitionBy("file").orderBy("at")
    both = rows.withColumn("more", F.lead("line").over(w)).where((F.size("line") == 3) & F.element_at("line", 3).startswith("+"))
    return both.select(F.regexp_extract(F.element_at("line", 1), r"^@?(\S+)", 1).alias("read_id"), F.element_at("line", 2).alias("seq"), F.concat(F.lit("@"), F.element_at("more", 1)).alias("qual"))


def _scored(rows: DataFrame) -> DataFrame:
    score = F.aggregate(F.split("qual", ""), F.lit(0).cast("long"), lambda s, x: s + F.when(x == "", 0).otherwise(F.ascii(x) - 33))
    return rows.select("read_id", F.length("seq").alias("length"), (score / F.length("qual")).alias("mean_quality"))


def quantiles(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """q25, q50 and q75 with linear interpolation."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")
    out = rows.groupBy(*by).agg(q)
    return out.select(*by, *[F.round(F.col("q")[k], 6).alias(f"q{p}") for k, p in enumerate((25, 50, 75))])


def fingerprint(files: DataFrame) -> DataFrame:
    """(path, size, mtime) of binaryFile rows: the key under which a scan of them is kept."""
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def cached(spark: SparkSession, files: DataFrame, scan: Callable[[], DataFrame], folder: str) -> DataFrame:
    """scan(), kept as Parquet in `folder` under the fingerprint of the files (binaryFile rows): read again as long as path,
    size and time of all files are the same."""
    key = fingerprint(files).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("|", "path", "size", "mtime"))), ";"), 256)).first()[0]
    path = f"{folder.rstrip('/')}/{key}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        scan().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def numbered(lines: DataFrame) -> DataFrame:
    """Lines with their order within a file."""
    return lines.withColumn("ord", F.row_number().over(Window.partitionBy("file").orderBy("at")))
