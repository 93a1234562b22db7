"""Gene annotation: refGene tables, gene lists, and the first transcript of each gene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SKIP = "^(LOC|LINC|MIR)"


def read_refgene(spark: SparkSession, path: str, prefix: bool = False) -> DataFrame:
    """(gene, chrom, strand, start, end, exons, ord) of a tab-separated refGene file; genes named LOC, LINC or MIR are left out."""
    c = F.split("value", "\t")
    starts, ends = (F.transform(F.filter(F.split(c[k], ","), lambda x: x != ""), lambda x: x.cast("long")) for k in (9, 10))
    chrom = F.concat(F.lit("chr"), c[2]) if prefix else c[2]
    rows = spark.read.text(path).where(F.col("value") != "").withColumn("ord", F.monotonically_increasing_id())
    rows = rows.select(F.element_at(c, -4).alias("gene"), chrom.alias("chrom"), c[3].alias("strand"), c[4].cast("long").alias("start"), c[5].cast("long").alias("end"), F.arrays_zip(starts.alias("s"), ends.alias("e")).alias("exons"), "ord")
    return rows.where(~F.col("gene").rlike(SKIP))


def first_transcripts(transcripts: DataFrame) -> DataFrame:
    """The transcript of each gene that comes first in file order (column ord)."""
    w = Window.partitionBy("gene").orderBy("ord")
    return transcripts.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct genes (gene, ord) of a list separated by white space or commas, in order of first mention."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"[\s,]+")).alias("ord", "gene"))
    return rows.where("gene <> ''").groupBy("gene").agg(F.min("ord").alias("ord"))


def merge_gene_lists(spark: SparkSession, names: list[str], listed: DataFrame | None = None) -> DataFrame:
    """Distinct genes (gene, ord): the names in their order, then those of a list (gene, ord) that aren't among them."""
    rows = spark.createDataFrame([(g, k) for k, g in enumerate(names)], "gene string, ord long")
    if listed is not None:
        rows = rows.union(listed.select("gene", (F.col("ord") + len(names)).cast("long")))
    return rows.groupBy("gene").agg(F.min("ord").alias("ord"))


def gtf_to_refgene(gtf: DataFrame, names: DataFrame) -> DataFrame:
    """(gene, chrom, strand, start, end, exon_starts, exon_ends) from GTF rows (seqname, feature, start, end, strand,
    attributes, ord) and names (accession, chrom): pseudogenes dropped, first transcript, 0-based half-open."""
    pick = lambda key: F.regexp_extract("attributes", rf'{key} "([^"]*)"', 1)
    rows = gtf.withColumns({"gene": pick("gene_id"), "transcript": pick("transcript_id"), "biotype": pick("gene_biotype")})
    pseudo = rows.where(F.col("biotype").contains("pseudogene")).select("gene").distinct()
    exons = rows.where("feature = 'exon'").join(pseudo, "gene", "left_anti").join(names, F.col("seqname") == F.col("accession"))
    first = exons.groupBy("gene").agg(F.min_by("transcript", "ord").alias("transcript"))
    kept = exons.join(first, ["gene", "transcript"])
    parts = F.sort_array(F.collect_list(F.struct((F.col("start") - 1).alias("s"), F.col("end").alias("e"))))
    out = kept.groupBy("gene", "transcript", "chrom", "strand").agg(parts.alias("x"))
    return out.select("gene", "chrom", "strand", F.array_min("x.s").alias("start"), F.array_max("x.e").alias("end"), F.concat(F.array_join("x.s", ","), F.lit(",")).alias("exon_starts"), F.concat(F.array_join("x.e", ","), F.lit(",")).alias("exon_ends"))
