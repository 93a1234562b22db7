"""Graph and cycles files: one line a record, recognised by its first field; other lines are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODE = r"([^:]+):(\d+)([+-])"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    return rows.withColumn("amplicon_id", F.regexp_extract("file", r"amplicon(\d+)", 1).cast("long"))


def _nodes(text: Column) -> list[Column]:
    part = lambda k: F.regexp_extract(text, rf"^{NODE}(?:->{NODE})?$", k)
    return [part(1).alias("chrom1"), part(2).cast("long").alias("pos1"), part(3).alias("strand1"), part(4).alias("chrom2"), part(5).cast("long").alias("pos2"), part(6).alias("strand2")]


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges (amplicon_id, kind, ends, cn, reads, length) and path constraints (amplicon_id, pc_idx, path, support) of graph
    files; the amplicon's number is taken from the file's name. A constraint is an array of struct(edge, strand, n)."""
    rows = _lines(spark, path)
    f = F.split("value", "\t")
    kind = f[0]
    seq = rows.where(kind == "sequence").select("amplicon_id", kind.alias("kind"), *[x for x in _nodes(F.concat(f[1], F.lit("->"), f[2]))], f[3].cast("double").alias("cn"), f[6].cast("double").cast("long").alias("reads"), f[5].cast("long").alias("length"))
    joints = rows.where(kind.isin("concordant", "discordant")).select("amplicon_id", kind.alias("kind"), *_nodes(f[1]), f[2].cast("double").alias("cn"), f[3].cast("double").cast("long").alias("reads"), F.lit(None).cast("long").alias("length"))
    tokens = F.transform(F.split(f[1], ","), lambda x: F.struct(F.regexp_extract(x, r"^([a-z]+\d+)", 1).alias("edge"), F.regexp_extract(x, r"([+-]):\d+$", 1).alias("strand"), F.regexp_extract(x, r":(\d+)$", 1).cast("int").alias("n")))
    w = Window.partitionBy("amplicon_id").orderBy("at")
    paths = rows.where(kind == "path_constraint").select("amplicon_id", (F.row_number().over(w) - 1).alias("pc_idx"), tokens.alias("path"), f[2].cast("long").alias("support"))
    return seq.unionByName(joints), paths


def read_cycles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Walks (amplicon_id, cycle_id, iscyclic, weight) and their segments (amplicon_id, cycle_id, ord, chrom, start, end,
    strand) of cycles files. A walk is a path if it begins with 0+ and ends with 0-."""
    rows = _lines(spark, path)
    f = F.split("value", "\t")
    names = rows.where(f[0] == "Segment").select("amplicon_id", f[1].alias("name"), f[2].alias("chrom"), f[3].cast("long").alias("start"), f[4].cast("long").alias("end"))
    value = lambda key: F.regexp_extract("value", rf"(?:^|;){key}=([^;]*)", 1)
    steps = F.regexp_extract_all(value("Segments"), F.lit(r"(\d+[+-])"))
    walks = rows.where(F.col("value").rlike("^(Cycle|Path)=")).select("amplicon_id", F.coalesce(F.nullif(value("Cycle"), F.lit("")), value("Path")).cast("long").alias("cycle_id"), value("Copy_count").cast("double").alias("weight"), steps.alias("steps"))
    path_like = (F.element_at("steps", 1) == "0+") & (F.element_at("steps", -1) == "0-")
    walks = walks.withColumn("iscyclic", ~path_like)
    one = walks.select("amplicon_id", "cycle_id", F.posexplode(F.filter("steps", lambda x: ~x.startswith("0+") & ~x.startswith("0-"))).alias("ord", "step"))
    one = one.select("amplicon_id", "cycle_id", (F.col("ord") + 1).alias("ord"), F.regexp_extract("step", r"^\d+", 0).alias("name"), F.right("step", F.lit(1)).alias("strand"))
    segments = one.join(names, ["amplicon_id", "name"]).select("amplicon_id", "cycle_id", "ord", "chrom", "start", "end", "strand")
    return walks.select("amplicon_id", "cycle_id", "iscyclic", "weight"), segments


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(amplicon_id, chrom, start, end) of the Interval lines of cycles files."""
    f = F.split("value", "\t")
    return _lines(spark, path).where(f[0] == "Interval").select("amplicon_id", f[2].alias("chrom"), f[3].cast("long").alias("start"), f[4].cast("long").alias("end"))


def most_copies(edges: DataFrame) -> DataFrame:
    """(amplicon_id, max_cn): the largest copy number of an amplicon's sequence edges, and one."""
    return edges.where("kind = 'sequence'").groupBy("amplicon_id").agg((F.max("cn") + 1).alias("max_cn"))


def ends_by_name(edges: DataFrame) -> DataFrame:
    """Edges with the smaller end first, chromosomes in the order of their text, as score tables have them."""
    x, y = (F.struct(F.col(f"chrom{k}").alias("chrom"), F.col(f"pos{k}").alias("pos"), F.col(f"strand{k}").alias("strand")) for k in (1, 2))
    turn = (F.col("chrom2") < F.col("chrom1")) | ((F.col("chrom2") == F.col("chrom1")) & (F.col("pos2") < F.col("pos1")))
    rows = edges.withColumn("x", F.when(turn, y).otherwise(x)).withColumn("y", F.when(turn, x).otherwise(y))
    return rows.withColumns({f"{c}{k}": F.col(f"{s}.{c}") for k, s in ((1, "x"), (2, "y")) for c in ("chrom", "pos", "strand")}).drop("x", "y")


def pair_files(graphs: DataFrame, cycles: DataFrame) -> DataFrame:
    """Graph files (file) with the cycles file of the same name up to its ending, or null."""
    key = lambda ending: F.regexp_replace("file", rf"_{ending}\.txt$", "")
    g = graphs.select(key("graph").alias("name"), F.col("file").alias("graph_file"))
    c = cycles.select(key("cycles").alias("name"), F.col("file").alias("cycles_file"))
    return g.join(c, "name", "left")
