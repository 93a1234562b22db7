"""Tables of simulated amplicons, and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_simulated(spark: SparkSession, path: str) -> DataFrame:
    """(amplicon, type, breakpoints, coverage, replicate) of a tab-separated file without header, whose columns read like
    bp10, 250x and amplicon2; a row that doesn't is an error."""
    raw = spark.read.schema("type string, breakpoints string, coverage string, replicate string").option("sep", "\t").csv(path)
    number = lambda c, pattern: F.coalesce(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).cast("int"), F.raise_error(F.concat(F.lit(f"no {c}: "), F.coalesce(F.col(c), F.lit("null")))).cast("int"))
    rows = raw.select("type", number("breakpoints", r"bp(\d+)").alias("breakpoints"), number("coverage", r"(\d+)x").alias("coverage"), number("replicate", r"amplicon(\d+)").alias("replicate"))
    name = F.concat("type", F.lit("_bp"), F.col("breakpoints").cast("string"), F.lit("_amplicon"), F.col("replicate").cast("string"))
    return rows.select(name.alias("amplicon"), "type", "breakpoints", "coverage", "replicate")


def with_class(scores: DataFrame, simulated: DataFrame) -> DataFrame:
    """Scores (amplicon, ...) with coverage and type of the simulated amplicon of that name."""
    return scores.join(simulated.select("amplicon", "coverage", "type"), "amplicon", "left")
