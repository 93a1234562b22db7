"""Run summaries: a header, a section for each amplicon, and solver settings and resource figures if the run was profiled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..formats import RESOURCE_HEADER, SEPARATOR, SOLVER_HEADER, SUBOPTIMAL

#: Fixed value: how numbers with separators look.
NUMBER = r"(\d[\d,]*)"


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, k, part): the parts between separator lines, the header being 0."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)_?summary\.txt$", 1)
    name = F.when(name == "", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]*$", 1)).otherwise(name)
    return spark.read.text(path, wholetext=True).select(name.alias("dataset"), F.posexplode(F.split("value", SEPARATOR)).alias("k", "part"))


def _found(pattern: str, kind: str = "string", part: str = "part") -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(part, pattern, 1), ",", ""), F.lit("")).cast(kind)


def _is_amplicon() -> Column:
    return (F.col("k") > 0) & ~F.col("part").contains(SOLVER_HEADER) & ~F.col("part").contains(RESOURCE_HEADER)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, program, version, profiled, solver, threads, time_limit, n_graphs, n_solved) of summary files."""
    rows = _parts(spark, path)
    pick = lambda where, c: F.max(F.when(where, c))
    head, settings = F.col("k") == 0, F.col("part").contains(SOLVER_HEADER)
    return rows.groupBy("dataset").agg(
        pick(head, _found(r"^(\S+) \d+\.\d+\.\d+")).alias("program"), pick(head, _found(r"^\S+ (\d+\.\d+\.\d+)")).alias("version"), pick(head, _found(r"Profiling Enabled: (True|False)", "boolean")).alias("profiled"),
        pick(settings, _found(r"Solver: (\S+)")).alias("solver"), pick(settings, _found(r"Threads: (\d+)", "int")).alias("threads"), pick(settings, _found(r"Time Limit: (\d+) s", "int")).alias("time_limit"),
        F.count_if(_is_amplicon()).alias("n_graphs"), F.count_if(_is_amplicon() & F.col("part").contains("Cycle Decomposition Status: SUCCESS")).alias("n_solved"),
    )


def read_amplicons(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, amplicon, size, n_breakpoints, status, model, k, alpha, total_weights, resolution, n_constraints, suboptimal,
    gap) of summary files, a row a section; amplicon is its number in the file, from 1."""
    rows = _parts(spark, path).where(_is_amplicon())
    meta = r"ModelMetadata: (\S+), k=(\d+|None), alpha=(\d+\.\d+|None), total_weights=(\d+\.\d+|None), resolution=(\d+\.\d+|None)(?:, num_path_constraints=(\d+))?"
    part = lambda n, kind: F.expr(f"try_cast(nullif(regexp_extract(part, '{meta}', {n}), '') as {kind})".replace("\\", "\\\\"))
    return rows.select(
        "dataset", F.col("k").alias("amplicon"), _found(rf"Amplicon Size: {NUMBER}", "long").alias("size"), _found(rf"# Discordant Edges: {NUMBER}", "long").alias("n_breakpoints"),
        _found(r"Cycle Decomposition Status: (\S+)").alias("status"), part(1, "string").alias("model"), part(2, "int").alias("model_k"), part(3, "double").alias("alpha"), part(4, "double").alias("total_weights"),
        part(5, "double").alias("resolution"), part(6, "int").alias("n_constraints"), F.col("part").contains(SUBOPTIMAL).alias("suboptimal"), _found(r"Relative MIP Gap: (\d+\.\d+)", "double").alias("gap"),
    )


def read_resources(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, call, number, ram_gb, seconds) of the resource lines; number: the amplicon's, for counted calls."""
    rows = _parts(spark, path).where(F.col("part").contains(RESOURCE_HEADER)).select("dataset", F.explode(F.split("part", "\n")).alias("line"))
    piece = lambda n: F.regexp_extract("line", r"^(\S+?)(?:/(\d+))? \| Peak RAM: ([0-9.]+) GB \| Runtime: ([0-9.]+) s", n)
    return rows.where(piece(1) != "").select("dataset", piece(1).alias("call"), F.nullif(piece(2), F.lit("")).cast("int").alias("number"), piece(3).cast("double").alias("ram_gb"), piece(4).cast("double").alias("seconds"))


def usage(resources: DataFrame) -> DataFrame:
    """(dataset, n_calls, hours, peak_gb)."""
    return resources.groupBy("dataset").agg(F.count("*").alias("n_calls"), (F.sum("seconds") / 3600).alias("hours"), F.max("ram_gb").alias("peak_gb"))


def statistics(runs: DataFrame, resources: DataFrame) -> DataFrame:
    """runs with n_calls, hours and peak_gb."""
    return runs.join(usage(resources), "dataset", "left")
