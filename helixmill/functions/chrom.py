"""Chromosome names: natural order and canonical test, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^(?i:chr)", "")


def sort_key(chrom: Column) -> Column:
    """Struct that sorts autosomes by number, then X, Y (in either case), other names by text, and the mitochondrion last."""
    s, up = stem(chrom), F.upper(stem(chrom))
    number, last = s.rlike("^[0-9]+$"), up.isin("M", "MT")
    rank = F.when(number, 0).when(last, 2).otherwise(1)
    place = F.when(number, s.cast("int")).when(last | (up == "X"), 0).when(up == "Y", 1).otherwise(2)
    rest = F.when(number | up.isin("X", "Y", "M", "MT"), F.lit("")).otherwise(s)
    return F.struct(rank.alias("k0"), place.alias("k1"), rest.alias("k2"))


def is_autosome(chrom: Column) -> Column:
    return stem(chrom).rlike("^[0-9]+$")


def is_canonical(chrom: Column) -> Column:
    """Autosomes, X, Y and the mitochondrion, with or without `chr`."""
    return is_autosome(chrom) | F.upper(stem(chrom)).isin("X", "Y", "M", "MT")
