"""Closed-interval algebra as columns. An interval is a triple of columns: chromosome, start, end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Span:
    chrom: Column
    start: Column
    end: Column

    @property
    def length(self) -> Column:
        return self.end - self.start + 1


def span(prefix: str = "", chrom: str = "chrom", start: str = "start", end: str = "end") -> Span:
    return Span(F.col(prefix + chrom), F.col(prefix + start), F.col(prefix + end))


def overlaps(a: Span, b: Span) -> Column:
    return (a.chrom == b.chrom) & (a.start <= b.end) & (a.end >= b.start)


def overlaps_as_stored(a: Span, b: Span) -> Column:
    """The test as breakpoint calling applies it: on reverse strands start > end, so it asks for containment there."""
    return overlaps(a, b)


def within(a: Span, b: Span) -> Column:
    return (a.chrom == b.chrom) & (a.start >= b.start) & (a.end <= b.end)


def holds_point(a: Span, chrom: Column, pos: Column) -> Column:
    return (a.chrom == chrom) & (a.start <= pos) & (pos <= a.end)


def holds_inside(a: Span, chrom: Column, pos: Column) -> Column:
    """Strictly inside."""
    return (a.chrom == chrom) & (a.start < pos) & (pos < a.end)


def adjacent(a: Span, b: Span) -> Column:
    return (a.chrom == b.chrom) & ((a.end + 1 == b.start) | (b.end + 1 == a.start))


def near(a: Span, b: Span, extend: Column | int = 0, margin: float = 0.0) -> Column:
    """Overlap of a, extended by `extend` (not below 0), with b; with a margin, of either shrunk by that share of its length."""
    plain = (a.chrom == b.chrom) & (F.greatest(F.lit(0), a.start - extend) <= b.end) & (a.end + extend >= b.start)
    if not margin:
        return plain
    cut_a, cut_b = a.length * margin, b.length * margin
    return (a.chrom == b.chrom) & (((a.start + cut_a <= b.end) & (a.end - cut_a >= b.start)) | ((b.start + cut_b <= a.end) & (b.end - cut_b >= a.start)))


def intersection(a: Span, b: Span) -> Column:
    return F.when(overlaps(a, b), F.struct(a.chrom.alias("chrom"), F.greatest(a.start, b.start).alias("start"), F.least(a.end, b.end).alias("end")))


def hull(a: Span, b: Span) -> Column:
    return F.struct(a.chrom.alias("chrom"), F.least(a.start, b.start).alias("start"), F.greatest(a.end, b.end).alias("end"))
