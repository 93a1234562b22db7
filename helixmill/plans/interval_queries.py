"""Interval joins, islands and coverage: queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import testbed as t
from ..functions.intervals import Span, intersection
from ..operators import coverage, islands, joins, reads
from ..registry import query


def _segments(spark, sf_dir, least=0.0):
    s = t.cn_segments(spark, sf_dir)
    return s.where(F.col("cn") >= least) if least else s


@query(f"""WITH {t.SEGMENTS}, {t.ALIGNMENTS}
SELECT a.read_id, a.q_start, a.chrom, a.r_start, a.r_end, x.seg_idx AS idx_start, y.seg_idx AS idx_end, COUNT(*) AS n
FROM aln a LEFT JOIN seg x ON a.chrom = x.chrom AND a.r_start BETWEEN x.seg_start AND x.seg_end LEFT JOIN seg y ON a.chrom = y.chrom AND a.r_end BETWEEN y.seg_start AND y.seg_end
GROUP BY ALL""")
def alignment_segment_hash(spark, sf_dir):
    hits = reads.segment_hits(t.alignments(spark, sf_dir), t.cn_segments(spark, sf_dir))
    return hits.groupBy("read_id", "q_start", "chrom", "r_start", "r_end", "idx_start", "idx_end").agg(F.count("*").alias("n"))


@query(f"""WITH {t.SEGMENTS}, {t.ALIGNMENTS}
SELECT s.chrom, s.seg_idx, COUNT(*) AS n, CAST(SUM(CASE WHEN a.r_start >= s.seg_start AND a.r_end <= s.seg_end THEN 1 ELSE 0 END) AS BIGINT) AS inside
FROM aln a JOIN seg s ON a.chrom = s.chrom AND a.r_start <= s.seg_end AND a.r_end >= s.seg_start GROUP BY s.chrom, s.seg_idx""")
def interval_overlap_join(spark, sf_dir):
    # alignments of one interval meet a segment as one row with their number, so no bin has a row for each of them
    one = t.alignments(spark, sf_dir).groupBy("chrom", "r_start", "r_end").agg(F.count("*").alias("copies"))
    met = joins.range_join(one, _segments(spark, sf_dir), ["chrom"], ("r_start", "r_end"), ("seg_start", "seg_end"))
    inside = F.when((F.col("r_start") >= F.col("seg_start")) & (F.col("r_end") <= F.col("seg_end")), F.col("copies")).otherwise(0)
    return met.groupBy("chrom", "seg_idx").agg(F.sum("copies").alias("n"), F.sum(inside).alias("inside"))


@query(f"""WITH {t.SEGMENTS}, {t.ALIGNMENTS}, b AS (SELECT DISTINCT chrom, r_start, r_end FROM aln WHERE mapq >= 20)
SELECT b.chrom, GREATEST(r_start, seg_start - 1000) AS "start", LEAST(r_end, seg_end + 1000) AS "end", seg_idx
FROM b JOIN seg s ON b.chrom = s.chrom AND r_start <= seg_end + 1000 AND r_end >= seg_start - 1000 WHERE cn >= 5""")
def interval_intersection(spark, sf_dir):
    b = t.alignments(spark, sf_dir).where("mapq >= 20").select("chrom", "r_start", "r_end").distinct()
    s = _segments(spark, sf_dir, 5.0).select("chrom", "seg_idx", (F.col("seg_start") - 1000).alias("seg_start"), (F.col("seg_end") + 1000).alias("seg_end"))
    met = joins.range_join(b, s, ["chrom"], ("r_start", "r_end"), ("seg_start", "seg_end"))
    c = F.col("chrom")
    both = intersection(Span(c, F.col("r_start"), F.col("r_end")), Span(c, F.col("seg_start"), F.col("seg_end")))
    return met.select("chrom", both["start"].alias("start"), both["end"].alias("end"), "seg_idx")


@query(f"""WITH {t.ALIGNMENTS},
one AS (SELECT chrom, r_start, r_end, COUNT(*) AS n FROM aln GROUP BY ALL),
m AS (SELECT *, MAX(r_end) OVER (PARTITION BY chrom ORDER BY r_start, r_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM one),
i AS (SELECT *, SUM(CASE WHEN reach IS NULL OR r_start > reach + 10000 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY r_start, r_end ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT chrom, MIN(r_start) AS "start", MAX(r_end) AS "end", CAST(SUM(n) AS BIGINT) AS n FROM i GROUP BY chrom, island""")
def interval_union_padded(spark, sf_dir):
    a = t.alignments(spark, sf_dir).select("chrom", F.col("r_start").alias("start"), F.col("r_end").alias("end"), F.lit(1).cast("long").alias("n"))
    return islands.merge_intervals(a, ["chrom"], 10_000, {"n": "sum"}, bin_size=100_000)


@query(f"""WITH {t.SEGMENTS}, {t.ALIGNMENTS},
m AS (SELECT chrom, r_start, r_end, MAX(r_end) OVER (PARTITION BY chrom ORDER BY r_start, r_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT chrom, r_start, r_end FROM aln)),
i AS (SELECT *, SUM(CASE WHEN reach IS NULL OR r_start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY r_start, r_end ROWS UNBOUNDED PRECEDING) AS island FROM m),
c AS (SELECT chrom, MIN(r_start) AS s, MAX(r_end) AS e FROM i GROUP BY chrom, island),
h AS (SELECT g.chrom, g.seg_idx, g.seg_start, g.seg_end, c.s, c.e FROM seg g LEFT JOIN c ON g.chrom = c.chrom AND c.s <= g.seg_end AND c.e >= g.seg_start),
p AS (
  SELECT chrom, seg_idx, COALESCE(LAG(e) OVER w + 1, seg_start) AS a, COALESCE(s - 1, seg_end) AS b FROM h WINDOW w AS (PARTITION BY chrom, seg_idx ORDER BY s)
  UNION ALL SELECT chrom, seg_idx, MAX(e) + 1, MAX(seg_end) FROM h WHERE e IS NOT NULL GROUP BY chrom, seg_idx)
SELECT chrom, seg_idx, a AS "start", b AS "end" FROM p WHERE a <= b""")
def interval_subtract(spark, sf_dir):
    s = t.cn_segments(spark, sf_dir).select(F.concat_ws(":", "chrom", "seg_idx").alias("id"), "chrom", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"))
    a = t.alignments(spark, sf_dir).select("chrom", F.col("r_start").alias("start"), F.col("r_end").alias("end"))
    out = islands.subtract(s, a, ["chrom"], "id")
    return out.select("chrom", F.split("id", ":")[1].cast("long").alias("seg_idx"), "start", "end")


@query(f'WITH {t.INTERVALS} SELECT amplicon_id, chrom, s AS "start", e AS "end" FROM amp')
def interval_adjacent_islands(spark, sf_dir):
    return t.intervals(spark, sf_dir).select("amplicon_id", "chrom", "start", "end")


@query(f"""WITH {t.SEGMENTS}, {t.ALIGNMENTS}
SELECT s.chrom, s.seg_idx, CAST(COALESCE(SUM(LEAST(r_end, seg_end + 1) - GREATEST(r_start, seg_start)) FILTER (WHERE a.chrom IS NOT NULL), 0) AS BIGINT) AS bases
FROM seg s LEFT JOIN aln a ON a.chrom = s.chrom AND r_start <= seg_end AND r_end > seg_start GROUP BY s.chrom, s.seg_idx""")
def coverage_raw(spark, sf_dir):
    s = t.cn_segments(spark, sf_dir).select("chrom", "seg_idx", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"))
    b = t.alignments(spark, sf_dir).select("chrom", F.col("r_start").alias("b_start"), F.col("r_end").alias("b_end"))
    return coverage.raw_coverage(s, b, ["chrom"]).select("chrom", "seg_idx", "bases")


@query(f"""WITH {t.ALIGNMENTS}, r AS (SELECT DISTINCT chrom, CAST(FLOOR(r_start / 1000000.0) AS BIGINT) * 1000000 AS s FROM aln),
w AS (SELECT chrom, s + k * 150 AS a, LEAST(s + k * 150 + 149, s + 5599) AS b FROM r, (SELECT UNNEST(range(38)) AS k))
SELECT w.chrom, w.a AS "start", w.b AS "end", CAST(COALESCE(SUM(LEAST(r_end, b + 1) - GREATEST(r_start, a)) FILTER (WHERE x.chrom IS NOT NULL), 0) AS BIGINT) AS bases
FROM w LEFT JOIN aln x ON x.chrom = w.chrom AND r_start <= b AND r_end > a GROUP BY w.chrom, w.a, w.b""")
def coverage_windows(spark, sf_dir):
    a = t.alignments(spark, sf_dir)
    at = F.floor(F.col("r_start") / 1_000_000) * 1_000_000
    regions = a.select("chrom", at.alias("start")).distinct().withColumn("end", F.col("start") + 5_599)
    b = a.select("chrom", F.col("r_start").alias("b_start"), F.col("r_end").alias("b_end"))
    return coverage.raw_coverage(coverage.windows(regions, 150), b, ["chrom"], bin_size=2_000)
