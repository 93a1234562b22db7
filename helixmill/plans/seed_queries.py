"""Seeding and copy number: queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import testbed as t
from ..functions import chrom as chroms
from ..operators import coverage, seeding
from ..registry import query

ARM = t.SEGMENTS + f""",
sized AS (SELECT chrom, MAX(seg_end + 1) AS size FROM seg GROUP BY chrom),
sided AS (
  SELECT s.chrom, seg_idx, cn, seg_end + 1 - seg_start + 1 AS len, CASE WHEN seg_end + 1 <= {t.C_START} THEN 'p' WHEN seg_start >= {t.C_END} THEN 'q' END AS arm, size
  FROM seg s JOIN sized z ON s.chrom = z.chrom),
arm_run AS (
  SELECT *, SUM(len) OVER (PARTITION BY chrom, arm) AS total, SUM(len) OVER (PARTITION BY chrom, arm ORDER BY cn, seg_idx) AS run FROM sided WHERE arm IS NOT NULL),
ccn AS (
  SELECT chrom, arm, CASE WHEN MAX(total) < 0.5 * MAX(CASE WHEN arm = 'p' THEN {t.C_START} ELSE size - {t.C_END} END) THEN CAST(2.0 AS DOUBLE)
         ELSE MIN(CASE WHEN run >= 0.49 * total THEN cn END) END AS ccn
  FROM arm_run GROUP BY chrom, arm)"""

SEEDS = f"""WITH RECURSIVE {ARM},
ok AS (SELECT *, seg_end + 1 AS e FROM seg WHERE cn >= 6 AND (seg_end + 1 <= {t.C_START} OR seg_start >= {t.C_END})),
opened AS (SELECT *, CASE WHEN seg_start - LAG(e) OVER (PARTITION BY chrom ORDER BY seg_idx) <= 300000 THEN 0 ELSE 1 END AS o FROM ok),
runs AS (SELECT *, SUM(o) OVER (PARTITION BY chrom ORDER BY seg_idx) AS run FROM opened),
cut AS (
  SELECT r.chrom, r.run, CASE WHEN SUM(e - seg_start + 1) > 5000001 THEN CAST(1.2 AS DOUBLE) * CAST(6.0 AS DOUBLE) ELSE CAST(6.0 AS DOUBLE) END
    + COALESCE(CASE WHEN MAX(e) <= {t.C_START} THEN COALESCE(MAX(p.ccn), 2.0) - 2.0 WHEN MIN(seg_start) >= {t.C_END} THEN COALESCE(MAX(q.ccn), 2.0) - 2.0 END, 0.0) AS cutoff
  FROM runs r LEFT JOIN ccn p ON r.chrom = p.chrom AND p.arm = 'p' LEFT JOIN ccn q ON r.chrom = q.chrom AND q.arm = 'q' GROUP BY r.chrom, r.run),
kept AS (
  SELECT r.chrom, r.run, seg_start, e, ROW_NUMBER() OVER (PARTITION BY r.chrom, r.run ORDER BY seg_idx) AS n, COUNT(*) OVER (PARTITION BY r.chrom, r.run) AS m
  FROM runs r JOIN cut c ON r.chrom = c.chrom AND r.run = c.run WHERE r.cn >= c.cutoff),
fold(chrom, run, n, m, ls, le, total, ws, we) AS (
  SELECT chrom, run, n, m, seg_start, e, e - seg_start + 1, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM kept WHERE n = 1
  UNION ALL
  SELECT k.chrom, k.run, k.n, k.m,
         CASE WHEN k.seg_start - f.le <= 300000 THEN f.ls WHEN f.total >= 100000 THEN k.seg_start ELSE f.ls END,
         CASE WHEN k.seg_start - f.le <= 300000 OR f.total >= 100000 THEN k.e ELSE f.le END,
         CASE WHEN k.seg_start - f.le <= 300000 THEN f.total + k.e - k.seg_start WHEN f.total >= 100000 THEN 0 ELSE f.total END,
         CASE WHEN k.seg_start - f.le > 300000 AND f.total >= 100000 THEN f.ls END, CASE WHEN k.seg_start - f.le > 300000 AND f.total >= 100000 THEN f.le END
  FROM fold f JOIN kept k ON f.chrom = k.chrom AND f.run = k.run AND k.n = f.n + 1)
SELECT chrom, CAST(ws AS BIGINT) AS "start", CAST(we - 1 AS BIGINT) AS "end" FROM fold WHERE ws IS NOT NULL
UNION ALL SELECT chrom, CAST(ls AS BIGINT), CAST(le - 1 AS BIGINT) FROM fold WHERE n = m AND total >= 100000"""


@query(SEEDS)
def seed_intervals(spark, sf_dir):
    return seeding.seeds(t.seed_input(spark, sf_dir), t.arms(spark, sf_dir))


@query(f"WITH {ARM} SELECT chrom, arm, ccn FROM ccn")
def seed_arm_cn(spark, sf_dir):
    return seeding.arm_copy_number(t.seed_input(spark, sf_dir), t.arms(spark, sf_dir))


@query(f"WITH {t.SEGMENTS} SELECT chrom, seg_idx, ROUND(log2(cn / 2), 6) AS log2_cn, ROUND(2 * pow(2, log2(cn / 2)), 6) AS cn FROM seg")
def cn_absolute(spark, sf_dir):
    log2 = F.log2(F.col("cn") / 2)
    return t.cn_segments(spark, sf_dir).select("chrom", "seg_idx", F.round(log2, 6).alias("log2_cn"), F.round(2 * F.pow(F.lit(2.0), log2), 6).alias("cn"))


RING = t.SEGMENTS + """,
ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY cn, seg_idx * 100 + CAST(replace(chrom, 'chr', '') AS BIGINT)) - 1 AS rk, CAST(FLOOR(COUNT(*) OVER () / 2.4) AS BIGINT) AS im FROM seg),
ringed AS (SELECT *, seg_end - seg_start + 1 AS len, CASE WHEN rk > im THEN rk - im - 1 ELSE im - rk END AS ring FROM ranked),
chosen AS (SELECT * FROM (SELECT *, COALESCE(SUM(len) OVER (ORDER BY ring RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ringed) WHERE before < 10000000)"""


def _ranked_segments(spark, sf_dir):
    s = t.cn_segments(spark, sf_dir)
    at = F.col("seg_idx") * 100 + F.regexp_replace("chrom", "chr", "").cast("long")
    return s.select("chrom", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"), "cn", at.alias("ord"))


def _blocks(spark, sf_dir):
    return t.alignments(spark, sf_dir).select("read_id", "chrom", F.col("r_start").alias("b_start"), F.col("r_end").alias("b_end"))


@query(f"""WITH {RING}, {t.ALIGNMENTS},
cov AS (SELECT SUM(LEAST(r_end, seg_end + 1) - GREATEST(r_start, seg_start)) AS bases FROM chosen c JOIN aln a ON a.chrom = c.chrom AND r_start <= seg_end AND r_end > seg_start)
SELECT COUNT(*) AS n_segments, CAST(SUM(len) AS BIGINT) AS total_length, CAST(COALESCE(MAX(bases), 0) AS BIGINT) AS bases, ROUND(COALESCE(MAX(bases), 0) / SUM(len), 9) AS normal_cov FROM chosen, cov""")
def normal_coverage_ring(spark, sf_dir):
    return coverage.normal_coverage(_ranked_segments(spark, sf_dir), _blocks(spark, sf_dir), 10_000_000).withColumn("normal_cov", F.round("normal_cov", 9))


@query(f"""WITH {t.SEGMENTS} SELECT chrom, CAST(ROW_NUMBER() OVER (ORDER BY CAST(replace(chrom, 'chr', '') AS INT)) AS INT) AS place, COUNT(*) AS segments FROM seg GROUP BY chrom""")
def chrom_natural_order(spark, sf_dir):
    from pyspark.sql import Window

    n = t.cn_segments(spark, sf_dir).groupBy("chrom").agg(F.count("*").alias("segments"))  # a row per chromosome
    return n.select("chrom", F.row_number().over(Window.orderBy(chroms.sort_key(F.col("chrom")))).alias("place"), "segments")
