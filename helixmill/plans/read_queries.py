"""Reads, pairs, breakpoints and clusters: queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import testbed as t
from ..functions import cigar
from ..operators import clustering, reads
from ..registry import query

CIGAR = """cig AS (
  SELECT DISTINCT CAST(l_linenumber * 10 AS VARCHAR) || 'S' || CAST(CAST(l_quantity AS BIGINT) * 90 AS VARCHAR) || 'M' || CAST(l_suppkey % 10 + 1 AS VARCHAR) || 'I'
         || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'M' || CAST(l_partkey % 7 + 1 AS VARCHAR) || 'D' || CAST(l_linenumber * 3 AS VARCHAR) || 'S' AS cigar,
         CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand, l_linenumber AS ln, CAST(l_quantity AS BIGINT) AS q, l_suppkey % 10 + 1 AS i, l_partkey % 7 + 1 AS d
  FROM lineitem)"""


@query(f"""WITH {CIGAR}
SELECT cigar, strand, CAST(CASE WHEN strand = '+' THEN ln * 10 ELSE ln * 3 END AS BIGINT) AS q_start,
       CAST(CASE WHEN strand = '+' THEN ln * 10 ELSE ln * 3 END + q * 91 + i AS BIGINT) AS q_end, CAST(q * 91 + d AS BIGINT) AS ref_len FROM cig""")
def cigar_query_ends(spark, sf_dir):
    q, s = F.col("l_quantity").cast("long"), lambda c: F.col(c).cast("string")
    text = F.concat(s("a"), F.lit("S"), s("m"), F.lit("M"), s("i"), F.lit("I"), s("n"), F.lit("M"), s("d"), F.lit("D"), s("z"), F.lit("S"))
    rows = t.table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") * 10).alias("a"), (q * 90).alias("m"), (F.col("l_suppkey") % 10 + 1).alias("i"), q.alias("n"), (F.col("l_partkey") % 7 + 1).alias("d"), (F.col("l_linenumber") * 3).alias("z"),
        F.when(F.col("l_linestatus") == "F", "+").otherwise("-").alias("strand"),
    )
    one = rows.select(text.alias("cigar"), "strand").distinct()
    return one.withColumn("b", cigar.query_bounds(F.col("cigar"), F.col("strand"))).select("cigar", "strand", "b.q_start", "b.q_end", "b.ref_len")


@query(f"WITH {t.PAIRS} SELECT read_id, chrom1, e1 AS pos1, strand1, chrom2, s2 AS pos2, strand2, CAST(gap AS BIGINT) AS gap, COUNT(*) AS n FROM pairs GROUP BY ALL")
def read_adjacent_pairs(spark, sf_dir):
    p = reads.adjacent_pairs(t.alignments(spark, sf_dir))
    return p.groupBy("read_id", "chrom1", F.col("r_end1").alias("pos1"), "strand1", "chrom2", F.col("r_start2").alias("pos2"), "strand2", "gap").agg(F.count("*").alias("n"))


@query(f"""WITH {t.ALIGNMENTS},
l AS (SELECT *, LEAD(mapq) OVER w AS m2, LEAD(q_start) OVER w AS s2, LEAD(mapq, 2) OVER w AS m3, LEAD(q_start, 2) OVER w AS s3, LEAD(q_end) OVER w AS e2,
             LEAD(chrom, 2) OVER w AS chrom3, LEAD(r_start, 2) OVER w AS r3
      FROM aln WINDOW w AS (PARTITION BY read_id ORDER BY q_start, q_end, chrom, r_start, strand, mapq, nm_rate))
SELECT read_id, chrom AS chrom1, r_end AS pos1, chrom3 AS chrom2, r3 AS pos2, CAST(s3 - q_end AS BIGINT) AS gap, COUNT(*) AS n FROM l
WHERE chrom3 IS NOT NULL AND m2 < 10 AND mapq >= 20 AND m3 >= 20 AND NOT (s2 - q_end + 100 >= 0 AND mapq >= 20 AND m2 >= 20) AND NOT (s3 - e2 + 100 >= 0 AND m2 >= 20 AND m3 >= 20)
GROUP BY ALL""")
def read_gap_pairs(spark, sf_dir):
    p = reads.spanning_pairs(t.alignments(spark, sf_dir))
    return p.groupBy("read_id", "chrom1", F.col("r_end1").alias("pos1"), "chrom2", F.col("r_start2").alias("pos2"), "gap").agg(F.count("*").alias("n"))


@query(f"WITH {t.BREAKPOINTS} SELECT read_id, chrom_a, pos_a, strand_a, chrom_b, pos_b, strand_b, rev AS \"reversed\", COUNT(*) AS n FROM bp GROUP BY ALL")
def breakpoint_orient(spark, sf_dir):
    return t.breakpoints(spark, sf_dir).groupBy("read_id", "chrom_a", "pos_a", "strand_a", "chrom_b", "pos_b", "strand_b", "reversed").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {t.CLUSTERS} SELECT chrom_a, chrom_b, strand_a, strand_b, COUNT(*) AS n, MIN(pos_a) AS min_a, MAX(pos_a) AS max_a, MIN(pos_b) AS min_b, MAX(pos_b) AS max_b
FROM cl GROUP BY chrom_a, chrom_b, strand_a, strand_b, cl""")
def breakpoint_clusters(spark, sf_dir):
    return clustering.summarise(clustering.cluster(t.stored_breakpoints(spark, sf_dir))).drop("cluster")


@query(f"""WITH RECURSIVE {t.CLUSTERS} SELECT chrom_a, chrom_b, strand_a, strand_b, COUNT(*) AS n, MIN(pos_a) AS min_a, MAX(pos_a) AS max_a, MIN(pos_b) AS min_b, MAX(pos_b) AS max_b
FROM cl GROUP BY chrom_a, chrom_b, strand_a, strand_b, cl HAVING COUNT(*) >= 3""")
def breakpoint_support(spark, sf_dir):
    return clustering.summarise(clustering.cluster(t.stored_breakpoints(spark, sf_dir)), clustering.min_cluster_size(2.5)).drop("cluster")


@query(f"""WITH RECURSIVE {t.CLUSTERS},
grp AS (SELECT *, AVG(pos_a) OVER g AS ma, AVG(pos_b) OVER g AS mb, GREATEST(STDDEV_POP(pos_a) OVER g, 2000 / 2.99) AS wa, GREATEST(STDDEV_POP(pos_b) OVER g, 2000 / 2.99) AS wb
        FROM cl WINDOW g AS (PARTITION BY chrom_a, chrom_b, strand_a, strand_b, cl)),
fit AS (SELECT * FROM grp WHERE pos_a BETWEEN ma - 3 * wa AND ma + 3 * wa AND pos_b BETWEEN mb - 3 * wb AND mb + 3 * wb),
ct AS (SELECT chrom_a, chrom_b, strand_a, strand_b, cl, 'a' AS side, pos_a AS pos, COUNT(*) AS c FROM fit GROUP BY ALL
       UNION ALL SELECT chrom_a, chrom_b, strand_a, strand_b, cl, 'b', pos_b, COUNT(*) FROM fit GROUP BY ALL),
mode AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chrom_a, chrom_b, strand_a, strand_b, cl, side ORDER BY c DESC, pos) AS r, LEAD(c) OVER (PARTITION BY chrom_a, chrom_b, strand_a, strand_b, cl, side ORDER BY c DESC, pos) AS c2 FROM ct),
med AS (SELECT chrom_a, chrom_b, strand_a, strand_b, cl, MEDIAN(pos_a) AS da, MEDIAN(pos_b) AS db, COUNT(*) AS n FROM fit GROUP BY ALL)
SELECT m.chrom_a, m.chrom_b, m.strand_a, m.strand_b,
       CAST(CASE WHEN x.c > COALESCE(x.c2, 0) THEN x.pos WHEN m.strand_a = '+' THEN CEIL(da) ELSE FLOOR(da) END AS BIGINT) AS pos_a,
       CAST(CASE WHEN y.c > COALESCE(y.c2, 0) THEN y.pos WHEN m.strand_b = '+' THEN CEIL(db) ELSE FLOOR(db) END AS BIGINT) AS pos_b, m.n AS n_inside
FROM med m
JOIN mode x ON x.side = 'a' AND x.r = 1 AND (x.chrom_a, x.chrom_b, x.strand_a, x.strand_b, x.cl) = (m.chrom_a, m.chrom_b, m.strand_a, m.strand_b, m.cl)
JOIN mode y ON y.side = 'b' AND y.r = 1 AND (y.chrom_a, y.chrom_b, y.strand_a, y.strand_b, y.cl) = (m.chrom_a, m.chrom_b, m.strand_a, m.strand_b, m.cl)""")
def breakpoint_centres(spark, sf_dir):
    """The centre of each cluster, all in DataFrame operations."""
    from ..storage import stored

    clusters = stored(clustering.cluster(t.stored_breakpoints(spark, sf_dir)), "clusters")
    return clustering.centres(clusters, 2000).drop("cluster")


@query(f"WITH RECURSIVE {t.EXACT} SELECT chrom_a, chrom_b, strand_a, strand_b, call, pos_a, pos_b, support FROM exact")
def breakpoint_exact_call(spark, sf_dir):
    return clustering.call_breakpoints(clustering.cluster(t.stored_breakpoints(spark, sf_dir))).drop("cluster")


@query(f"""WITH RECURSIVE {t.EXACT}, {t.merged_sql(200, 200)} SELECT chrom_a, chrom_b, strand_a, strand_b, pos_a, pos_b, support FROM merged""")
def breakpoint_merge(spark, sf_dir):
    from ..storage import stored

    calls = clustering.call_breakpoints(clustering.cluster(t.stored_breakpoints(spark, sf_dir)))
    return clustering.merge_calls(stored(calls, "calls"))


@query(f"""WITH {t.SEGMENTS}, {t.ALIGNMENTS},
h AS (SELECT DISTINCT read_id, s.chrom, seg_idx FROM aln a JOIN seg s ON a.chrom = s.chrom AND (r_start BETWEEN seg_start AND seg_end OR r_end BETWEEN seg_start AND seg_end))
SELECT x.chrom AS chrom1, x.seg_idx AS idx1, y.chrom AS chrom2, y.seg_idx AS idx2, COUNT(*) AS reads
FROM h x JOIN h y ON x.read_id = y.read_id AND (x.chrom, x.seg_idx) < (y.chrom, y.seg_idx) GROUP BY ALL HAVING COUNT(*) >= 3""")
def shared_read_segments(spark, sf_dir):
    return reads.shared_reads(segment_hits(spark, sf_dir), 3)


def segment_hits(spark, sf_dir):
    h = reads.segment_hits(t.alignments(spark, sf_dir), t.cn_segments(spark, sf_dir))
    return h.select("read_id", "chrom", F.explode(F.array("idx_start", "idx_end")).alias("idx")).where("idx is not null").distinct()


@query(f"WITH {t.ALIGNMENTS} SELECT chrom, strand, COUNT(*) AS n, ROUND(AVG(nm_rate), 9) AS mean, ROUND(STDDEV_POP(nm_rate), 9) AS std FROM aln GROUP BY chrom, strand")
def edit_distance_stats(spark, sf_dir):
    e = reads.edit_distance(t.alignments(spark, sf_dir), ["chrom", "strand"])
    return e.withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 9))


@query(f"WITH {t.ALIGNMENTS}, r AS (SELECT chrom, q_end - q_start AS len FROM aln) SELECT chrom, ROUND(quantile_cont(len, 0.25), 6) AS q25, ROUND(quantile_cont(len, 0.5), 6) AS q50, ROUND(quantile_cont(len, 0.75), 6) AS q75 FROM r GROUP BY chrom")
def qc_quantiles(spark, sf_dir):
    from ..sources.reads import quantiles

    r = t.alignments(spark, sf_dir).select("chrom", (F.col("q_end") - F.col("q_start")).alias("len"))
    return quantiles(r, "len", ["chrom"])
