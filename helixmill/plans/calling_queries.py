"""Calling of breakpoints, refinement of intervals and integration sites: queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import testbed as t
from ..operators import calling, clustering, expand, hsr, reads
from ..registry import query
from ..storage import stored
from .graph_queries import CALLS, calls

POINT = ["read_id", "gap", "chrom_a", "pos_a", "strand_a", "chrom_b", "pos_b", "strand_b"]
DIFFER = "ABS(ABS(rs{k} - re) - g{k}) > GREATEST(100.0, ABS(g{k} * 0.2))"
HOME = t.INTERVALS + ", " + t.RAW + """,
home AS (SELECT o.*, (SELECT MIN(amplicon_id) FROM amp WHERE amp.chrom = o.chrom AND o.rs <= amp.e AND o.re >= amp.s) AS mark FROM ord o),"""
WITHIN = HOME + t.pairs_sql("home", f"g1 + 100 >= 0 AND mark = k1 AND (strand <> d1 OR {DIFFER.format(k=1)})", f"mark = k2 AND (strand = d2 OR {DIFFER.format(k=2)})")


def _counted(pairs):
    return reads.orient(pairs).groupBy(*POINT).agg(F.count("*").alias("n"))


@query(f"WITH {WITHIN} SELECT {', '.join(POINT)}, COUNT(*) AS n FROM bp GROUP BY ALL")
def calls_within(spark, sf_dir):
    """Candidate breakpoints inside the amplified intervals."""
    own = t.intervals(spark, sf_dir).select(F.col("interval_id").alias("idx"), "chrom", "start", "end")
    return _counted(calling.pairs_within(t.raw_alignments(spark, sf_dir), own))


LINKED = t.RAW + """,
link AS (SELECT 1 AS link_id, 'chr1' AS cn, 2000000 AS sn, 4999999 AS en, 'chr2' AS co, 0 AS so, 6999999 AS eo UNION ALL SELECT 2, 'chr3', 1000000, 2005000, 'chr3', 4000000, 8003000),
met AS (SELECT o.read_id, o.i, link_id, o.chrom = cn AND o.rs <= en AND o.re >= sn AS n, o.chrom = co AND o.rs <= eo AND o.re >= so AS o FROM ord o, link),
nx AS (SELECT *, LEAD(chrom) OVER w AS c1, LEAD(rs) OVER w AS rs1, LEAD(strand) OVER w AS d1, LEAD(mapq) OVER w AS m1, LEAD(q_start) OVER w - q_end AS g1,
              LEAD(chrom, 2) OVER w AS c2, LEAD(rs, 2) OVER w AS rs2, LEAD(strand, 2) OVER w AS d2, LEAD(mapq, 2) OVER w AS m2, LEAD(q_start, 2) OVER w - q_end AS g2 FROM ord WINDOW w AS (PARTITION BY read_id ORDER BY i)),
one AS (SELECT nx.*, x.link_id FROM nx JOIN met x ON x.read_id = nx.read_id AND x.i = nx.i JOIN met y ON y.read_id = nx.read_id AND y.i = nx.i + 1 AND y.link_id = x.link_id
        WHERE (x.n AND y.o OR x.o AND y.n) AND g1 + 100 >= 0 AND mapq >= 20 AND m1 >= 20),
span AS (SELECT nx.*, x.link_id FROM nx JOIN met x ON x.read_id = nx.read_id AND x.i = nx.i JOIN met y ON y.read_id = nx.read_id AND y.i = nx.i + 2 AND y.link_id = x.link_id
         WHERE (x.n AND y.o OR x.o AND y.n) AND m1 < 10 AND mapq >= 20 AND m2 >= 20
           AND NOT EXISTS (SELECT 1 FROM one WHERE one.read_id = nx.read_id AND one.link_id = x.link_id AND one.i IN (nx.i, nx.i + 1)))
SELECT link_id, read_id, re AS pos1, rs1 AS pos2, CAST(g1 AS BIGINT) AS gap, COUNT(*) AS n FROM one GROUP BY ALL UNION ALL SELECT link_id, read_id, re, rs2, CAST(g2 AS BIGINT), COUNT(*) FROM span GROUP BY ALL"""


@query(f"WITH {LINKED}")
def calls_between(spark, sf_dir):
    """Candidate breakpoints between two pairs of intervals."""
    links = spark.createDataFrame([(1, "chr1", 2_000_000, 4_999_999, "chr2", 0, 6_999_999), (2, "chr3", 1_000_000, 2_005_000, "chr3", 4_000_000, 8_003_000)], "link_id int, chrom_n string, start_n long, end_n long, chrom_o string, start_o long, end_o long")
    p = calling.pairs_between(t.raw_alignments(spark, sf_dir), links)
    return p.groupBy("link_id", "read_id", F.col("r_end1").alias("pos1"), F.col("r_start2").alias("pos2"), "gap").agg(F.count("*").alias("n"))


DELETED = t.INTERVALS + """,
rec AS (SELECT DISTINCT l_orderkey AS read_id, 'chr' || CAST(1 + l_partkey % 3 AS VARCHAR) AS chrom, (l_suppkey % 10) * 1000000 + CAST(l_quantity AS BIGINT) * 10 AS pos,
               CAST(l_quantity AS BIGINT) AS q, l_linenumber * 200 AS del, CAST(ROUND(l_discount * 600) AS INT) AS mapq FROM lineitem)"""


@query(f"""WITH {DELETED} SELECT read_id, rec.chrom AS chrom_a, pos + q * 20 + del AS pos_a, pos + q * 20 AS pos_b, COUNT(*) AS n FROM rec JOIN amp ON amp.chrom = rec.chrom AND pos <= amp.e AND pos + q * 30 + del - 1 >= amp.s
WHERE del > 600 AND mapq >= 20 GROUP BY ALL""")
def small_deletions(spark, sf_dir):
    q, s = F.col("l_quantity").cast("long"), lambda c: c.cast("string")
    line = t.table(spark, sf_dir, "lineitem")
    cigar = F.concat(s(q * 20), F.lit("M"), s(F.col("l_linenumber") * 200), F.lit("D"), s(q * 10), F.lit("M"))
    rows = line.select(F.col("l_orderkey").alias("read_id"), F.concat(F.lit("chr"), s(1 + F.col("l_partkey") % 3)).alias("chrom"), ((F.col("l_suppkey") % 10) * 1_000_000 + q * 10).alias("pos"), cigar.alias("cigar"), F.round(F.col("l_discount") * 600).cast("int").alias("mapq")).distinct()
    found = calling.small_deletions(rows, t.intervals(spark, sf_dir).select("chrom", "start", "end"))
    return found.groupBy("read_id", "chrom_a", "pos_a", "pos_b").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {t.EXACT}, {t.INTERVALS},
allc AS (SELECT chrom_a, chrom_b, strand_a, strand_b, cl, call, at_a AS pos_a, at_b AS pos_b, support, support < 3 AS few FROM round_ WHERE call >= 0 AND support > 0),
placed AS (SELECT *, (SELECT MIN(amplicon_id) FROM amp WHERE amp.chrom = chrom_a AND pos_a BETWEEN s AND e) AS amp_a, (SELECT MIN(amplicon_id) FROM amp WHERE amp.chrom = chrom_b AND pos_b BETWEEN s AND e) AS amp_b FROM allc),
flow AS (SELECT *, COALESCE(MAX(CAST(few OR (amp_a IS NOT NULL AND amp_b IS NOT NULL) AS INT)) OVER (PARTITION BY chrom_a, chrom_b, strand_a, strand_b, cl ORDER BY call ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM placed)
SELECT chrom_a, chrom_b, strand_a, strand_b, pos_a, pos_b, support, amp_a, amp_b FROM flow WHERE NOT few AND amp_a IS NOT NULL AND amp_b IS NOT NULL AND ended = 0""")
def calls_accepted(spark, sf_dir):
    """The calls that become edges of the amplicons' graphs."""
    found = clustering.call_breakpoints(clustering.cluster(t.stored_breakpoints(spark, sf_dir)), all_calls=True)
    own = t.intervals(spark, sf_dir).select("amplicon_id", "chrom", "start", "end")
    return calling.accepted_calls(stored(found, "calls"), own, 3).drop("cluster", "call")


@query(f"""WITH RECURSIVE {CALLS}, {t.SEGMENTS},
both_ AS (SELECT strand_a AS grp, chrom_a AS chrom, pos_a AS pos FROM calls UNION ALL SELECT strand_a, chrom_b, pos_b FROM calls),
hit AS (SELECT grp, b.chrom, pos, seg_idx, seg_start, seg_end, cn FROM both_ b JOIN seg ON seg.chrom = b.chrom AND pos BETWEEN seg_start AND seg_end),
lagged AS (SELECT *, LAG(chrom) OVER w AS pc, LAG(seg_idx) OVER w AS pi, LAG(seg_end) OVER w AS pe, LAG(pos) OVER w AS pp, LAG(cn) OVER w AS pn FROM hit WINDOW w AS (PARTITION BY grp ORDER BY chrom, seg_idx, pos)),
opened AS (SELECT *, CASE WHEN pc IS NULL OR chrom <> pc OR seg_idx - pi > 2 OR seg_start - pe > 1000000 OR pos - pp > 2000000 OR (cn < 5 AND pn < 5 AND (seg_start - pe > 200000 OR pos - pp > 300000)) THEN 1 ELSE 0 END AS o FROM lagged),
numbered AS (SELECT *, SUM(o) OVER (PARTITION BY grp ORDER BY chrom, seg_idx, pos ROWS UNBOUNDED PRECEDING) AS run FROM opened),
ends2 AS (SELECT grp, chrom, run, MIN((seg_idx, pos, seg_start, cn)) AS l, MAX((seg_idx, pos, seg_end, cn)) AS r FROM numbered GROUP BY grp, chrom, run),
flat AS (SELECT grp, ends2.chrom, l[2] AS lp, l[3] AS ls, l[4] AS lc, r[2] AS rp, r[3] AS re, r[4] AS rc, low, high FROM ends2 JOIN (SELECT chrom, MIN(seg_start) AS low, MAX(seg_end) AS high FROM seg GROUP BY chrom) z ON z.chrom = ends2.chrom),
wide AS (SELECT *, GREATEST(CASE WHEN lc >= 5 THEN ls ELSE lp END - 100000, low) AS l0, LEAST(CASE WHEN rc >= 5 THEN re ELSE rp END + 100000, high, rp + 1000000) AS r0 FROM flat),
kept2 AS (SELECT *, CASE WHEN lc <> 0 AND lp - 1000000 > l0 THEN lp - 1000000 ELSE l0 END AS l1 FROM wide)
SELECT grp, k.chrom, CAST(CASE WHEN EXISTS (SELECT 1 FROM seg WHERE seg.chrom = k.chrom AND l1 BETWEEN seg_start AND seg_end) THEN l1 ELSE ls END AS BIGINT) AS "start",
       CAST(CASE WHEN EXISTS (SELECT 1 FROM seg WHERE seg.chrom = k.chrom AND r0 BETWEEN seg_start AND seg_end) THEN r0 ELSE re END AS BIGINT) AS "end" FROM kept2 k""")
def interval_refinement(spark, sf_dir):
    """Intervals around the ends of calls, the calls of each strand of node a apart."""
    c = calls(t.stored_breakpoints(spark, sf_dir))
    ends = c.select(F.col("strand_a").alias("grp"), F.inline(F.array(*[F.struct(F.col(f"chrom_{s}").alias("chrom"), F.col(f"pos_{s}").alias("pos")) for s in "ab"])))
    return expand.refined(ends, t.cn_segments(spark, sf_dir), ["grp"])


HSR_COVERAGE = 12.0
INTO = t.RAW + """,
ec AS (SELECT 'chr1' AS chrom, 2000000 AS s, 4999999 AS e),
home AS (SELECT o.*, EXISTS (SELECT 1 FROM ec WHERE ec.chrom = o.chrom AND o.rs <= ec.e AND o.re >= ec.s) AS mark FROM ord o),""" + t.pairs_sql("home", "mark <> k1", "mark <> k2")


@query(f"""WITH RECURSIVE {INTO}, {t.clusters_sql(6)}, {t.exact_sql(6)}, {t.merged_sql(101, 100)}, {t.SEGMENTS},
x AS (SELECT *, EXISTS (SELECT 1 FROM ec WHERE ec.chrom = chrom_a AND pos_a BETWEEN ec.s - 100 AND ec.e + 100) AS in_a, EXISTS (SELECT 1 FROM ec WHERE ec.chrom = chrom_b AND pos_b BETWEEN ec.s - 100 AND ec.e + 100) AS in_b FROM merged),
o AS (SELECT *, CASE WHEN in_a THEN chrom_b ELSE chrom_a END AS chrom, CASE WHEN in_a THEN pos_b ELSE pos_a END AS pos FROM x WHERE in_a <> in_b AND support <= 30)
SELECT o.chrom, o.pos, support, chrom_a, chrom_b, strand_a, strand_b, pos_a, pos_b FROM o WHERE COALESCE((SELECT MAX(cn) FROM seg WHERE seg.chrom = o.chrom AND o.pos > seg_start AND o.pos < seg_end), 0) <= 5""")
def hsr_sites(spark, sf_dir):
    ec = spark.createDataFrame([("chr1", 2_000_000, 4_999_999)], "chrom string, start long, end long")
    return hsr.sites(t.raw_alignments(spark, sf_dir), ec, t.cn_segments(spark, sf_dir), HSR_COVERAGE)
