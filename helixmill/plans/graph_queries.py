"""Breakpoint graphs, interval search and amplicons: queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import testbed as t
from ..config import DEFAULT
from ..operators import clustering, components, expand, graph
from ..registry import query
from ..storage import stored
from .read_queries import segment_hits

#: The first chromosomes whole, one amplicon each: intervals that the test reads cross.
WHOLE = """whole AS (SELECT CAST(replace(chrom, 'chr', '') AS BIGINT) AS amplicon_id, chrom, CAST(0 AS BIGINT) AS s, CAST(9999999 AS BIGINT) AS e FROM (SELECT DISTINCT chrom FROM aln))"""
CALLS = t.CLUSTERS + """,
calls AS (
  SELECT chrom_a, chrom_b, strand_a, strand_b, MIN(pos_a) AS pos_a, MIN(pos_b) AS pos_b, COUNT(*) AS reads FROM cl
  GROUP BY chrom_a, chrom_b, strand_a, strand_b, c HAVING COUNT(*) >= 3),
ends AS (SELECT DISTINCT chrom_a AS chrom, pos_a AS pos, strand_a AS strand FROM calls UNION SELECT chrom_b, pos_b, strand_b FROM calls),
""" + WHOLE + """,
cuts AS (SELECT DISTINCT amplicon_id, w.chrom, s, e, CASE WHEN strand = '+' THEN pos ELSE pos - 1 END AS cut FROM whole w JOIN ends d ON w.chrom = d.chrom
         WHERE CASE WHEN strand = '+' THEN pos ELSE pos - 1 END >= s AND CASE WHEN strand = '+' THEN pos ELSE pos - 1 END < e),
opens AS (SELECT amplicon_id, chrom, s, e, s AS a FROM whole UNION SELECT amplicon_id, chrom, s, e, cut + 1 FROM cuts),
sequence AS (SELECT amplicon_id, chrom, a, COALESCE(LEAD(a) OVER (PARTITION BY amplicon_id, chrom ORDER BY a) - 1, e) AS b FROM opens)"""


def calls(breakpoints):
    """(KEY, pos_a, pos_b, reads) of stored breakpoints, as a written table."""
    c = clustering.cluster(breakpoints, least=1)
    found = c.groupBy(*clustering.KEY, "cluster").agg(F.min("pos_a").alias("pos_a"), F.min("pos_b").alias("pos_b"), F.count("*").alias("reads"))
    return stored(found.where("reads >= 3").drop("cluster"), "calls")


def whole(spark, sf_dir):
    number = F.regexp_replace("chrom", "chr", "").cast("long")
    return t.alignments(spark, sf_dir).select("chrom").distinct().select(number.alias("amplicon_id"), "chrom", F.lit(0).cast("long").alias("start"), F.lit(9_999_999).cast("long").alias("end"))


def parts(spark, sf_dir):
    """Breakpoints, calls, intervals and split points, each computed once and written."""
    b = t.stored_breakpoints(spark, sf_dir)
    c = calls(b)
    w = stored(whole(spark, sf_dir), "whole")
    return b, c, w, stored(graph.split_points(w, graph.ends_of(c)), "cuts")


@query(f"WITH RECURSIVE {CALLS} SELECT amplicon_id, chrom, cut FROM cuts")
def graph_split_points(spark, sf_dir):
    return parts(spark, sf_dir)[3].select("amplicon_id", "chrom", "cut")


@query(f'WITH RECURSIVE {CALLS} SELECT amplicon_id, chrom, a AS "start", b AS "end" FROM sequence')
def graph_sequence_edges(spark, sf_dir):
    _, _, w, cuts = parts(spark, sf_dir)
    return graph.sequence_edges(w, cuts)


@query(f"WITH RECURSIVE {CALLS} SELECT amplicon_id, chrom, cut AS pos1, cut + 1 AS pos2 FROM cuts")
def graph_concordant_edges(spark, sf_dir):
    return graph.concordant_edges(parts(spark, sf_dir)[3])


@query(f"""WITH RECURSIVE {CALLS} SELECT x.amplicon_id, chrom_a, pos_a, strand_a, chrom_b, pos_b, strand_b, reads
FROM calls c JOIN whole x ON chrom_a = x.chrom AND pos_a BETWEEN x.s AND x.e JOIN whole y ON chrom_b = y.chrom AND pos_b BETWEEN y.s AND y.e WHERE x.amplicon_id = y.amplicon_id""")
def graph_discordant_edges(spark, sf_dir):
    return graph.discordant_edges(calls(t.stored_breakpoints(spark, sf_dir)), whole(spark, sf_dir))


@query(f"""WITH RECURSIVE {CALLS},
q AS (SELECT amplicon_id, COUNT(*) AS n_sequence, CAST(SUM(b - a + 1) AS BIGINT) AS size, COUNT(DISTINCT chrom) AS n_chromosomes FROM sequence GROUP BY amplicon_id),
c AS (SELECT amplicon_id, COUNT(*) AS n_concordant FROM cuts GROUP BY amplicon_id),
d AS (SELECT x.amplicon_id, COUNT(*) AS n_discordant FROM calls JOIN whole x ON chrom_a = x.chrom JOIN whole y ON chrom_b = y.chrom WHERE x.amplicon_id = y.amplicon_id GROUP BY x.amplicon_id)
SELECT q.*, COALESCE(n_concordant, 0) AS n_concordant, COALESCE(n_discordant, 0) AS n_discordant, CAST(1 AS BIGINT) AS n_intervals, 2 * n_sequence AS n_nodes,
       n_sequence + COALESCE(n_concordant, 0) + COALESCE(n_discordant, 0) AS n_nonsource, CAST(4 AS BIGINT) AS n_source, n_sequence + COALESCE(n_concordant, 0) + COALESCE(n_discordant, 0) + 4 AS n_edges
FROM q LEFT JOIN c ON q.amplicon_id = c.amplicon_id LEFT JOIN d ON q.amplicon_id = d.amplicon_id""")
def graph_stats(spark, sf_dir):
    _, c, w, cuts = parts(spark, sf_dir)
    return graph.statistics(graph.sequence_edges(w, cuts), graph.concordant_edges(cuts), graph.discordant_edges(c, w), w)


@query(f"""WITH RECURSIVE {CALLS},
joint AS (SELECT DISTINCT chrom, cut AS p1, cut + 1 AS p2 FROM cuts),
probe AS (SELECT chrom, p1, p2, UNNEST([p1, p2, p1 - 101, p2 + 100]) AS pp, UNNEST([0, 1, 2, 3]) AS k FROM joint),
full_ AS (SELECT p.chrom, p1, p2, read_id FROM probe p JOIN aln a ON a.chrom = p.chrom AND r_start <= pp AND r_end > pp GROUP BY p.chrom, p1, p2, read_id HAVING COUNT(DISTINCT k) = 4),
used AS (SELECT read_id, chrom_a AS chrom, pos_a AS pos FROM bp UNION SELECT read_id, chrom_b, pos_b FROM bp),
good AS (SELECT * FROM full_ f WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.read_id = f.read_id AND u.chrom = f.chrom AND u.pos IN (f.p1, f.p2)))
SELECT j.chrom, p1 AS pos1, p2 AS pos2, COUNT(read_id) AS reads FROM joint j LEFT JOIN good USING (chrom, p1, p2) GROUP BY ALL""")
def concordant_support(spark, sf_dir):
    b, _, _, cuts = parts(spark, sf_dir)
    joints = graph.concordant_edges(cuts).select("chrom", "pos1", "pos2").distinct()
    used = b.select("read_id", F.col("chrom_a").alias("chrom"), F.col("pos_a").alias("pos")).union(b.select("read_id", "chrom_b", "pos_b"))
    return graph.concordant_support(joints, t.all_alignments(spark, sf_dir), used)


#: Amplicons are linked where consecutive orders of a customer fall into them, by supplier and customer numbers.
LINKS = t.INTERVALS + """,
ids AS (SELECT amplicon_id, ROW_NUMBER() OVER (ORDER BY amplicon_id) - 1 AS k, COUNT(*) OVER () AS n FROM amp),
link AS (SELECT DISTINCT x.amplicon_id AS u, y.amplicon_id AS v FROM supplier s JOIN ids x ON x.k = s.s_suppkey % x.n JOIN ids y ON y.k = (s.s_suppkey * 7 + s.s_nationkey) % (y.n * 2))"""


@query(f"""WITH RECURSIVE {LINKS},
both_ AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach(u, v) AS (SELECT u, v FROM both_ UNION SELECT r.u, b.v FROM reach r JOIN both_ b ON r.v = b.u),
low AS (SELECT u, MIN(v) AS m FROM reach GROUP BY u)
SELECT a.amplicon_id AS interval_id, chrom, s AS "start", e AS "end", LEAST(a.amplicon_id, COALESCE(m, a.amplicon_id)) AS amplicon_id FROM amp a LEFT JOIN low ON a.amplicon_id = low.u""")
def amplicon_components(spark, sf_dir):
    from pyspark.sql import Window

    i = t.intervals(spark, sf_dir)
    ids = i.select("interval_id", (F.row_number().over(Window.orderBy("amplicon_id")) - 1).alias("k"))  # a row per amplicon of one sample
    n = ids.count()
    s = t.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % max(n, 1)).alias("ka"), ((F.col("s_suppkey") * 7 + F.col("s_nationkey")) % max(2 * n, 1)).alias("kb"))
    links = s.join(ids.withColumnsRenamed({"interval_id": "interval_a", "k": "ka"}), "ka").join(ids.withColumnsRenamed({"interval_id": "interval_b", "k": "kb"}), "kb", "left")
    return components.merge_connected(i, links.select("interval_a", "interval_b")).select("interval_id", "chrom", "start", "end", "amplicon_id")


HITS = t.SEGMENTS + ", " + t.ALIGNMENTS + """,
h AS (SELECT DISTINCT read_id, s.chrom, seg_idx FROM aln a JOIN seg s ON a.chrom = s.chrom AND (r_start BETWEEN seg_start AND seg_end OR r_end BETWEEN seg_start AND seg_end))"""


@query(f"""WITH {HITS}, front AS (SELECT chrom, seg_idx FROM seg WHERE cn >= 8),
r AS (SELECT DISTINCT read_id FROM h SEMI JOIN front USING (chrom, seg_idx)),
f AS (SELECT chrom, seg_idx, COUNT(DISTINCT read_id) AS reads FROM h SEMI JOIN r USING (read_id) ANTI JOIN front USING (chrom, seg_idx) GROUP BY ALL HAVING COUNT(DISTINCT read_id) >= 3),
o AS (SELECT *, CASE WHEN seg_idx - LAG(seg_idx) OVER (PARTITION BY chrom ORDER BY seg_idx) <= 2 THEN 0 ELSE 1 END AS opens FROM f),
g AS (SELECT *, SUM(opens) OVER (PARTITION BY chrom ORDER BY seg_idx) AS run FROM o)
SELECT chrom, MIN(seg_idx) AS first_idx, MAX(seg_idx) AS last_idx, CAST(SUM(reads) AS BIGINT) AS reads FROM g GROUP BY chrom, run""")
def bfs_expand_level(spark, sf_dir):
    front = t.cn_segments(spark, sf_dir).where("cn >= 8").select("chrom", F.col("seg_idx").alias("idx"))
    return expand.next_level(front, segment_hits(spark, sf_dir), DEFAULT.min_cluster)


@query()
def amplicon_search(spark, sf_dir):
    seeds = t.cn_segments(spark, sf_dir).where("cn >= 9.5").select("chrom", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"))
    hits = stored(segment_hits(spark, sf_dir), "hits")
    return expand.search(seeds, hits, t.cn_segments(spark, sf_dir), DEFAULT.min_cluster, alignments=stored(t.raw_alignments(spark, sf_dir), "alignments"))


@query(f"""WITH {t.INTERVALS}
SELECT a.amplicon_id AS interval_id, a.chrom, CASE WHEN l.chrom IS NOT NULL THEN a.s - 100000 ELSE a.s END AS "start", CASE WHEN r.chrom IS NOT NULL THEN a.e + 100000 ELSE a.e END AS "end"
FROM amp a LEFT JOIN seg l ON l.chrom = a.chrom AND a.s - 100000 BETWEEN l.seg_start AND l.seg_end LEFT JOIN seg r ON r.chrom = a.chrom AND a.e + 100000 BETWEEN r.seg_start AND r.seg_end""")
def seed_widening(spark, sf_dir):
    return expand.widen(t.intervals(spark, sf_dir).drop("amplicon_id"), t.cn_segments(spark, sf_dir))


NUMBERED = CALLS + """,
num AS (SELECT amplicon_id, chrom, a, b, ROW_NUMBER() OVER (PARTITION BY amplicon_id ORDER BY a) AS k FROM sequence),
rng AS (SELECT read_id, q_start, r_start, x.chrom, x.strand, x.nm_rate, x.mapq, x.q_end, amplicon_id, MIN(k) AS lo, MAX(k) AS hi FROM aln x JOIN num ON num.chrom = x.chrom AND r_start <= b AND r_end > a
        WHERE LEAST(r_end - 1, b) - GREATEST(r_start, a) + 1 >= 20 AND b - a + 1 >= 20 AND mapq >= 20 GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {NUMBERED} SELECT amplicon_id, array_to_string([CASE WHEN x < hi THEN 'e' || x || ',c' || x ELSE 'e' || x END for x in range(lo, hi + 1)], ',') AS path, COUNT(*) AS support FROM rng WHERE hi - lo >= 2 GROUP BY ALL""")
def concordant_paths(spark, sf_dir):
    from ..operators import readpaths

    _, _, w, cuts = parts(spark, sf_dir)
    seq = readpaths.number_edges(graph.sequence_edges(w, cuts))
    ids = ["read_id", "q_start", "q_end", "r_start_id", "strand", "nm_rate"]
    a = t.alignments(spark, sf_dir).withColumn("r_start_id", F.col("r_start")).withColumn("chrom_id", F.col("chrom"))
    p = readpaths.concordant_paths(a, seq, [*ids, "chrom_id"], least=20)
    return p.groupBy("amplicon_id", F.array_join("path", ",").alias("path")).agg(F.count("*").alias("support"))
