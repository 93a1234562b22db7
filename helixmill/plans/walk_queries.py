"""Walks, path constraints and the kernels that run one amplicon a task: queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import testbed as t
from ..operators import cycles, paths
from ..registry import query

#: A read's path: a sequence edge for each of its bins, joined by concordant edges.
PATHS = t.ALIGNMENTS + """,
stop AS (SELECT read_id, ROW_NUMBER() OVER (PARTITION BY read_id ORDER BY q_start, q_end, chrom, r_start, strand, mapq, nm_rate) AS k, 'e' || CAST(FLOOR(r_start / 1000000.0) AS BIGINT) AS edge FROM aln),
path AS (SELECT read_id, string_agg(edge, ',c0,' ORDER BY k) AS p, string_agg(edge, ',c0,' ORDER BY k DESC) AS q FROM stop GROUP BY read_id),
sup AS (SELECT LEAST(string_split(p, ','), string_split(q, ',')) AS pa, COUNT(*) AS support FROM path GROUP BY 1)"""


def read_paths(spark, sf_dir):
    w = t.walks(spark, sf_dir).select(F.col("cycle_id").alias("read_id"), "ord", F.concat(F.lit("e"), F.floor(F.col("start") / 1_000_000).cast("string")).alias("edge"))
    stops = F.transform(F.sort_array(F.collect_list(F.struct("ord", "edge"))), lambda x: x["edge"])
    joined = w.groupBy("read_id").agg(stops.alias("s"))
    return joined.select("read_id", F.split(F.array_join("s", ",c0,"), ",").alias("path"))


@query(f"WITH {PATHS} SELECT array_to_string(pa, ',') AS path, support FROM sup")
def path_support(spark, sf_dir):
    s = paths.support(read_paths(spark, sf_dir))
    return s.select(F.array_join("path", ",").alias("path"), "support")


@query(f"WITH {PATHS} SELECT COUNT(*) AS reads, CAST(SUM(CASE WHEN len(string_split(p, ',')) >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS valid FROM path")
def path_validity(spark, sf_dir):
    return read_paths(spark, sf_dir).agg(F.count("*").alias("reads"), F.sum(paths.is_valid(F.col("path")).cast("long")).alias("valid"))


#: Paths that no other one holds, edge by edge as often; of equal multisets the first in text order. A path that goes hands its
#: support to the first path that holds it and is still there: an earlier one, or else a later one that stays.
MAXIMAL = PATHS + """,
own AS (SELECT o_orderkey AS read_id, o_custkey % 25 AS amplicon_id FROM orders),
sup2 AS (SELECT amplicon_id, LEAST(string_split(p, ','), string_split(q, ',')) AS pa, COUNT(*) AS support FROM path JOIN own USING (read_id) WHERE len(string_split(p, ',')) >= 3 GROUP BY ALL),
r AS (SELECT amplicon_id, array_to_string(pa, ',') AS path, pa, support, ROW_NUMBER() OVER (PARTITION BY amplicon_id ORDER BY array_to_string(pa, ',')) AS k FROM sup2),
e AS (SELECT amplicon_id, k, edge, COUNT(*) AS n FROM (SELECT amplicon_id, k, UNNEST(pa) AS edge FROM r) GROUP BY ALL),
z AS (SELECT amplicon_id, k, COUNT(*) AS kinds FROM e GROUP BY ALL),
held AS (SELECT x.amplicon_id, x.k AS k, y.k AS h FROM e x JOIN e y ON x.amplicon_id = y.amplicon_id AND x.edge = y.edge AND x.k <> y.k AND y.n >= x.n
         JOIN z ON z.amplicon_id = x.amplicon_id AND z.k = x.k GROUP BY x.amplicon_id, x.k, y.k HAVING COUNT(*) = MAX(z.kinds)),
gone AS (SELECT DISTINCT a.amplicon_id, a.k FROM held a LEFT JOIN held b ON b.amplicon_id = a.amplicon_id AND b.k = a.h AND b.h = a.k WHERE b.k IS NULL OR a.h < a.k),
parent AS (SELECT a.amplicon_id, a.k, COALESCE(MIN(a.h) FILTER (WHERE a.h < a.k), MIN(a.h) FILTER (WHERE g.k IS NULL)) AS h
           FROM held a JOIN gone w ON w.amplicon_id = a.amplicon_id AND w.k = a.k LEFT JOIN gone g ON g.amplicon_id = a.amplicon_id AND g.k = a.h GROUP BY a.amplicon_id, a.k),
up(amplicon_id, k, top) AS (SELECT amplicon_id, k, k FROM r UNION ALL SELECT u.amplicon_id, u.k, p.h FROM up u JOIN parent p ON p.amplicon_id = u.amplicon_id AND p.k = u.top)"""


@query(f"""WITH RECURSIVE {MAXIMAL} SELECT f.amplicon_id, f.path, MAX(r.support) AS support FROM up JOIN r ON r.amplicon_id = up.amplicon_id AND r.k = up.k
JOIN r f ON f.amplicon_id = up.amplicon_id AND f.k = up.top LEFT JOIN gone g ON g.amplicon_id = f.amplicon_id AND g.k = f.k WHERE g.k IS NULL GROUP BY ALL""")
def path_maximal(spark, sf_dir):
    own = t.walk_info(spark, sf_dir).select(F.col("cycle_id").alias("read_id"), "amplicon_id")
    valid = read_paths(spark, sf_dir).where(paths.is_valid(F.col("path"))).join(own, "read_id")
    return paths.maximal(paths.support(valid, "amplicon_id"))


MERGED = t.WALKS + """,
step AS (SELECT *, CASE WHEN chrom = LAG(chrom) OVER w AND strand = LAG(strand) OVER w AND ((strand = '+' AND LAG(e) OVER w + 1 = s) OR (strand = '-' AND LAG(s) OVER w - 1 = e)) THEN 0 ELSE 1 END AS opens
         FROM walk WINDOW w AS (PARTITION BY cycle_id ORDER BY ord)),
piece AS (SELECT *, SUM(opens) OVER (PARTITION BY cycle_id ORDER BY ord) AS p FROM step),
merged AS (SELECT cycle_id, p, chrom, strand, MIN(s) AS s, MAX(e) AS e FROM piece GROUP BY cycle_id, p, chrom, strand),
ring AS (SELECT m.*, iscyclic, weight, COUNT(*) OVER (PARTITION BY m.cycle_id) AS n, FIRST_VALUE(chrom) OVER w AS c1, FIRST_VALUE(strand) OVER w AS d1, FIRST_VALUE(s) OVER w AS s1, FIRST_VALUE(e) OVER w AS e1,
                LAST_VALUE(chrom) OVER w AS c2, LAST_VALUE(strand) OVER w AS d2, LAST_VALUE(s) OVER w AS s2, LAST_VALUE(e) OVER w AS e2
         FROM merged m JOIN info i ON m.cycle_id = i.cycle_id WINDOW w AS (PARTITION BY m.cycle_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
wrapped AS (SELECT *, iscyclic AND n > 1 AND c1 = c2 AND d1 = d2 AND d1 = '+' AND e2 + 1 = s1 AS plus, iscyclic AND n > 1 AND c1 = c2 AND d1 = d2 AND d1 = '-' AND s2 - 1 = e1 AS minus FROM ring)"""


@query(f"""WITH {MERGED} SELECT cycle_id, CAST(ROW_NUMBER() OVER (PARTITION BY cycle_id ORDER BY p) AS INT) AS ord, chrom, CASE WHEN p = 1 AND plus THEN s2 ELSE s END AS "start", CASE WHEN p = 1 AND minus THEN e2 ELSE e END AS "end", strand, iscyclic, weight
FROM wrapped WHERE NOT ((plus OR minus) AND p = n)""")
def cycle_to_bed(spark, sf_dir):
    return cycles.to_bed(t.walks(spark, sf_dir), t.walk_info(spark, sf_dir))


@query(f"WITH {t.WALKS} SELECT cycle_id, iscyclic, weight, amplicon_id, CAST(ROW_NUMBER() OVER (PARTITION BY amplicon_id ORDER BY weight DESC, cycle_id) AS INT) AS rank FROM info")
def cycle_rank(spark, sf_dir):
    return cycles.rank(t.walk_info(spark, sf_dir))


BP_EDGES = t.WALKS + """,
go AS (SELECT w.*, iscyclic, CASE WHEN strand = '+' THEN e ELSE s END AS lp, CASE WHEN strand = '+' THEN s ELSE e END AS ep, CASE WHEN strand = '+' THEN '-' ELSE '+' END AS es FROM walk w JOIN info i ON w.cycle_id = i.cycle_id),
nx AS (SELECT *, LEAD(chrom) OVER w AS nc, LEAD(ep) OVER w AS np, LEAD(es) OVER w AS ns, FIRST_VALUE(chrom) OVER w AS fc, FIRST_VALUE(ep) OVER w AS fp, FIRST_VALUE(es) OVER w AS fs FROM go WINDOW w AS (PARTITION BY cycle_id ORDER BY ord)),
two AS (SELECT chrom AS c, lp AS p, strand AS d, COALESCE(nc, fc) AS c2, COALESCE(np, fp) AS p2, COALESCE(ns, fs) AS d2 FROM nx WHERE nc IS NOT NULL OR iscyclic),
edge AS (SELECT DISTINCT CASE WHEN (c, p, d) <= (c2, p2, d2) THEN c ELSE c2 END AS chrom1, CASE WHEN (c, p, d) <= (c2, p2, d2) THEN p ELSE p2 END AS pos1, CASE WHEN (c, p, d) <= (c2, p2, d2) THEN d ELSE d2 END AS strand1,
         CASE WHEN (c, p, d) <= (c2, p2, d2) THEN c2 ELSE c END AS chrom2, CASE WHEN (c, p, d) <= (c2, p2, d2) THEN p2 ELSE p END AS pos2, CASE WHEN (c, p, d) <= (c2, p2, d2) THEN d2 ELSE d END AS strand2 FROM two)"""


@query(f"WITH {BP_EDGES} SELECT * FROM edge")
def bp_edges_from_cycles(spark, sf_dir):
    return cycles.breakpoint_edges(t.walks(spark, sf_dir), t.walk_info(spark, sf_dir))
