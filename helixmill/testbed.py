"""The domain's tables as deterministic projections of the supplied star-schema tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The centromere of every test chromosome and its length; the same for all.
C_START, C_END = 2_000_000, 3_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, seg_idx, seg_start, seg_end, cn): contiguous closed segments of 1 Mb on 22 chromosomes."""
    key = F.col("p_partkey")
    idx = F.floor(key / F.lit(22.0)).cast("long")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("chr"), (1 + key % 22).cast("string")).alias("chrom"), idx.alias("seg_idx"),
        (idx * 1_000_000).alias("seg_start"), (idx * 1_000_000 + 999_999).alias("seg_end"), (F.col("p_size") / F.lit(5.0)).alias("cn"),
    )


def seed_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as a copy-number file holds them: in file order, end not included."""
    s = cn_segments(spark, sf_dir)
    return s.select(F.col("seg_idx").alias("ord"), "chrom", F.col("seg_start").alias("start"), (F.col("seg_end") + 1).alias("end"), "cn")


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cn_segments(spark, sf_dir)
    return s.groupBy("chrom").agg(F.lit(C_START).cast("long").alias("c_start"), F.lit(C_END).cast("long").alias("c_end"), F.max(F.col("seg_end") + 1).alias("size"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct local alignments of reads: ten 1 Mb bins on three chromosomes."""
    return all_alignments(spark, sf_dir).distinct()


def all_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with copies, for what copies don't change."""
    q, at = F.col("l_quantity").cast("long"), (F.col("l_suppkey") % 10) * 1_000_000
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("read_id"), (F.col("l_linenumber") * 5000).cast("long").alias("q_start"), (F.col("l_linenumber") * 5000 + q * 90).alias("q_end"),
        F.concat(F.lit("chr"), (1 + F.col("l_partkey") % 3).cast("string")).alias("chrom"), (at + q * 10).alias("r_start"), (at + q * 110).alias("r_end"),
        F.when(F.col("l_linestatus") == "F", "+").otherwise("-").alias("strand"), F.round(F.col("l_discount") * 600).cast("int").alias("mapq"), F.col("l_tax").alias("nm_rate"),
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplicon intervals (interval_id, amplicon_id, chrom, start, end): stretches of segments of copy number 5 and more."""
    from .operators.islands import adjacent_islands

    s = cn_segments(spark, sf_dir).where("cn >= 5").select("chrom", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"))
    rows = adjacent_islands(s, ["chrom"])
    key = F.regexp_replace("chrom", "chr", "").cast("long") * 10_000 + F.floor(F.col("start") / 1_000_000)
    return rows.select(key.alias("interval_id"), key.alias("amplicon_id"), "chrom", "start", "end")


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered segments of walks (cycle_id, ord, chrom, start, end, strand): the alignments of each read, whole bins."""
    from pyspark.sql import Window

    from .operators.reads import READ_ORDER

    a = alignments(spark, sf_dir)
    at = F.floor(F.col("r_start") / 1_000_000)
    w = Window.partitionBy("read_id").orderBy(*READ_ORDER)
    return a.select(F.col("read_id").alias("cycle_id"), F.row_number().over(w).alias("ord"), "chrom", (at * 1_000_000).alias("start"), (at * 1_000_000 + 999_999).alias("end"), "strand")


def walk_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cycle_id, iscyclic, weight, amplicon_id) of the walks."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("cycle_id"), (F.col("o_orderstatus") != "P").alias("iscyclic"), (F.floor(F.col("o_totalprice")) / F.lit(1000.0)).alias("weight"), (F.col("o_custkey") % 25).alias("amplicon_id"))


SEGMENTS = """seg AS (
  SELECT 'chr' || CAST(1 + p_partkey % 22 AS VARCHAR) AS chrom, CAST(FLOOR(p_partkey / 22.0) AS BIGINT) AS seg_idx,
         CAST(FLOOR(p_partkey / 22.0) AS BIGINT) * 1000000 AS seg_start, CAST(FLOOR(p_partkey / 22.0) AS BIGINT) * 1000000 + 999999 AS seg_end,
         CAST(p_size AS DOUBLE) / CAST(5.0 AS DOUBLE) AS cn
  FROM part)"""

ALIGNMENTS = """aln AS (
  SELECT DISTINCT l_orderkey AS read_id, CAST(l_linenumber * 5000 AS BIGINT) AS q_start, l_linenumber * 5000 + CAST(l_quantity AS BIGINT) * 90 AS q_end,
         'chr' || CAST(1 + l_partkey % 3 AS VARCHAR) AS chrom, (l_suppkey % 10) * 1000000 + CAST(l_quantity AS BIGINT) * 10 AS r_start,
         (l_suppkey % 10) * 1000000 + CAST(l_quantity AS BIGINT) * 110 AS r_end, CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand,
         CAST(ROUND(l_discount * 600) AS INT) AS mapq, l_tax AS nm_rate
  FROM lineitem)"""

PAIRS = ALIGNMENTS + """,
near AS (
  SELECT read_id, chrom AS chrom1, r_start AS s1, r_end AS e1, strand AS strand1, mapq AS mapq1, q_end AS q1,
         LEAD(chrom) OVER w AS chrom2, LEAD(r_start) OVER w AS s2, LEAD(r_end) OVER w AS e2, LEAD(strand) OVER w AS strand2, LEAD(mapq) OVER w AS mapq2, LEAD(q_start) OVER w AS q2
  FROM aln WINDOW w AS (PARTITION BY read_id ORDER BY q_start, q_end, chrom, r_start, strand, mapq, nm_rate)),
pairs AS (SELECT *, q2 - q1 AS gap FROM near WHERE chrom2 IS NOT NULL AND q2 - q1 + 100 >= 0 AND mapq1 >= 20 AND mapq2 >= 20)"""

#: Ends where the first alignment leaves and the second begins. The first spread over more than the clusters' cutoff, so a
#: bin of 1 Mb holds several clusters, and chains of points that are longer than the cutoff.
BREAKPOINTS = PAIRS + """,
way AS (SELECT *, chrom1 > chrom2 OR (chrom1 = chrom2 AND s2 < e1) AS rev, CASE WHEN strand2 = '+' THEN '-' ELSE '+' END AS other2 FROM pairs),
bp AS (
  SELECT read_id, gap, rev,
         CASE WHEN rev THEN chrom1 ELSE chrom2 END AS chrom_a, CASE WHEN rev THEN e1 ELSE s2 END AS pos_a, CASE WHEN rev THEN strand1 ELSE other2 END AS strand_a,
         CASE WHEN rev THEN chrom2 ELSE chrom1 END AS chrom_b, CASE WHEN rev THEN s2 ELSE e1 END AS pos_b, CASE WHEN rev THEN other2 ELSE strand1 END AS strand_b
  FROM way)"""

def clusters_sql(least: int) -> str:
    """First-fit clusters of a table bp, point by point in the order of reads: a point joins the first cluster (c) that has a
    member nearer than 2000 on both axes, else it opens one. Keys of fewer than `least` points are one cluster, -1 (cl)."""
    return """
seqd AS (
  SELECT *, ROW_NUMBER() OVER w AS rk, COUNT(*) OVER (PARTITION BY chrom_a, chrom_b, strand_a, strand_b) AS k FROM bp
  WINDOW w AS (PARTITION BY chrom_a, chrom_b, strand_a, strand_b ORDER BY read_id, pos_a, pos_b, gap)),
fold AS (
  SELECT chrom_a, chrom_b, strand_a, strand_b, rk, CAST(0 AS BIGINT) AS c, [{'a': pos_a, 'b': pos_b, 'c': CAST(0 AS BIGINT)}] AS m FROM seqd WHERE rk = 1
  UNION ALL
  SELECT chrom_a, chrom_b, strand_a, strand_b, rk, c, list_append(m, {'a': pos_a, 'b': pos_b, 'c': c}) FROM (
    SELECT s.chrom_a, s.chrom_b, s.strand_a, s.strand_b, s.rk, s.pos_a, s.pos_b, f.m,
           COALESCE(list_min([x.c for x in f.m if abs(x.a - s.pos_a) < 2000 AND abs(x.b - s.pos_b) < 2000]), list_max([x.c for x in f.m]) + 1) AS c
    FROM fold f JOIN seqd s ON s.chrom_a = f.chrom_a AND s.chrom_b = f.chrom_b AND s.strand_a = f.strand_a AND s.strand_b = f.strand_b AND s.rk = f.rk + 1)),
cl AS (SELECT s.*, f.c, CASE WHEN k < 3 THEN -1 ELSE f.c END AS cl FROM seqd s JOIN fold f USING (chrom_a, chrom_b, strand_a, strand_b, rk))""".replace("k < 3", f"k < {least}")


def exact_sql(least: int) -> str:
    """Exact calls of the clusters cl, round by round: the centre of what lies within three windows of the mean (the most
    frequent position, or the median if two are as frequent), then the members that match it go, and the rest is tried
    again. Tables round_, with all calls, and exact, with those of support."""
    return """
start_ AS (
  SELECT chrom_a, chrom_b, strand_a, strand_b, cl, list({'a': pos_a, 'b': pos_b, 'g': 1.2 * gap} ORDER BY rk) AS rest FROM cl GROUP BY chrom_a, chrom_b, strand_a, strand_b, cl HAVING COUNT(*) >= 3),
round_ AS (
  SELECT chrom_a, chrom_b, strand_a, strand_b, cl, CAST(-1 AS INT) AS call, rest, CAST(NULL AS BIGINT) AS at_a, CAST(NULL AS BIGINT) AS at_b, CAST(0 AS BIGINT) AS support, TRUE AS more FROM start_
  UNION ALL
  SELECT chrom_a, chrom_b, strand_a, strand_b, cl, call + 1, [m for m in marked if NOT m.ok], at_a, at_b, len([m for m in marked if m.ok]), len([m for m in marked if m.ok]) > 0 FROM (
    SELECT *, [{'a': m.a, 'b': m.b, 'g': m.g, 'ok': CASE WHEN m.g <= 0 THEN abs(m.a - at_a) < 100 AND abs(m.b - at_b) < 100
                 ELSE (abs(m.a - at_a) < 100 OR (m.sa IS NOT NULL AND m.g - COALESCE(m.sa, 0) - COALESCE(m.sb, 0) >= 0))
                  AND (abs(m.b - at_b) < 100 OR (m.sb IS NOT NULL AND m.g - COALESCE(m.sa, 0) - COALESCE(m.sb, 0) >= 0)) END} for m in paid] AS marked FROM (
      SELECT *, [{'a': m.a, 'b': m.b, 'g': m.g,
                  'sa': CASE WHEN strand_a = '+' AND m.a <= at_a - 100 THEN at_a - 100 - m.a + 1 WHEN strand_a = '-' AND m.a >= at_a + 100 THEN m.a - at_a - 100 + 1 END,
                  'sb': CASE WHEN strand_b = '+' AND m.b <= at_b - 100 THEN at_b - 100 - m.b + 1 WHEN strand_b = '-' AND m.b >= at_b + 100 THEN m.b - at_b - 100 + 1 END} for m in rest] AS paid FROM (
        SELECT *, CAST(CASE WHEN len(ta) = 1 THEN ta[1].v WHEN strand_a = '+' THEN ceil(list_median(xa)) ELSE floor(list_median(xa)) END AS BIGINT) AS at_a,
                  CAST(CASE WHEN len(tb) = 1 THEN tb[1].v WHEN strand_b = '+' THEN ceil(list_median(xb)) ELSE floor(list_median(xb)) END AS BIGINT) AS at_b FROM (
          SELECT *, [c for c in ca if c.n = list_max([d.n for d in ca])] AS ta, [c for c in cb if c.n = list_max([d.n for d in cb])] AS tb FROM (
            SELECT *, [{'n': len([x for x in xa if x = v]), 'v': v} for v in list_distinct(xa)] AS ca, [{'n': len([x for x in xb if x = v]), 'v': v} for v in list_distinct(xb)] AS cb FROM (
              SELECT *, [m.a for m in inside] AS xa, [m.b for m in inside] AS xb FROM (
                SELECT *, [m for m in rest if abs(m.a - ma) <= 3 * greatest(sa, 100 / 2.99) AND abs(m.b - mb) <= 3 * greatest(sb, 100 / 2.99)] AS inside FROM (
                  SELECT chrom_a, chrom_b, strand_a, strand_b, cl, call, rest, list_avg([m.a for m in rest]) AS ma, list_avg([m.b for m in rest]) AS mb, list_stddev_pop([m.a for m in rest]) AS sa, list_stddev_pop([m.b for m in rest]) AS sb
                  FROM round_ WHERE more AND len(rest) >= 3))))))))),
exact AS (SELECT chrom_a, chrom_b, strand_a, strand_b, cl, call, at_a AS pos_a, at_b AS pos_b, support FROM round_ WHERE support >= 3)""".replace(">= 3", f">= {least}")


def merged_sql(near_a: int, near_b: int) -> str:
    """Calls of the table exact that are nearer than the distances joined to the first kept one, in the order of position."""
    return f"""
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chrom_a, chrom_b, strand_a, strand_b ORDER BY pos_a, pos_b, support) AS rk FROM exact),
kept AS (
  SELECT chrom_a, chrom_b, strand_a, strand_b, rk, [{{'a': pos_a, 'b': pos_b, 's': support}}] AS m FROM placed WHERE rk = 1
  UNION ALL
  SELECT chrom_a, chrom_b, strand_a, strand_b, rk, CASE WHEN home IS NULL THEN list_append(m, {{'a': pos_a, 'b': pos_b, 's': support}}) ELSE list_transform(m, lambda x, i: CASE WHEN i = home THEN {{'a': x.a, 'b': x.b, 's': x.s + support}} ELSE x END) END FROM (
    SELECT p.*, k.m, list_min([i for i in range(1, len(k.m) + 1) if abs(k.m[i].a - p.pos_a) < {near_a} AND abs(k.m[i].b - p.pos_b) < {near_b}]) AS home
    FROM kept k JOIN placed p ON p.chrom_a = k.chrom_a AND p.chrom_b = k.chrom_b AND p.strand_a = k.strand_a AND p.strand_b = k.strand_b AND p.rk = k.rk + 1)),
last_ AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chrom_a, chrom_b, strand_a, strand_b ORDER BY rk DESC) AS back FROM kept),
merged AS (SELECT chrom_a, chrom_b, strand_a, strand_b, x.a AS pos_a, x.b AS pos_b, CAST(x.s AS BIGINT) AS support FROM (SELECT chrom_a, chrom_b, strand_a, strand_b, UNNEST(m) AS x FROM last_ WHERE back = 1))"""


CLUSTERS = BREAKPOINTS + "," + clusters_sql(3)
EXACT = CLUSTERS + "," + exact_sql(3)

INTERVALS = SEGMENTS + """,
amp_new AS (SELECT *, CASE WHEN seg_idx - LAG(seg_idx) OVER (PARTITION BY chrom ORDER BY seg_idx) = 1 THEN 0 ELSE 1 END AS opens FROM seg WHERE cn >= 5),
amp_run AS (SELECT *, SUM(opens) OVER (PARTITION BY chrom ORDER BY seg_idx) AS run FROM amp_new),
amp AS (
  SELECT CAST(replace(chrom, 'chr', '') AS BIGINT) * 10000 + MIN(seg_idx) AS amplicon_id, chrom, MIN(seg_start) AS s, MAX(seg_end) AS e
  FROM amp_run GROUP BY chrom, run)"""

WALKS = ALIGNMENTS + """,
walk AS (
  SELECT read_id AS cycle_id, ROW_NUMBER() OVER (PARTITION BY read_id ORDER BY q_start, q_end, chrom, r_start, strand, mapq, nm_rate) AS ord,
         chrom, CAST(FLOOR(r_start / 1000000.0) AS BIGINT) * 1000000 AS s, CAST(FLOOR(r_start / 1000000.0) AS BIGINT) * 1000000 + 999999 AS e, strand
  FROM aln),
info AS (
  SELECT o_orderkey AS cycle_id, o_orderstatus <> 'P' AS iscyclic, FLOOR(o_totalprice) / CAST(1000.0 AS DOUBLE) AS weight, o_custkey % 25 AS amplicon_id FROM orders)"""


def breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oriented breakpoints of neighbouring alignments, not yet computed."""
    from .operators import reads

    return reads.orient(reads.adjacent_pairs(alignments(spark, sf_dir)))


def stored_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a written table, without what clusters don't need: chromosome order is worked out once, and no branch of
    a plan repeats the pairs."""
    from .storage import stored

    return stored(breakpoints(spark, sf_dir).select("read_id", "gap", "chrom_a", "pos_a", "strand_a", "chrom_b", "pos_b", "strand_b"), "breakpoints")


def raw_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments as supplementary tags give them: on the reverse strand r_start is the larger end."""
    back = F.col("strand") == "-"
    a = alignments(spark, sf_dir)
    return a.withColumns({"r_start": F.when(back, F.col("r_end")).otherwise(F.col("r_start")), "r_end": F.when(back, F.col("r_start")).otherwise(F.col("r_end"))})


#: The same in SQL, with their place in the read and the fields of the next two (1, 2).
RAW = ALIGNMENTS + """,
raw AS (SELECT * EXCLUDE (r_start, r_end), CASE WHEN strand = '+' THEN r_start ELSE r_end END AS rs, CASE WHEN strand = '+' THEN r_end ELSE r_start END AS re FROM aln),
ord AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY read_id ORDER BY q_start, q_end, chrom, rs, strand, mapq, nm_rate) - 1 AS i FROM raw)"""


def pairs_sql(marked: str, first: str, second: str) -> str:
    """bp: oriented pairs of the table `marked` (ord and its own column mark), neighbours for which `first` holds, and around a
    badly mapped alignment those for which `second` holds and neither neighbour pair was taken."""
    return f"""
lead1 AS (SELECT *, LEAD(i) OVER w AS i1, LEAD(chrom) OVER w AS c1, LEAD(rs) OVER w AS rs1, LEAD(strand) OVER w AS d1, LEAD(mapq) OVER w AS m1, LEAD(q_start) OVER w - q_end AS g1, LEAD(mark) OVER w AS k1,
                 LEAD(chrom, 2) OVER w AS c2, LEAD(rs, 2) OVER w AS rs2, LEAD(strand, 2) OVER w AS d2, LEAD(mapq, 2) OVER w AS m2, LEAD(q_start, 2) OVER w - q_end AS g2, LEAD(mark, 2) OVER w AS k2
          FROM {marked} WINDOW w AS (PARTITION BY read_id ORDER BY i)),
lead2 AS (SELECT *, COALESCE(mapq >= 20 AND m1 >= 20 AND ({first}), FALSE) AS taken FROM lead1),
lead3 AS (SELECT *, COALESCE(LEAD(taken) OVER (PARTITION BY read_id ORDER BY i), FALSE) AS taken1 FROM lead2),
two AS (SELECT read_id, chrom AS chrom1, re AS p1, strand AS strand1, c1 AS chrom2, rs1 AS p2, d1 AS strand2, g1 AS gap FROM lead3 WHERE taken
        UNION ALL SELECT read_id, chrom, re, strand, c2, rs2, d2, g2 FROM lead3 WHERE NOT taken AND NOT taken1 AND m1 < 10 AND mapq >= 20 AND m2 >= 20 AND COALESCE({second}, FALSE)),
way AS (SELECT *, chrom1 > chrom2 OR (chrom1 = chrom2 AND p2 < p1) AS rev, CASE WHEN strand2 = '+' THEN '-' ELSE '+' END AS other2 FROM two),
bp AS (
  SELECT read_id, CAST(gap AS BIGINT) AS gap, CASE WHEN rev THEN chrom1 ELSE chrom2 END AS chrom_a, CASE WHEN rev THEN p1 ELSE p2 END AS pos_a, CASE WHEN rev THEN strand1 ELSE other2 END AS strand_a,
         CASE WHEN rev THEN chrom2 ELSE chrom1 END AS chrom_b, CASE WHEN rev THEN p2 ELSE p1 END AS pos_b, CASE WHEN rev THEN other2 ELSE strand1 END AS strand_b
  FROM way)"""
