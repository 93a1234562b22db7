"""Operators on small inputs with results worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from helixmill.functions import chrom, cigar, intervals
from helixmill.operators import clustering, components, coverage, cycles, expand, graph, islands, joins, paths, reads, scoring, seeding
from helixmill.operators import geometry
from helixmill.plans import interval_queries


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_chromosome_order(spark):
    names = ["chrM", "Chr10", "chrx", "chr2", "chrUn_1", "chrY", "1"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    got = [r.c for r in df.orderBy(chrom.sort_key(F.col("c"))).collect()]
    assert got == ["1", "chr2", "Chr10", "chrx", "chrY", "chrUn_1", "chrM"]
    assert [r.c for r in df.where(chrom.is_canonical(F.col("c"))).orderBy("c").collect()] == ["1", "Chr10", "chr2", "chrM", "chrY", "chrx"]


def test_cigar(spark):
    df = spark.createDataFrame([("5S10M2I3M4D5H", "+"), ("5S10M2I3M4D5H", "-"), ("10M", "+"), ("4S", "+"), ("3=2X1D4=", "+")], "c string, s string")
    got = [tuple(r.b) for r in df.select(cigar.query_bounds(F.col("c"), F.col("s")).alias("b")).collect()]
    assert got == [(5, 20, 17), (5, 20, 17), (0, 10, 10), (4, 4, 0), (0, 9, 10)]
    one = spark.createDataFrame([("100M700D50M10D5M", 1000)], "c string, p long")
    gaps = one.select(cigar.large_gaps(F.col("c"), F.col("p")).alias("g"), cigar.to_plain_matches(F.lit("3=2X1D4=")).alias("m")).first()
    assert [tuple(g) for g in gaps.g] == [(1800, 1100)] and gaps.m == "5M1D4M"


def test_sa_tags(spark):
    tags = spark.createDataFrame([("r", "chr1,101,+,10S20M,60,2;chr2,201,-,15S15M,30,0;"), ("bad", "chr1,1,+,20M,60,0;chr1,5,+,3S4M,60,0;")], "read_id string, sa string")
    got = rows(reads.from_sa_tags(tags), "q_start")
    assert got == [("r", 0, 15, "chr2", 214, 200, "-", 30, 0.0), ("r", 10, 30, "chr1", 100, 119, "+", 60, 0.1)]


def test_interval_predicates(spark):
    df = spark.createDataFrame([("chr1", 10, 20, 15, 30), ("chr1", 10, 20, 21, 30), ("chr1", 10, 20, 40, 50)], "c string, a long, b long, x long, y long")
    p = intervals.Span(F.col("c"), F.col("a"), F.col("b"))
    q = intervals.Span(F.col("c"), F.col("x"), F.col("y"))
    got = rows(df.select("x", intervals.overlaps(p, q), intervals.adjacent(p, q), intervals.near(p, q, 20), intervals.intersection(p, q)["start"]), "x")
    assert got == [(15, True, False, True, 15), (21, False, True, True, None), (40, False, False, True, None)]


def test_range_join_against_loops(spark):
    pick = random.Random(3)
    make = lambda n: [(pick.choice(["a", "b"]), s := pick.randint(0, 500), s + pick.randint(0, 120), k) for k in range(n)]
    x, y = make(60), make(50)
    left = spark.createDataFrame(x, "k string, s long, e long, i long")
    right = spark.createDataFrame(y, "k string, s2 long, e2 long, j long")
    want = sorted((a[3], b[3]) for a in x for b in y if a[0] == b[0] and a[1] <= b[2] and a[2] >= b[1])
    inner = joins.range_join(left, right, ["k"], ("s", "e"), ("s2", "e2"), bin_size=50)
    assert rows(inner.select("i", "j")) == want
    outer = joins.range_join(left, right, ["k"], ("s", "e"), ("s2", "e2"), how="left", bin_size=50)
    assert sorted((r.i, r.j) for r in outer.collect() if r.j is not None) == want
    assert {r.i for r in outer.collect() if r.j is None} == {a[3] for a in x} - {i for i, _ in want}


def test_point_join_keeps_all_points(spark):
    p = spark.createDataFrame([("c", 5), ("c", 25), ("d", 5)], "k string, at long")
    i = spark.createDataFrame([("c", 0, 9, 1), ("c", 10, 19, 2)], "k string, s long, e long, n long")
    assert rows(joins.point_join(p, i, ["k"], "at", ("s", "e"), 10).select("k", "at", "n"), "k", "at") == [("c", 5, 1), ("c", 25, None), ("d", 5, None)]


def test_merge_and_subtract(spark):
    df = spark.createDataFrame([("c", 0, 9), ("c", 12, 20), ("c", 31, 40), ("d", 5, 6), ("c", 0, 9)], "k string, start long, end long")
    assert rows(islands.merge_intervals(df, ["k"], 3, bin_size=10)) == [("c", 0, 20), ("c", 31, 40), ("d", 5, 6)]
    whole = spark.createDataFrame([(1, "c", 5, 35), (2, "d", 5, 6), (3, "e", 1, 2)], "id long, k string, start long, end long")
    assert rows(islands.subtract(whole, df, ["k"], "id").select("id", "start", "end")) == [(1, 10, 11), (1, 21, 30), (3, 1, 2)]


def test_seeds_follow_the_length_rules(spark):
    arms = spark.createDataFrame([("chr1", 10_000_000, 11_000_000, 30_000_000)], "chrom string, c_start long, c_end long, size long")
    segs = [(0, "chr1", 0, 2_000_000, 2.0), (1, "chr1", 2_000_000, 2_050_000, 9.0), (2, "chr1", 2_100_000, 2_200_000, 9.0), (3, "chr1", 2_200_000, 9_000_000, 2.0), (4, "chr1", 10_500_000, 10_600_000, 20.0), (5, "chr1", 12_000_000, 12_010_000, 30.0)]
    df = spark.createDataFrame(segs, "ord long, chrom string, start long, end long, cn double")
    assert rows(seeding.seeds(df, arms)) == [("chr1", 2_000_000, 2_199_999)]
    assert rows(seeding.arm_copy_number(df, arms)) == [("chr1", "p", 2.0), ("chr1", "q", 2.0)]


def test_centromere_regions_must_touch(spark):
    sizes = spark.createDataFrame([("chr1", 100)], "chrom string, size long")
    good = spark.createDataFrame([("chr1", 10, 20), ("chr1", 20, 30)], "chrom string, start long, end long")
    assert rows(seeding.centromeres(good, sizes)) == [("chr1", 10, 30, 100)]
    with pytest.raises(Exception, match="not contiguous"):
        seeding.centromeres(spark.createDataFrame([("chr1", 10, 20), ("chr1", 25, 30)], "chrom string, start long, end long"), sizes).collect()


def test_coverage(spark):
    i = spark.createDataFrame([("c", 10, 19), ("c", 100, 109)], "chrom string, start long, end long")
    b = spark.createDataFrame([("c", 0, 12), ("c", 15, 40), ("c", 19, 20)], "chrom string, b_start long, b_end long")
    assert rows(coverage.raw_coverage(i, b, ["chrom"], 8)) == [("c", 10, 19, 8), ("c", 100, 109, 0)]
    w = coverage.windows(spark.createDataFrame([("c", 0, 24)], "chrom string, start long, end long"), 10)
    assert rows(w.select("start", "end")) == [(0, 9), (10, 19), (20, 24)]


def test_node_order(spark):
    cases = [("chr7", 55155021, "-", "chr7", 55127266, "+"), ("chr5", 100, "+", "chr2", 900, "-"), ("chr7", 500, "+", "chr7", 500, "-")]
    df = spark.createDataFrame(cases, "c1 string, p1 long, s1 string, c2 string, p2 long, s2 string")
    low, high = reads.ordered_nodes(*[F.col(c) for c in df.columns])
    got = [(r.x.chrom, r.x.pos, r.x.strand, r.y.chrom, r.y.pos, r.y.strand) for r in df.select(low.alias("x"), high.alias("y")).collect()]
    assert got == [("chr7", 55127266, "+", "chr7", 55155021, "-"), ("chr2", 900, "-", "chr5", 100, "+"), ("chr7", 500, "-", "chr7", 500, "+")]


def test_clusters_match_a_plain_fold(spark):
    pick = random.Random(5)
    pts = [(k, "chr1", pick.randint(0, 30_000), "+", "chr2", pick.randint(0, 30_000), "-", 0) for k in range(150)]
    df = spark.createDataFrame(pts, "read_id long, chrom_a string, pos_a long, strand_a string, chrom_b string, pos_b long, strand_b string, gap long")
    got = clustering.cluster(df).groupBy("cluster").agg(F.sort_array(F.collect_list("read_id")).alias("ids")).collect()
    plain = []
    for k, _, a, _, _, b, _, _ in pts:
        home = next((c for c in plain if any(abs(a - x) < 2000 and abs(b - y) < 2000 for _, x, y in c)), None)
        if home is None:
            plain.append(home := [])
        home.append((k, a, b))
    assert sorted(tuple(r.ids) for r in got) == sorted(tuple(k for k, _, _ in c) for c in plain)


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(100, 160)] + [(5, 3), (3, 9), (7, 7)], "u long, v long")
    got = dict(rows(components.connected_components(e)))
    assert got[160] == 100 and got[9] == 3 and got[5] == 3 and 7 not in got and len(got) == 64
    i = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "interval_id long, amplicon_id long")
    links = spark.createDataFrame([(0, 1), (1, 2), (2, None)], "interval_a long, interval_b long")
    assert rows(components.merge_connected(i, links).select("interval_id", "amplicon_id")) == [(0, 0), (1, 0), (2, 0)]


def test_graph_pieces(spark):
    i = spark.createDataFrame([(1, "c", 0, 99)], "amplicon_id long, chrom string, start long, end long")
    b = spark.createDataFrame([("c", 49, "+", "c", 20, "-", 5)], "chrom_a string, pos_a long, strand_a string, chrom_b string, pos_b long, strand_b string, reads long")
    cuts = graph.split_points(i, graph.ends_of(b))
    assert rows(graph.sequence_edges(i, cuts)) == [(1, "c", 0, 19), (1, "c", 20, 49), (1, "c", 50, 99)]
    assert rows(graph.concordant_edges(cuts)) == [(1, "c", 19, 20), (1, "c", 49, 50)]
    a = spark.createDataFrame([(1, "c", -200, 300), (2, "c", -200, 300), (3, "c", 0, 90)], "read_id long, chrom string, r_start long, r_end long")
    used = spark.createDataFrame([(2, "c", 20)], "read_id long, chrom string, pos long")
    assert rows(graph.concordant_support(graph.concordant_edges(cuts).drop("amplicon_id"), a, used)) == [("c", 19, 20, 1), ("c", 49, 50, 2)]
    s = graph.statistics(graph.sequence_edges(i, cuts), graph.concordant_edges(cuts), graph.discordant_edges(b, i), i).first()
    assert (s.n_sequence, s.n_concordant, s.n_discordant, s.n_nodes, s.n_nonsource, s.n_source, s.n_edges, s["size"]) == (3, 2, 1, 6, 6, 4, 10, 100)


def test_paths(spark):
    df = spark.createDataFrame([(1, ["e1", "c1", "e2"]), (2, ["e2", "c1", "e1"]), (3, ["e1", "c1", "e2", "d1", "e3"]), (4, ["e1", "e2", "c1"])], "read_id long, path array<string>")
    assert rows(df.select("read_id", paths.is_valid(F.col("path")))) == [(1, True), (2, True), (3, True), (4, False)]
    s = paths.support(df.where("read_id < 4").withColumn("amplicon_id", F.lit(1).cast("long")), "amplicon_id")
    assert rows(paths.maximal(s)) == [(1, "e1,c1,e2,d1,e3", 2)]


def test_cycles_to_bed(spark):
    s = spark.createDataFrame([(1, 1, "c", 0, 9, "+"), (1, 2, "c", 10, 19, "+"), (1, 3, "d", 0, 9, "-"), (2, 1, "c", 10, 19, "-"), (2, 2, "c", 0, 9, "-"), (3, 1, "c", 10, 19, "+"), (3, 2, "d", 5, 6, "+"), (3, 3, "c", 0, 9, "+")], "cycle_id long, ord long, chrom string, start long, end long, strand string")
    info = spark.createDataFrame([(1, True, 2.0), (2, False, 1.0), (3, True, 1.0)], "cycle_id long, iscyclic boolean, weight double")
    got = rows(cycles.to_bed(s, info).select("cycle_id", "ord", "chrom", "start", "end", "strand"))
    assert got == [(1, 1, "c", 0, 19, "+"), (1, 2, "d", 0, 9, "-"), (2, 1, "c", 0, 19, "-"), (3, 1, "c", 0, 19, "+"), (3, 2, "d", 5, 6, "+")]
    edges = rows(cycles.breakpoint_edges(s.where("cycle_id = 1"), info))
    assert ("c", 9, "+", "c", 10, "-") in edges and len(edges) == 3


def test_scores(spark):
    truth = spark.createDataFrame([("c", 0, 100)], "chrom string, start long, end long")
    same = spark.createDataFrame([(1, "c", 0, 100), (2, "c", 0, 50)], "cycle_id long, chrom string, start long, end long")
    assert rows(scoring.fragment_similarity(truth, same)) == [(1, 1.0, 0.0), (2, 0.5, -0.5)]
    e = lambda *r: spark.createDataFrame(list(r), "chrom1 string, pos1 long, strand1 string, chrom2 string, pos2 long, strand2 string")
    true, found = e(("c", 100, "+", "d", 500, "-"), ("c", 900, "+", "d", 500, "-")), e(("d", 540, "-", "c", 60, "+"))
    assert rows(scoring.matched_edges(true, found, 100).select("pos1")) == [(100,)]


def test_axis_and_widths(spark):
    df = spark.createDataFrame([(4.0, 40.0), (2.0, 20.0)], "cn double, cov double")
    r = geometry.axis_fit(df, "cn", "cov", 1.2).first()
    assert (round(r.factor, 9), r.cn_max, round(r.cn_ymax, 9)) == (10.0, 4.0, 4.8)
    w = spark.createDataFrame([(1, 4), (2, 4), (4, 4), (10, 10), (4, 0)], "n long, m long")
    assert [r[0] for r in w.select(geometry.line_width(F.col("n"), F.col("m"))).collect()] == [1.0, 2.0, 4.0, 4.0, 4.0]


def test_search_ends(spark):
    seg = spark.createDataFrame([("c", k, k * 1000, k * 1000 + 999, 2.0) for k in range(20)], "chrom string, seg_idx long, seg_start long, seg_end long, cn double")
    hits = spark.createDataFrame([(r, "c", i) for r in range(3) for i in (1, 9)] + [(r, "c", i) for r in range(10, 13) for i in (9, 15)], "read_id long, chrom string, idx long")
    seeds = spark.createDataFrame([("c", 1000, 1999)], "chrom string, start long, end long")
    import dataclasses

    from helixmill.config import DEFAULT
    got = rows(expand.search(seeds, hits, seg, 3, dataclasses.replace(DEFAULT, interval_delta=100)))
    assert got == [("c", 900, 2099), ("c", 8900, 10099), ("c", 14900, 16099)]  # what a padded stretch adds to known ones is kept


def test_search_splits_stretches_at_wide_gaps(spark):
    seg = spark.createDataFrame([("c", 0, 0, 999, 2.0), ("c", 1, 10_000, 10_999, 2.0), ("c", 2, 2_010_999, 2_011_998, 2.0), ("c", 3, 4_011_999, 4_012_998, 2.0)], "chrom string, seg_idx long, seg_start long, seg_end long, cn double")
    hits = spark.createDataFrame([(r, "c", i) for r in range(3) for i in range(4)], "read_id long, chrom string, idx long")
    front = spark.createDataFrame([("c", 0)], "chrom string, idx long")
    # 2,000,000 bases from the end to the next start are joined, 2,000,001 are not
    assert rows(expand.next_level(front, hits, 3, segments=seg).select("first_idx", "last_idx")) == [(1, 2), (3, 3)]


def test_search_has_no_deepest_level(spark, monkeypatch):
    from unittest.mock import MagicMock

    left = iter([1] * 60 + [0])  # rows a level adds: sixty levels and an empty one, without running them
    for name in ("merge_intervals", "next_level", "padded", "range_join"):
        monkeypatch.setattr(expand, name, MagicMock())
    monkeypatch.setattr(expand, "stored", lambda df, name: df)
    level = MagicMock()
    level.select.return_value.distinct.return_value.limit.return_value.count.side_effect = lambda: next(left)
    monkeypatch.setattr(expand, "subtract", lambda *a: level)
    expand.search(MagicMock(), MagicMock(), MagicMock(), 3)
    assert next(left, None) is None


ALN = "read_id long, q_start long, q_end long, chrom string, r_start long, r_end long, strand string, mapq int, nm_rate double"


def aln(spark, *rows):
    """Alignments (read, q_start, q_end, chrom, r_start, r_end, strand, mapq)."""
    return spark.createDataFrame([(*r, 0.0) for r in rows], ALN)


def test_hsr_needs_one_end_inside(spark):
    rows = [x for k in range(4) for x in ((k, 0, 50, "chr1", 10, 50, "+", 60), (k, 50, 99, "chr2", 7000 + k % 2, 7100, "+", 60))]
    rows += [(9, 0, 50, "chr1", 10, 50, "+", 60), (9, 50, 99, "chr1", 70, 90, "+", 60), (10, 0, 50, "chr1", 10, 50, "+", 60), (10, 50, 99, "chrUn_x", 7, 90, "+", 60)]
    amp = spark.createDataFrame([("chr1", 0, 100)], "chrom string, start long, end long")
    seg = lambda cn: spark.createDataFrame([("chr2", 0, 9999, cn)], "chrom string, seg_start long, seg_end long, cn double")
    from helixmill.operators import hsr as h

    got = h.sites(aln(spark, *rows), amp, seg(2.0), 8.0).collect()
    # positions 7000 and 7001 are as frequent: the median, rounded down on the reverse strand
    assert [(r.chrom, r.pos, r.support) for r in got] == [("chr2", 7000, 4)]
    assert h.sites(aln(spark, *rows), amp, seg(6.0), 8.0).collect() == []  # amplified there
    assert h.sites(aln(spark, *rows), amp, seg(2.0), 1.5).collect() == []  # more support than 2.5 times the coverage
    sizes = spark.createDataFrame([("chr2", 30_000), ("chr1", 10_000)], "chrom string, size long")
    assert rows_of(h.genome_axis(sizes)) == [("chr1", 0.0, 25.0, 12.5), ("chr2", 25.0, 100.0, 62.5)]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_pairs_within_an_interval(spark):
    own = spark.createDataFrame([(0, "c", 0, 999), (1, "c", 900, 5000)], "idx int, chrom string, start long, end long")
    a = aln(
        spark,
        (1, 0, 100, "c", 100, 200, "+", 60), (1, 100, 200, "c", 201, 300, "+", 60),  # follows on the reference: no breakpoint
        (2, 0, 100, "c", 100, 200, "+", 60), (2, 100, 200, "c", 700, 800, "+", 60),  # a gap of 500 that the read lacks
        (3, 0, 100, "c", 100, 200, "+", 60), (3, 100, 200, "c", 300, 201, "-", 60),  # other strand
        (4, 0, 100, "c", 100, 200, "+", 60), (4, 100, 200, "c", 1500, 1600, "+", 60),  # other interval
        (5, 0, 100, "c", 100, 200, "+", 60), (5, 100, 200, "c", 990, 950, "-", 60),  # both intervals hold it: the first counts
        (6, 0, 100, "c", 100, 200, "+", 60), (6, 100, 200, "c", 1050, 950, "-", 60),  # a reverse one must be inside, and the first isn't around it
        (7, 0, 100, "c", 100, 200, "+", 60), (7, 100, 150, "c", 400, 450, "+", 5), (7, 150, 250, "c", 900, 1000, "+", 60),  # around a bad one, same strand
        (8, 0, 100, "c", 100, 200, "+", 60), (8, 100, 150, "c", 400, 450, "+", 5), (8, 150, 250, "c", 252, 230, "-", 60),  # other strand, no gap
    )
    from helixmill.operators import calling

    assert [(r.read_id, r.i, r.j) for r in calling.pairs_within(a, own).orderBy("read_id").collect()] == [(2, 0, 1), (3, 0, 1), (5, 0, 1), (7, 0, 2)]


def test_pairs_between_two_intervals(spark):
    from helixmill.operators import calling

    link = spark.createDataFrame([(1, "c", 0, 999, "d", 0, 999), (2, "c", 0, 999, "e", 0, 9)], "link_id int, chrom_n string, start_n long, end_n long, chrom_o string, start_o long, end_o long")
    a = aln(
        spark,
        (1, 0, 100, "c", 100, 200, "+", 60), (1, 100, 200, "d", 100, 200, "+", 60),
        (2, 0, 100, "d", 100, 200, "+", 60), (2, 50, 99, "x", 1, 9, "+", 3), (2, 100, 200, "c", 200, 100, "-", 60),
        (3, 0, 100, "c", 100, 200, "+", 60), (3, 100, 200, "c", 500, 600, "+", 60),
        (4, 0, 200, "c", 100, 200, "+", 60), (4, 90, 200, "d", 100, 200, "+", 60),  # overlap on the read
        (5, 0, 100, "c", 100, 200, "+", 60), (5, 100, 200, "d", 100, 200, "+", 19),
    )
    assert [(r.link_id, r.read_id, r.i, r.j) for r in calling.pairs_between(a, link).orderBy("read_id").collect()] == [(1, 1, 0, 1), (1, 2, 0, 2)]


def test_small_deletions(spark):
    from helixmill.operators import calling

    r = spark.createDataFrame([(1, "c", 1000, "100M700D50M600D5M", 60), (2, "c", 1000, "100M700D50M", 19), (3, "c", 90_000, "100M700D50M", 60)], "read_id long, chrom string, pos long, cigar string, mapq int")
    i = spark.createDataFrame([("c", 0, 1500), ("c", 1800, 9000)], "chrom string, start long, end long")
    got = [(x.read_id, x.pos_a, x.strand_a, x.pos_b, x.strand_b) for x in calling.small_deletions(r, i).collect()]
    assert got == [(1, 1800, "-", 1100, "+")] * 2  # once for each interval


def test_refinement_breaks_and_clamps(spark):
    seg = spark.createDataFrame([("c", k, k * 400_000, k * 400_000 + 399_999, 9.0 if k == 9 else 2.0) for k in range(12)], "chrom string, seg_idx long, seg_start long, seg_end long, cn double")
    ends = spark.createDataFrame([(1, "c", 50_000), (1, "c", 250_000), (1, "c", 700_000), (1, "c", 3_650_000), (2, "c", 4_799_000)], "g int, chrom string, pos long")
    got = rows_of(expand.refined(ends, seg, ["g"]))
    # 50,000 and 250,000 stay together, 700,000 is over 300,000 off; an amplified end takes its segment; all stay on segments
    assert got == [(1, "c", 0, 350_000), (1, "c", 600_000, 800_000), (1, "c", 3_500_000, 4_099_999), (2, "c", 4_699_000, 4_799_999)]


def test_called_search_finds_the_linked_interval(spark):
    seg = spark.createDataFrame([("c", k, k * 100_000, k * 100_000 + 99_999, 2.0) for k in range(60)], "chrom string, seg_idx long, seg_start long, seg_end long, cn double")
    a = aln(spark, *[x for k in range(4) for x in ((k, 0, 100, "c", 1_020_000, 1_050_000, "+", 60), (k, 100, 200, "c", 4_030_000, 4_060_000, "+", 60))])
    seeds = spark.createDataFrame([("c", 1_000_000, 1_099_999)], "chrom string, start long, end long")
    h = reads.segment_hits(a, seg)
    hits = h.select("read_id", "chrom", F.explode(F.array("idx_start", "idx_end")).alias("idx")).distinct()
    got = rows(expand.search(seeds, hits, seg, 3, alignments=a))
    # the second interval leads back to the first, whose surroundings are new to it
    assert got == [("c", 950_000, 1_150_000), ("c", 3_930_000, 4_130_000)]


def test_read_paths(spark):
    from helixmill.operators import readpaths

    seq = readpaths.number_edges(spark.createDataFrame([(1, "c", k * 1000, k * 1000 + 999) for k in range(5)], "amplicon_id long, chrom string, start long, end long"))
    a = spark.createDataFrame([(1, "c", 400, 3600, 60), (2, "c", 600, 2600, 60), (3, "c", 600, 2400, 60), (4, "c", 0, 5000, 5)], "read_id long, chrom string, r_start long, r_end long, mapq int")
    got = rows(readpaths.concordant_paths(a, seq, ["read_id"]).select("read_id", F.array_join("path", ",")))
    assert got == [(1, "e1,c1,e2,c2,e3,c3,e4")]
    s = "read_id long, amplicon_id long, i int, d_idx long, a_idx long, b_idx long, strand1 string, strand2 string, lo1 long, hi1 long, lo2 long, hi2 long"
    steps = spark.createDataFrame([(1, 1, 0, 1, 2, 4, "+", "+", 1, 2, 4, 5), (1, 1, 1, 2, 5, 3, "+", "-", 4, 5, 2, 3), (2, 1, 0, 1, 2, 2, "-", "+", 2, 4, 2, 3), (3, 1, 0, 1, 2, 4, "+", "+", 1, 2, 4, 4), (3, 1, 1, 1, 4, 4, "+", "+", 4, 4, 4, 4)], s)
    got = rows(readpaths.breakpoint_paths(steps).select("read_id", F.array_join("path", ",")))
    assert got == [(1, "e1,c1,e2,d1,e4,c4,e5,d2,e3,c2,e2"), (2, "e4,c3,e3,c2,e2,d1,e2,c2,e3")]


def test_constraints_of_reads_along_edges_and_deletions(spark):
    from helixmill.operators import kernels, readpaths

    seq = readpaths.number_edges(spark.createDataFrame([(1, "c", k * 1000, k * 1000 + 999) for k in range(6)], "amplicon_id long, chrom string, start long, end long"))
    d = spark.createDataFrame([(1, 1, "c", 1999, "+", "c", 4000, "-"), (1, 2, "c", 4999, "+", "c", 1000, "-")], "amplicon_id long, d_idx int, chrom_a string, pos_a long, strand_a string, chrom_b string, pos_b long, strand_b string")
    gap = "gaps array<struct<next_start:bigint,curr_end:bigint>>"
    rows = [
        (1, 0, 100, "c", 200, 1990, "+", 60, 0.0, None), (1, 100, 200, "c", 4010, 5800, "+", 60, 0.0, None),  # e1 e2 | e5 e6
        (2, 0, 100, "c", 5800, 4010, "-", 60, 0.0, None), (2, 100, 200, "c", 1990, 200, "-", 60, 0.0, None),  # the same the other way
        (3, 0, 100, "c", 200, 5800, "+", 60, 0.0, [(4005, 1995)]),  # the same as one alignment with a deletion
        (4, 0, 100, "c", 200, 1990, "+", 60, 0.0, None), (4, 100, 200, "c", 4010, 4990, "+", 60, 0.0, None), (4, 200, 300, "c", 1010, 2900, "+", 60, 0.0, None),  # along both edges
        (5, 0, 200, "c", 200, 1990, "+", 60, 0.0, None), (5, 90, 200, "c", 4010, 4990, "+", 60, 0.0, None), (5, 50, 300, "c", 1010, 2900, "+", 60, 0.0, None),  # overlapping on the read
        (6, 0, 100, "c", 100, 3900, "+", 60, 0.0, None), (7, 0, 100, "c", 100, 1900, "+", 60, 0.0, None),
    ]
    a = spark.createDataFrame(rows, f"{ALN}, {gap}")
    got = {",".join(r.path): r.support for r in readpaths.constraints(a, seq, d).collect()}
    assert got == {"e1,c1,e2,d1,e5,c5,e6": 3, "e1,c1,e2,d1,e5,d2,e2,c2,e3": 1, "e1,c1,e2,c2,e3,c3,e4": 1}
    one = kernels.path_constraints(spark.createDataFrame([(1, "e2,d1,e5")], "amplicon_id long, path string"), seq, d)
    assert sorted((r.kind, r.pos1, r.pos2, r.n) for r in one.collect()) == [("discordant", 1999, 4000, 1), ("sequence", 1000, 1999, 1), ("sequence", 4000, 4999, 1)]


def test_legality_counts_every_edge(spark):
    from helixmill.operators import kernels

    e = [("sequence", "c", 0, "-", "c", 9, "+", 3.0), ("sequence", "c", 10, "-", "c", 19, "+", 2.0), ("concordant", "c", 9, "+", "c", 10, "-", 2.0), ("discordant", "c", 19, "+", "c", 0, "-", 1.0)]
    edges = spark.createDataFrame([(1, *x) for x in e], "amplicon_id long, kind string, chrom1 string, pos1 long, strand1 string, chrom2 string, pos2 long, strand2 string, cn double")
    w = spark.createDataFrame([(1, 1, True, 2.0, 1, "c", 0, 9, "+"), (1, 1, True, 2.0, 2, "c", 10, 19, "+"), (1, 2, False, 0.5, 1, "c", 9, 9, "-"), (1, 2, False, 0.5, 2, "c", 0, 9, "-")], "amplicon_id long, walk int, iscyclic boolean, weight double, ord int, chrom string, start long, end long, strand string")
    got = {(r.kind, r.pos1): (r.taken, r.legal) for r in kernels.legality(edges, w).collect()}
    assert got == {("sequence", 0): (2.5, True), ("sequence", 10): (2.0, True), ("concordant", 9): (2.0, True), ("discordant", 19): (2.0, False)}


def test_islands_across_bins_against_a_plain_merge(spark):
    pick = random.Random(11)
    iv = [("k", s := pick.randint(0, 900), s + pick.choice([1, 5, 30, 200])) for _ in range(70)]
    for pad in (0, 1, 7):
        plain = []
        for _, s, e in sorted(iv, key=lambda x: x[1:]):
            if plain and s <= plain[-1][1] + pad:
                plain[-1][1] = max(plain[-1][1], e)
            else:
                plain.append([s, e])
        df = spark.createDataFrame(iv, "k string, start long, end long")
        got = rows(islands.merge_intervals(df, ["k"], pad, bin_size=50, carry={}).select("start", "end"))
        assert got == [tuple(x) for x in plain]


def test_read_counts(spark):
    i = spark.createDataFrame([("c", 10, 19), ("c", 100, 109)], "chrom string, start long, end long")
    a = spark.createDataFrame([("c", 0, 10), ("c", 0, 11), ("c", 19, 30), ("c", 20, 30)], "chrom string, r_start long, r_end long")
    assert rows(coverage.read_counts(i, a, ["chrom"], 8).select("start", "reads")) == [(10, 2), (100, 0)]


def exploded_broadcasts(df):
    """Broadcasts in the plan, no shuffle between, of rows that an explode made: the planner doesn't know their number."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    found = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(line) or "Exchange hashpartitioning" in lines[j]), len(lines))
            found += [x for x in lines[i:below] if "Generate explode(sequence" in x]
    return found


def test_coverage_broadcasts_no_bins(spark, tmp_path):
    spark.createDataFrame([("chr1", 0, 10_000_000)], "chrom string, start long, end long").write.parquet(f"{tmp_path}/i")
    spark.createDataFrame([("chr1", 5, 25), ("chr1", 100, 300_000)], "chrom string, b_start long, b_end long").write.parquet(f"{tmp_path}/b")
    got = coverage.raw_coverage(spark.read.parquet(f"{tmp_path}/i"), spark.read.parquet(f"{tmp_path}/b"), ["chrom"])
    assert not exploded_broadcasts(got) and [r.bases for r in got.collect()] == [299_920]


def test_overlap_join_broadcasts_no_bins(spark, tmp_path):
    spark.createDataFrame([("chr1", 5, 25), ("chr1", 100, 300_000), ("chr2", 0, 9)], "chrom string, a long, b long").write.parquet(f"{tmp_path}/l")
    spark.createDataFrame([("chr1", 0, 10_000_000)], "chrom string, s long, e long").write.parquet(f"{tmp_path}/r")
    for how, n in (("inner", 2), ("left", 3), ("left_semi", 2)):
        got = joins.range_join(spark.read.parquet(f"{tmp_path}/l"), spark.read.parquet(f"{tmp_path}/r"), ["chrom"], ("a", "b"), ("s", "e"), how=how)
        assert not exploded_broadcasts(got) and got.count() == n


def test_overlap_query_meets_copies_once_and_broadcasts_no_bins(spark, tmp_path, monkeypatch):
    part = [(p, "x", 5) for p in (0, 0, 1, 22)] + [(None, "x", 5)]
    part = spark.createDataFrame(part, "p_partkey long, p_name string, p_size int")
    # reads 0 to 39 on one interval of chr1, each written twice; one more interval there, one on chr2, one where no segment is
    line = [(r, 0, 0, 1, 10.0, 0.05, 0.0, "F") for r in range(40)] * 2 + [(0, 0, 1, 2, 7.0, 0.05, 0.0, "O"), (1, 1, 0, 1, 1.0, 0.05, 0.0, "F"), (2, 2, 0, 1, 1.0, 0.05, 0.0, "F")]
    line += [(3, None, 0, 1, 10.0, 0.05, 0.0, "F"), (4, 0, None, 1, 10.0, 0.05, 0.0, "F")]
    line = spark.createDataFrame(line, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_linestatus string")
    part.write.parquet(f"{tmp_path}/part.parquet")
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    met, join = [], joins.range_join
    monkeypatch.setattr(joins, "range_join", lambda left, *a, **b: met.append(left.where("chrom = 'chr1' and r_start = 100").count()) or join(left, *a, **b))
    got = interval_queries.interval_overlap_join(spark, str(tmp_path))
    assert not exploded_broadcasts(got)
    assert rows(got) == [("chr1", 0, 80, 80), ("chr1", 1, 1, 1), ("chr2", 0, 1, 1)]
    assert met == [1]


def test_subtract_broadcasts_no_bins_and_merges_copies_first(spark, tmp_path):
    spark.createDataFrame([("a", "chr1", 0, 10_000_000), ("b", "chr2", 3, 9)], "id string, chrom string, start long, end long").write.parquet(f"{tmp_path}/l")
    spark.createDataFrame([("chr1", 5, 25)] * 3 + [("chr1", 20, 300_000)], "chrom string, start long, end long").write.parquet(f"{tmp_path}/r")
    right = spark.read.parquet(f"{tmp_path}/r")
    got = islands.subtract(spark.read.parquet(f"{tmp_path}/l"), right, ["chrom"], "id")
    assert not exploded_broadcasts(got)
    assert rows(got) == [("a", "chr1", 0, 4), ("a", "chr1", 300_001, 10_000_000), ("b", "chr2", 3, 9)]
    counted = islands.merge_intervals(right.withColumn("n", F.lit(1)), ["chrom"], 0, {"n": "sum"})
    assert rows(counted) == [("chr1", 5, 300_000, 4)]
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan.split("Window")[-1]


def test_concordant_support_makes_no_pairs(spark, monkeypatch):
    pick = random.Random(3)
    cover = []
    for read in range(60):
        at = pick.randrange(0, 900)
        for _ in range(pick.randrange(1, 6)):  # stretches with gaps narrower and wider than the margin, and some overlap
            end = at + pick.randrange(1, 150)
            cover.append((read, "chr1" if read % 3 else "chr2", at, end))
            at = end + pick.randrange(-20, 40)
    cover += cover[:20] + [(0, "chr1", 5, 5)]
    joints = [(c, p, p + d) for c in ("chr1", "chr2", "chr3") for p in range(0, 1300, 7) for d in ((1, 1, 5)[p % 3],)]
    used = [(pick.randrange(60), pick.choice(["chr1", "chr2"]), pick.randrange(0, 1300)) for _ in range(3000)]
    has = {(r, c, x) for r, c, a, b in cover for x in range(a, b)}
    gone = set(used)

    def count(c, p, q):
        return sum(all((r, c, x) in has for x in (p, q, p - 11, q + 10)) and not {(r, c, p), (r, c, q)} & gone for r in range(60))

    want = sorted((c, p, q, count(c, p, q)) for c, p, q in joints)
    assert sum(w[3] for w in want) > 100
    frames = [spark.createDataFrame(cover, "read_id long, chrom string, r_start long, r_end long"), spark.createDataFrame(used, "read_id long, chrom string, pos long")]
    all_joints = spark.createDataFrame(joints, "chrom string, pos1 long, pos2 long")
    assert rows(graph.concordant_support(all_joints, *frames, margin=10)) == want

    def pairs(*_, **__):
        raise AssertionError("pairs of joints and reads are made")

    monkeypatch.setattr(graph, "range_join", pairs)
    narrow = [w for w in want if w[2] == w[1] + 1]
    assert rows(graph.concordant_support(all_joints.where("pos2 = pos1 + 1"), *frames, margin=10)) == narrow
