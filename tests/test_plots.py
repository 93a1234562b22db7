"""Plot geometry and other small operators on inputs worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from helixmill.operators import components, cycles, geometry, graph, paths, reads, scoring
from helixmill.solve import walks


def test_fonts_widths_and_arcs(spark):
    assert geometry.gene_font_size(1.5) == 18.0 and geometry.text_scale(0.5) == 1.0 and geometry.text_scale(9) == 2.0
    for bad in (-1, math.inf, math.nan):
        with pytest.raises(ValueError):
            geometry.gene_font_size(bad)
    h = spark.createDataFrame([(0.0, 100.0, 4.0), (50.0, 100.0, 4.0), (500.0, 100.0, 4.0), (50.0, 0.0, 0.0)], "d double, w double, c double")
    assert [r[0] for r in h.select(geometry.arc_height(F.col("d"), F.col("w"), F.col("c"))).collect()] == [5.0, 6.5, 8.0, 2.0]


def test_axes_grow_alike(spark):
    sums = spark.createDataFrame([(40.0, 4.0, 20.0, 200.0, 0.0), (40.0, 4.0, 20.0, 200.0, 10.0), (0.0, 3.0, 0.0, 0.0, 0.0)], "max_coverage double, max_cn double, cn_squares double, cn_coverage double, max_apex double")
    got = [(r.coverage_ymax, r.cn_ymax, r.expansion) for r in geometry.axis_limits(sums).collect()]
    assert [tuple(round(x, 9) for x in g) for g in got] == [(50.0, 5.0, 1.0), (105.0, 10.5, 2.1), (1.0, 3.75, 1.0)]
    assert geometry.axis_limits(sums, cutoff=20.0).first().coverage_ymax == 20.0


def laid(spark):
    return spark.createDataFrame([(1, "c", 0, 49, 0.0, 50.0), (1, "d", 0, 49, 51.5, 101.5)], "amplicon_id long, chrom string, start long, end long, x1 double, x2 double")


def test_separators_arcs_and_regions(spark):
    own = laid(spark).unionByName(spark.createDataFrame([(1, "d", 90, 99, 103.0, 113.0)], laid(spark).schema))
    assert sorted(tuple(r) for r in geometry.separators(own, "amplicon_id").collect()) == [(1, 50.75, "chromosome"), (1, 102.25, "interval")]
    e = spark.createDataFrame([(1, "c", 10, "+", "d", 20, "-", 8), (1, "c", 10, "-", "c", 20, "+", 2), (1, "x", 1, "+", "c", 2, "+", 9)], "amplicon_id long, chrom1 string, pos1 long, strand1 string, chrom2 string, pos2 long, strand2 string, reads long")
    top = spark.createDataFrame([(1, 4.0)], "amplicon_id long, cn double")
    got = {r.strands: r for r in geometry.arcs(e, laid(spark), "amplicon_id", top).collect()}
    assert set(got) == {"+-", "-+"} and got["+-"].colour == "red" and (got["+-"].x_from, got["+-"].x_to) == (10.0, 71.5)
    assert round(got["+-"].height, 6) == round(4 * (1.25 + 0.75 * 61.5 / 104.5), 6)
    assert [r.strands for r in geometry.arcs(e, laid(spark), "amplicon_id", region="d:1-30").collect()] == ["+-"]
    assert geometry.in_region(e, "c:1-15", "chrom1", "pos1", "pos1").count() == 2
    with pytest.raises(ValueError):
        geometry.in_region(e, "nonsense")
    assert [t for _, _, t in geometry.legend()][-1] == "Discordant edge interchromosomal"


def lines(df, **where):
    rows = [r for r in df.orderBy("ord").collect() if all(r[k] == v for k, v in where.items())]
    return [(r.x_from, r.y_from, r.x_to, r.y_to) for r in rows]


def test_connectors(spark):
    s = spark.createDataFrame(
        [
            (1, 1, True, 1, "c", 0, 9, "+", 4.0), (1, 1, True, 2, "c", 20, 29, "+", 3.0), (1, 1, True, 3, "c", 10, 19, "-", 5.0),
            (1, 2, False, 1, "c", 30, 39, "+", 2.0), (1, 2, False, 2, "c", 0, 9, "+", 2.0), (1, 3, True, 1, "c", 5, 9, "+", 1.0),
        ],
        "amplicon_id long, cycle_id long, iscyclic boolean, ord int, chrom string, start long, end long, strand string, cn double",
    )
    b = geometry.stacked(geometry.cycle_blocks(s.withColumn("length", F.col("end") - F.col("start") + 1), laid(spark), "amplicon_id"), "amplicon_id")
    assert [(r.cycle_id, r.ord, r.y, r.top, r.bottom) for r in b.orderBy("cycle_id", "ord").collect()] == [(1, 1, -2, -2, -4), (1, 2, -2, -2, -4), (1, 3, -4, -2, -4), (2, 1, -8, -8, -10), (2, 2, -10, -8, -10), (3, 1, -14, -14, -14)]
    c = geometry.connectors(b, "amplicon_id")
    assert lines(c, cycle_id=1, part="between", ord=1) == [(9.0, -1.5, 20.0, -1.5)]  # straight on
    assert lines(c, cycle_id=1, part="between", ord=2) == [(29.0, -1.5, 30.5, -1.5), (30.5, -1.5, 30.5, -3.5), (30.5, -3.5, 19.0, -3.5)]  # around the further end
    assert lines(c, cycle_id=1, part="closing") == [(0.0, -1.5, -3.0, -1.5), (-3.0, -1.5, -3.0, -3.5), (-3.0, -3.5, 10.0, -3.5)]
    assert lines(c, cycle_id=2, part="head") == [(27.0, -7.5, 30.0, -7.5)] and lines(c, cycle_id=2, part="tail") == [(9.0, -9.5, 12.0, -9.5)]
    assert lines(c, cycle_id=2, part="between")[0] == (39.0, -7.5, 40.5, -7.5) and len(lines(c, cycle_id=2, part="between")) == 5  # back in the gap
    assert lines(c, cycle_id=3, part="closing")[1] == (3.5, -13.5, 3.5, -14.5)  # one block: one extension beyond it
    got = {r.cycle_id: (r.y, r.separator, r.label) for r in geometry.cycle_labels(b, "amplicon_id").collect()}
    assert got[1] == (-3.0, -6, "cycle 1:\nCN = 3.00\nweighted-CN = 1.20e+02") and got[2][2].startswith("path 2:")
    assert [r.cycle_id for r in geometry.first_cycles(s.select("cycle_id", "iscyclic").distinct(), 2, True).collect()] == [1]


def test_plot_data_has_all_tables(spark):
    i = spark.createDataFrame([(1, "c", 0, 49), (1, "d", 0, 49)], "amplicon_id long, chrom string, start long, end long")
    e = spark.createDataFrame([(1, "sequence", "c", 0, "-", "c", 49, "+", 4.0, 9, 500), (1, "discordant", "c", 10, "+", "d", 20, "-", 2.0, 5, 0)], "amplicon_id long, kind string, chrom1 string, pos1 long, strand1 string, chrom2 string, pos2 long, strand2 string, cn double, reads long, bases long")
    c = spark.createDataFrame([(1, 1, True, 1, "c", 0, 49, "+", 4.0)], "amplicon_id long, cycle_id long, iscyclic boolean, ord int, chrom string, start long, end long, strand string, cn double")
    g = spark.createDataFrame([("G", "c", 10, 20)], "gene string, chrom string, start long, end long")
    got = geometry.plot_data("amplicon_id", i, e, c, g)
    assert {k: df.count() for k, df in got.items()} == {"intervals": 2, "bars": 1, "coverage": 1, "separators": 1, "ticks": 6, "arcs": 1, "axes": 1, "genes": 1, "blocks": 1, "connectors": 5, "labels": 1}
    x = spark.createDataFrame([("G", "c", [(0, 20), (45, 60), (70, 80)])], "gene string, chrom string, exons array<struct<s:long,e:long>>")
    assert sorted((r.start, r.end) for r in geometry.exons(x, i).collect()) == [(0, 20), (45, 49)]


def test_rotation(spark):
    s = "cycle_id long, ord int, chrom string, start long, end long, strand string, iscyclic boolean, weight double"
    rows = [(1, 1, "chr2", 5, 9, "+"), (1, 2, "chr1", 0, 4, "+"), (1, 3, "chr1", 20, 24, "-"), (2, 1, "chr1", 9, 10, "+"), (2, 2, "chr1", 0, 4, "-"), (2, 3, "chr1", 5, 6, "+"), (3, 1, "chr2", 0, 4, "+"), (3, 2, "chr1", 0, 4, "-")]
    df = spark.createDataFrame([(*r, r[0] < 3, 1.0) for r in rows], s)
    got = [(r.cycle_id, r.chrom, r.start, r.strand) for r in cycles.rotate_to_least(df).orderBy("cycle_id", "ord").collect()]
    assert got == [(1, "chr1", 0, "+"), (1, "chr1", 20, "-"), (1, "chr2", 5, "+"), (2, "chr1", 0, "+"), (2, "chr1", 9, "-"), (2, "chr1", 5, "-"), (3, "chr1", 0, "+"), (3, "chr2", 0, "-")]


def test_faults_of_graphs(spark):
    seq = spark.createDataFrame([(1, "c", 0, 9), (1, "c", 10, 19), (1, "c", 15, 30), (1, "d", 9, 3)], "amplicon_id long, chrom string, start long, end long")
    con = spark.createDataFrame([(1, "c", 9, 10), (1, "c", 19, 21)], "amplicon_id long, chrom string, pos1 long, pos2 long")
    dis = spark.createDataFrame([(1, "c", 19, "+", "c", 0, "-"), (1, "c", 7, "+", "c", 0, "-")], "amplicon_id long, chrom_a string, pos_a long, strand_a string, chrom_b string, pos_b long, strand_b string")
    got = sorted((r.kind, r.fault) for r in graph.faults(seq, con, dis).collect())
    assert got == [("concordant", "has an end at no piece"), ("concordant", "its ends aren't neighbours"), ("discordant", "has an end at no piece"), ("sequence", "ends before it starts"), ("sequence", "overlaps another")]


def test_small_predicates(spark):
    df = spark.createDataFrame([("c", 100, "+", "d", 5, "-", "c", 299, "+", "d", 5, "-"), ("c", 100, "+", "d", 5, "-", "c", 300, "+", "d", 5, "-")], ", ".join(f"{p}_{c} {k}" for p in "xy" for c, k in (("chrom_a", "string"), ("pos_a", "long"), ("strand_a", "string"), ("chrom_b", "string"), ("pos_b", "long"), ("strand_b", "string"))))
    assert [r[0] for r in df.select(reads.is_close("chrom_a", "pos_a", "strand_a", "chrom_b", "pos_b", "strand_b")).collect()] == [True, False]
    p = spark.createDataFrame([([("e2", "+"), ("c2", "-"), ("e2", "+")],)], "p array<struct<edge:string,strand:string>>")
    assert p.select(paths.as_text(F.col("p"))).first()[0] == "e2+:2,c2-:1,e2+:2"
    o = spark.createDataFrame([(1, 1, 2, 5, 9), (1, 2, 1, 9, 9), (1, 3, 1, 8, 9), (1, 4, 1, 8, 3)], "walk int, candidate int, n_paths int, length int, support int")
    assert paths.longest_unsatisfied(o, ["walk"]).first().candidate == 4
    assert walks.needs_greedy(101, 10, 0, 10) and not walks.needs_greedy(50, 20, 3, 10) and walks.needs_greedy(90, 60, 0, 40)
    c = spark.createDataFrame([(1, "c", 0, 100, True, 6.0), (2, "c", 0, 50, True, 6.0)], "cycle_id long, chrom string, start long, end long, iscyclic boolean, weight double")
    e = spark.createDataFrame([(6.0, 0, 200)], "cn double, start long, end long")
    assert [scoring.top_ratio(c, e, n).first().ratio for n in (1, 2, 3)] == [0.5, 1.0, 1.0]


def test_touching_intervals_take_their_connections(spark):
    i = spark.createDataFrame([(0, 7, "c", 0, 9), (1, 5, "c", 10, 19), (2, 6, "c", 30, 39)], "interval_id long, amplicon_id long, chrom string, start long, end long")
    c = spark.createDataFrame([(0, 2, [4]), (2, 1, [3, 4]), (0, 1, [9])], "interval_a long, interval_b long, breakpoints array<int>")
    merged, links = components.merge_touching(i, c)
    assert sorted(tuple(r) for r in merged.collect()) == [(0, 5, "c", 0, 19), (2, 6, "c", 30, 39)]
    assert sorted((r.interval_a, r.interval_b, r.breakpoints) for r in links.collect()) == [(0, 0, [9]), (0, 2, [3, 4])]


def test_plot_layout_orders_by_interval_as_its_sql(spark, tmp_path):
    """On chromosomes of over 10,000 segments the numbers of intervals aren't in genomic order."""
    import duckdb

    from helixmill import catalog

    seg = [(1, 15_000, 30), (1, 3, 40), (2, 1, 50), (2, 2, 50), (3, 0, 25), (3, 12_000, 10)]
    parts = [(22 * idx + chrom - 1, size) for chrom, idx, size in seg]
    spark.createDataFrame(parts, "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = catalog.queries()["plot_layout"](spark, str(tmp_path)).orderBy("interval_id").collect()
    want = con.sql(f"select interval_id, x1, x2 from ({catalog.oracle_sql()['plot_layout']}) order by 1").fetchall()
    assert [tuple(r) for r in got] == want and len(want) == 4
