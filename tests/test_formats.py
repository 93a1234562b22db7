"""Files written and read again."""

import os

from pyspark.sql import functions as F

from helixmill.operators import cycles
from helixmill.sinks import text
from helixmill.sources import genes, graphs, reads, segments, summary
from helixmill.streaming import coverage as streaming


def put(path, body):
    with open(path, "w") as f:
        f.write(body)
    return str(path)


def test_segments(spark, tmp_path):
    cns = put(tmp_path / "a.cns", "chromosome\tstart\tend\tgene\tlog2\n# note\nchr1\t0\t100\t-\t1.0\nchr2\t5\t10\t-\t0.0\n")
    assert [(r.chrom, r.start, r.cn) for r in segments.read_segments(spark, cns).orderBy("ord").collect()] == [("chr1", 0, 4.0), ("chr2", 5, 2.0)]
    bed = put(tmp_path / "a.bed", "chr1\t0\t100\tx\t8\n")
    assert [(r.cn, r.log2_cn) for r in segments.read_segments(spark, bed).collect()] == [(8.0, 2.0)]
    cnr = put(tmp_path / "a.cnr", "chromosome\tstart\tend\tgene\tdepth\tlog2\tweight\nchr1\t0\t10\t-\t1\t0\t1\nchrY\t0\t10\t-\t1\t1\t1\n")
    assert [(r.number, r.cn, r.middle) for r in segments.read_ratios(spark, cnr).collect()] == [(1, 2.0, 5.0), (24, 4.0, 5.0)]


GRAPH = "Sequence edge\tstart\tend\nsequence\tchr6:100-\tchr6:199+\t4.5\t30.2\t100\t7.0\nsource\t0-->chr6:5+\t1\t-1\nconcordant\tchr6:199+->chr6:200-\t2.0\t9\ndiscordant\tchr6:900+->chr6:100-\t3.5\t4\ninterval\tchr6\t1\t2\npath_constraint\te1+:1,c1-:2,e2+:1\t6\n"


def test_graph_files(spark, tmp_path):
    put(tmp_path / "s_amplicon3_graph.txt", GRAPH)
    edges, pcs = graphs.read_graphs(spark, str(tmp_path / "*_graph.txt"))
    got = [(r.amplicon_id, r.kind, r.chrom1, r.pos1, r.strand1, r.pos2, r.strand2, r.cn, r.reads) for r in edges.orderBy("kind").collect()]
    assert got == [(3, "concordant", "chr6", 199, "+", 200, "-", 2.0, 9), (3, "discordant", "chr6", 900, "+", 100, "-", 3.5, 4), (3, "sequence", "chr6", 100, "-", 199, "+", 4.5, 7)]
    p = pcs.collect()[0]
    assert (p.support, [tuple(x) for x in p.path]) == (6, [("e1", "+", 1), ("c1", "-", 2), ("e2", "+", 1)])
    ends = spark.createDataFrame([(3, "chr6", 100, "-", 1.5)], "amplicon_id long, chrom string, pos long, strand string, cn double")
    lines = text.graph_lines(edges.withColumn("bases", F.lit(3020)), pcs, ends)
    text.write_graphs(lines, str(tmp_path / "out"))
    body = [x for f in os.listdir(tmp_path / "out" / "amplicon_id=3") if f.startswith("part") for x in open(tmp_path / "out" / "amplicon_id=3" / f).read().splitlines()]
    assert body == [
        "#helixmill 1.0.0", "SequenceEdge: StartPosition, EndPosition, PredictedCN, AverageCoverage, Size, NumberOfLongReads", "sequence\tchr6:100-\tchr6:199+\t4.5\t30.2\t100\t7",
        "BreakpointEdge: StartPosition->EndPosition, PredictedCN, NumberOfLongReads", "source\t0-->chr6:100-\t1.5\t-1", "concordant\tchr6:199+->chr6:200-\t2.0\t9",
        "discordant\tchr6:100-->chr6:900+\t3.5\t4", "PathConstraint: Path, Support", "path_constraint\te1+:1,c1-:2,e2+:1\t6",
    ]
    again, _ = graphs.read_graphs(spark, put(tmp_path / "t_amplicon3_graph.txt", "\n".join(body) + "\n"))
    assert again.count() == 3 and [(r.amplicon_id, r.max_cn) for r in graphs.most_copies(again).collect()] == [(3, 5.5)]
    low = graphs.ends_by_name(edges).where("kind = 'discordant'").first()
    assert (low.pos1, low.strand1, low.pos2, low.strand2) == (100, "-", 900, "+")
    assert '"kind":"sequence"' in text.model_text(edges, pcs).first().value


def test_cycles_files(spark, tmp_path):
    w = spark.createDataFrame([(2, 1, True, 6.5), (2, 2, False, 1.25)], "amplicon_id long, rank int, iscyclic boolean, weight double")
    s = spark.createDataFrame([(2, 1, 1, "chr1", 100, 199, "+"), (2, 1, 2, "chr1", 0, 99, "-"), (2, 2, 1, "chr1", 0, 99, "+")], "amplicon_id long, rank int, ord int, chrom string, start long, end long, strand string")
    i = spark.createDataFrame([(2, "chr1", 0, 199)], "amplicon_id long, chrom string, start long, end long")
    c = spark.createDataFrame([(2, 0, [("e1", "+", 1), ("c1", "+", 1), ("e2", "+", 1)], 4), (2, 1, [("e2", "+", 1)], 3)], "amplicon_id long, pc_idx int, path array<struct<edge:string,strand:string,n:int>>, support long")
    met = w.withColumn("satisfied", F.when(F.col("rank") == 1, F.array(F.lit(2))).otherwise(F.array().cast("array<int>")))
    body = "\n".join(r.line for r in text.cycle_lines(met, s, intervals=i, constraints=c).orderBy("section", "place").collect())
    assert body.split("\n") == [
        "#helixmill-greedy 1.0.0", "Interval\t1\tchr1\t0\t199", "List of cycle segments", "Segment\t1\tchr1\t0\t99", "Segment\t2\tchr1\t100\t199", "List of longest subpath constraints",
        "Path constraint 1\te1+:1,c1+:1,e2+:1\tSupport=4\tUnsatisfied", "Path constraint 2\te2+:1\tSupport=3\tSatisfied", "List of extracted cycles/paths",
        "Cycle=1;Copy_count=6.5;Segments=2+,1-;Path_constraints_satisfied=2", "Path=2;Copy_count=1.25;Segments=0+,1+,0-;Path_constraints_satisfied=",
    ]
    put(tmp_path / "s_amplicon2_cycles.txt", body + "\n")
    assert [tuple(r) for r in graphs.read_intervals(spark, str(tmp_path / "*_cycles.txt")).collect()] == [(2, "chr1", 0, 199)]
    walks, steps = graphs.read_cycles(spark, str(tmp_path / "*_cycles.txt"))
    assert [(r.cycle_id, r.iscyclic, r.weight) for r in walks.orderBy("cycle_id").collect()] == [(1, True, 6.5), (2, False, 1.25)]
    assert [(r.cycle_id, r.ord, r.start, r.strand) for r in steps.orderBy("cycle_id", "ord").collect()] == [(1, 1, 100, "+"), (1, 2, 0, "-"), (2, 1, 0, "+")]
    bed = cycles.to_bed(steps, walks)
    text.write_bed(bed, str(tmp_path / "bed"), "chrom", "start", "end", "strand", "cycle_id", "iscyclic", "weight")
    assert spark.read.csv(str(tmp_path / "bed"), sep="\t").count() == 3


STATS = "amplicon_id long, n_chromosomes long, n_sequence long, n_concordant long, n_discordant long, n_nonsource long, n_source long"
SOLVED = "amplicon_id long, solved boolean, model string, k int, alpha double, total_weights double, resolution double, n_constraints int, gap double, bound double, iscyclic boolean, walk string"


def test_summaries(spark, tmp_path):
    for n in range(3):
        for profiled in (False, True):
            stats = spark.createDataFrame([(k, 1, 7, 6, 1234, 1247, 4) for k in range(1, n + 1)], STATS)
            own = spark.createDataFrame([(k, "chr1", 1000, 2_001_999) for k in range(1, n + 1)], "amplicon_id long, chrom string, start long, end long")
            solved = spark.createDataFrame([(1, True, "greedy", 10, 0.01, 45.5, 0.1, 3, 2.5, 7.0, True, "Cycle=1;Copy_count=6.5;Segments=1+")][:n], SOLVED)
            usage = [("build", 1.5, 3600.0), ("solve/1", 0.5, 1800.0)] if profiled else None
            body = text.summary_text(text.amplicon_summaries(stats, own, solved), 60, ("greedy", 4, 7200) if profiled else None, usage)
            path = put(tmp_path / f"run{n}{profiled}_summary.txt", body)
            r = summary.read_runs(spark, path).first()
            assert (r.program, r.version, r.profiled, r.n_graphs, r.n_solved) == ("helixmill", "1.0.0", profiled, n, min(n, 1))
            assert (r.solver, r.threads, r.time_limit) == (("greedy", 4, 7200) if profiled else (None, None, None))
            got = [(a.amplicon, a["size"], a.n_breakpoints, a.status, a.model, a.alpha, a.n_constraints, a.suboptimal, a.gap) for a in summary.read_amplicons(spark, path).orderBy("amplicon").collect()]
            assert got == [(1, 2_001_000, 1234, "SUCCESS", "greedy", 0.01, 3, True, 2.5), (2, 2_001_000, 1234, "UNPERFORMED", None, None, None, False, None)][:n]
            assert [(u.n_calls, u.hours, u.peak_gb) for u in summary.usage(summary.read_resources(spark, path)).collect()] == ([(2, 1.5, 1.5)] if profiled else [])
    assert "1/2 amplicons solved.\nRuntime Limit: 60 s\n" in body and "\tAmplicon 1 > chr1:1,000-2,001,999\n" in body and "\tHeaviest graph walk solved was a cycle.\n\tCycle=1;" in body
    # a run that was interrupted has sections and nothing after them
    cut = put(tmp_path / "cut_summary.txt", body.split("Solver Settings:")[0].rsplit("-----", 1)[0].rstrip("-\n") + "\n")
    assert summary.read_runs(spark, cut).first().n_graphs == 2


def test_usage_of_calls():
    from helixmill.profiling import Usage

    u = Usage()
    work = u.profiled(lambda: sum(range(1000)), counted=True)
    work(), work()
    assert [c for c, _, _ in u.calls] == ["<lambda>/1", "<lambda>/2"] and all(gb > 0 and s >= 0 for _, gb, s in u.calls)


def test_scores(spark, tmp_path):
    from helixmill.sources import simulated

    sim = simulated.read_simulated(spark, put(tmp_path / "sim.txt", "foldback\tbp20\t50x\tamplicon5\nepisomal\tbp10\t250x\tamplicon4\n"))
    assert [tuple(r) for r in sim.orderBy("amplicon").collect()] == [("episomal_bp10_amplicon4", "episomal", 10, 250, 4), ("foldback_bp20_amplicon5", "foldback", 20, 50, 5)]
    s = spark.createDataFrame([("foldback_bp20_amplicon5", 4, 3), ("x", 0, 0)], "amplicon string, n_breakpoint_edges long, n_breakpoint_edges_covered long")
    text.write_scores(simulated.with_class(s, sim), str(tmp_path / "scores"))
    got = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "scores")).orderBy("amplicon").collect()
    assert [(r.coverage, r.breakpoint_accuracy, r.breakpoint_class) for r in got] == [("50", "0.75", "foldback"), (None, None, "x")]


def test_scans_are_kept(spark, tmp_path):
    source = put(tmp_path / "a.bin", "one")
    files, calls = lambda: spark.read.format("binaryFile").load(source), []
    scan = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert reads.cached(spark, files(), scan, str(tmp_path / "kept")).count() == 3
    put(tmp_path / "a.bin", "another")
    reads.cached(spark, files(), scan, str(tmp_path / "kept"))
    assert len(calls) == 2


def test_reads(spark, tmp_path):
    sam = put(tmp_path / "a.sam", "@SQ\tSN:chr1\tLN:1000\n@SQ\tSN:weird\tLN:5\nr1\t0\tchr1\t11\t60\t5M\t*\t0\t0\tACGTA\t*\tNM:i:1\tSA:Z:chr2,5,+,2S3M,60,0;\nr2\t256\tchr1\t11\t60\t5M\t*\t0\t0\t*\t*\tSA:Z:chr2,5,+,2S3M,60,0;\n")
    rec = reads.read_sam(spark, sam)
    assert [(r.read_id, r.start, r.nm, r.has_seq) for r in rec.orderBy("read_id").collect()] == [("r1", 10, 1, True), ("r2", 10, None, False)]
    assert [r.read_id for r in reads.chimeric_tags(rec).collect()] == ["r1"]
    assert [r.read_id for r in reads.counts_for_coverage(rec).collect()] == ["r1"]
    assert [tuple(r) for r in reads.header_contigs(spark, sam).collect()] == [("chr1", 1000)]
    more = reads.read_contig_list(spark, put(tmp_path / "more.txt", "# virus\nweird 7\n\n"))
    assert sorted(tuple(r) for r in reads.header_contigs(spark, sam, more).collect()) == [("chr1", 1000), ("weird", 5)]
    fq = put(tmp_path / "a.fastq", "@q1 x\nACGT\n+\nIIII\n@q2\nAC\n+\n!!\n@q3\nAC\n+\n@I\n@q4\nA\n+q4\nI\n")
    assert [tuple(r) for r in reads.read_fastq(spark, fq).orderBy("read_id").collect()] == [("q1", 4, 40.0), ("q2", 2, 0.0), ("q3", 2, 35.5), ("q4", 1, 40.0)]


def test_genes(spark, tmp_path):
    row = "0\tNM\tchr1\t+\t10\t50\t10\t50\t2\t10,40,\t20,50,\t0\t{}\tcmpl\tcmpl\t0,0,\n"
    path = put(tmp_path / "ref.txt", row.format("MYC") + row.format("LINC1") + row.format("MYC"))
    got = genes.first_transcripts(genes.read_refgene(spark, path)).collect()
    assert [(g.gene, g.start, [tuple(e) for e in g.exons]) for g in got] == [("MYC", 10, [(10, 20), (40, 50)])]
    names = put(tmp_path / "list.txt", "MYC, EGFR\nMYC\tMDM2\n")
    assert [r.gene for r in genes.read_gene_list(spark, names).orderBy("ord").collect()] == ["MYC", "EGFR", "MDM2"]
    both = genes.merge_gene_lists(spark, ["TP53", "EGFR", "TP53"], genes.read_gene_list(spark, names))
    assert [r.gene for r in both.orderBy("ord").collect()] == ["TP53", "EGFR", "MYC", "MDM2"]
    a = 'gene_id "{0}"; transcript_id "{0}.{1}"; gene_biotype "{2}";'
    gtf = spark.createDataFrame([("NC1", "exon", 11, 20, "+", a.format("G", 1, "protein"), 1), ("NC1", "exon", 1, 5, "+", a.format("G", 1, "protein"), 2), ("NC1", "exon", 1, 90, "+", a.format("G", 2, "protein"), 3), ("NC1", "exon", 1, 5, "+", a.format("P", 1, "pseudogene"), 4)], "seqname string, feature string, start long, end long, strand string, attributes string, ord long")
    acc = spark.createDataFrame([("NC1", "chr1")], "accession string, chrom string")
    assert [tuple(r) for r in genes.gtf_to_refgene(gtf, acc).collect()] == [("G", "chr1", "+", 0, 20, "0,10,", "5,20,")]


def test_streaming_equals_batch(spark, tmp_path):
    import datetime as d

    at = lambda m: d.datetime(2024, 1, 1, 0, 0) + d.timedelta(minutes=m)
    rows = [(at(0), 1, "a", 1.0), (at(20), 1, "a", 2.0), (at(70), 2, "b", 3.0), (at(90), 1, "a", 4.0)]
    df = spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string, value double")
    df.write.parquet(str(tmp_path / "ev"))
    want = sorted(map(tuple, streaming.windowed(df).collect()))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    q = streaming.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("w1").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w1").collect())) == want
    assert sorted(r.n for r in streaming.sessions(df).collect()) == [1, 1, 2]
