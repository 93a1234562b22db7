"""The driver contract: names, columns, and equality with the SQL oracles at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from helixmill import catalog

DATA = "/root/testdata/sf0.001"
CHEAP = ["seed_intervals", "seed_arm_cn", "interval_subtract", "coverage_raw", "read_gap_pairs", "breakpoint_clusters", "graph_stats", "concordant_support", "calls_within", "calls_accepted", "interval_refinement", "amplicon_components", "cycle_to_bed", "fragment_similarity", "plot_layout", "hsr_sites"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def test_names():
    q, o = catalog.queries(), catalog.oracle_sql()
    assert set(o) <= set(q) and "seed_intervals" in q
    assert set(q) <= set(entry.queries()) and set(o) <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["chrom", "start", "end"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", CHEAP)
def test_same_rows_as_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(want.columns) == columns
    rows = lambda df: sorted(tuple(str(round(x, 9) if isinstance(x, float) else x) for x in r) for r in df[columns].itertuples(index=False))
    assert rows(got.toPandas()) == rows(want)


KERNELS = ["cn_fit", "multiplicities", "greedy_cycles", "walk_legality", "euler_walks", "triplet_score", "lcs_score"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", KERNELS)
def test_kernel_queries_run(spark, name):
    rows = catalog.queries()[name](spark, DATA).collect()
    if name == "walk_legality":
        assert all(r.legal for r in rows)
