"""The kernels against brute force and their invariants; no Spark."""

import itertools
import random
from collections import Counter

import numpy as np

from helixmill.operators.clustering import call, first_fit, match_one, peel
from helixmill.solve import compare, copynumber, multiplicity, walks


def test_assignment_is_least():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n = int(rng.integers(1, 6))
        k = n + int(rng.integers(0, 3))
        cost = rng.integers(0, 50, (n, k)).astype(float)
        found = compare.assignment(cost)
        least = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(k), n))
        assert len(set(found)) == n
        assert sum(cost[i, c] for i, c in enumerate(found)) == least


def test_common_subsequence_is_largest():
    pick = random.Random(1)
    for _ in range(80):
        a, b = ([(pick.choice("xyz"), "+") for _ in range(pick.randint(0, 6))] for _ in range(2))
        size = {"x": 3, "y": 5, "z": 7}
        best = 0
        for r in range(len(a) + 1):
            for c in itertools.combinations(range(len(a)), r):
                own = [a[k] for k in c]
                it = iter(b)
                if all(x in it for x in own):
                    best = max(best, sum(size[x[0]] for x in own))
        assert compare.common_subsequence(a, b, size) == best


def test_cycle_overlap_ignores_rotation_and_strand():
    size = {1: 10, 2: 20, 3: 30}
    c = [(1, "+"), (2, "-"), (3, "+")]
    turned = [(s, "+" if d == "-" else "-") for s, d in reversed(c)]
    assert compare.cycle_overlap(c, c[1:] + c[:1], size) == 60
    assert compare.cycle_overlap(c, turned, size) == 60


def test_triplets():
    t = [("chr1", k * 100, k * 100 + 50, "+") for k in range(4)]
    assert compare.triplet_share(t, t) == 1.0
    assert compare.triplet_share(t, t[2:] + t[:2]) == 1.0
    assert compare.triplet_share(t, [("chr1", a, b, "-") for _, a, b, _ in reversed(t)]) == 1.0
    assert compare.triplet_share(t, []) == 0.0


def brute_multiplicities(reads):
    """All cuts, fewest clusters first."""
    order = sorted(range(len(reads)), key=lambda k: reads[k])
    c = [float(reads[k]) for k in order]
    n = len(c)
    for k in range(1, n + 1):
        best = None
        for cut in itertools.combinations(range(1, n), k - 1):
            ends = [0, *cut, n]
            scores = [multiplicity.cluster_score(c[a:b], 5) for a, b in zip(ends, ends[1:])]
            if all(scores):
                s = sum(x[1] for x in scores) + sum(np.log2(c[e]) - np.log2(c[e - 1]) for e in cut)
                if best is None or s > best + 1e-12:
                    best = s
        if best is not None:
            return k, best
    return None


def best_multiplicities(reads, k, score):
    """The multiplicities of every cut into k valid clusters that reaches the score."""
    order = sorted(range(len(reads)), key=lambda x: reads[x])
    c, n, out = [float(reads[x]) for x in order], len(reads), []
    for cut in itertools.combinations(range(1, n), k - 1):
        ends = [0, *cut, n]
        scores = [multiplicity.cluster_score(c[a:b], 5) for a, b in zip(ends, ends[1:])]
        if all(scores) and abs(sum(x[1] for x in scores) + sum(np.log2(c[e]) - np.log2(c[e - 1]) for e in cut) - score) < 1e-9:
            found = [0] * n
            for (a, b), (size, _) in zip(zip(ends, ends[1:]), scores):
                mean = sum(c[a : a + size]) / size
                for x in range(a, b):
                    found[order[x]] = 1 if x < a + size else max(2, int(np.floor(c[x] / mean + 0.5)))
            out.append(found)
    return out


def test_multiplicities_use_fewest_clusters():
    assert multiplicity.multiplicities([]) == []
    assert multiplicity.multiplicities([5, 6, 7]) == [1, 1, 1]
    assert multiplicity.multiplicities([10, 20, 11, 21, 30]) == [1, 2, 1, 2, 3]
    pick = random.Random(2)
    for _ in range(60):
        reads = [pick.randint(1, 60) for _ in range(pick.randint(1, 7))]
        found = multiplicity.multiplicities(reads)
        assert len(found) == len(reads) and all(1 <= m <= 5 for m in found)
        if max(reads) >= 2 * min(reads):
            n, score = brute_multiplicities(reads)
            # the cut that was chosen: multiplicities fall where a new cluster begins, so its score is among the best
            assert found in best_multiplicities(reads, n, score)


def test_copy_numbers_balance():
    cov = 10.0
    n = lambda p, s: ("chr1", p, s)
    seq = [(n(0, "-"), n(99, "+")), (n(100, "-"), n(199, "+")), (n(200, "-"), n(299, "+"))]
    joints = [(n(99, "+"), n(100, "-")), (n(199, "+"), n(200, "-"))]
    back = [(n(199, "+"), n(100, "-"))]
    ends = {n(0, "-"), n(299, "+")}
    cn = copynumber.fit(seq, [100, 100, 100], [1000.0, 5000.0, 1000.0], joints, [10, 10], back, [40], ends, cov)
    assert (cn > 0).all()
    assert abs(cn[1] - cn[3] - cn[5]) < 1e-5 and abs(cn[1] - cn[4] - cn[5]) < 1e-5
    assert cn[1] > 3 * cn[0]
    alone = copynumber.fit(seq[:1], [100], [1000.0], [], [], [], [], set(), cov)
    assert np.allclose(alone, 2.0)


def loop_graph():
    n = lambda p, s: ("chr1", p, s)
    seq = [(n(0, "-"), n(99, "+")), (n(100, "-"), n(199, "+")), (n(200, "-"), n(299, "+"))]
    joints = [(n(99, "+"), n(100, "-")), (n(199, "+"), n(200, "-")), (n(199, "+"), n(100, "-"))]
    return walks.Graph(seq, [100.0, 1000.0, 100.0], joints, [2.0, 10.0, 2.0, 2.0, 2.0, 8.0], [10, 10, 1], {n(0, "-"), n(299, "+")})


def test_greedy_walks_are_legal_and_cover():
    g = loop_graph()
    found = walks.greedy(g)
    assert walks.faults(g, [(w, x) for w, x, _ in found]) == []
    assert found[0][0].cyclic and abs(found[0][1] - 8.0) < 1e-9
    covered = sum(x * walks.length(g, w) for w, x, _ in found)
    assert covered >= 0.9 * sum(c * s for c, s in zip(g.cn, g.lengths))
    few = walks.fewest(g, [w for w, _, _ in found])
    assert walks.faults(g, few) == [] and len(few) <= len(found)


def test_greedy_prefers_constraints():
    g = loop_graph()
    asked = [Counter({0: 1, 3: 1, 1: 1})]
    found = walks.greedy(g, asked, alpha=10.0)
    assert any(got for _, _, got in found)


def test_greedy_takes_more_than_a_hundred_walks():
    n = lambda p, s: ("chr1", p, s)
    seq = [(n(100 * k, "-"), n(100 * k + 99, "+")) for k in range(120)]
    g = walks.Graph(seq, [100.0] * 120, [(b, a) for a, b in seq], [5.0] * 240, [1] * 120)
    assert len(walks.greedy(g)) == 108  # nine tenths


def test_constraints_reach_the_decomposition(spark):
    from helixmill.operators import kernels, readpaths

    c, s = "chr1", []
    for k, cn in ((0, 0.5), (100, 10.0), (1100, 0.5)):
        s.append((1, "sequence", c, k, "-", c, {0: 99, 100: 1099, 1100: 1199}[k], "+", 1000 if k == 100 else 100, 0, 0, cn))
    s += [(1, "concordant", c, p, "+", c, p + 1, "-", 0, 0, 5, 0.5) for p in (99, 1099)] + [(1, "discordant", c, 1099, "+", c, 100, "-", 0, 0, 8, 9.5)]
    edges = spark.createDataFrame(s, kernels.EDGES + ", cn double")
    seq = readpaths.number_edges(spark.createDataFrame([(1, c, 0, 99), (1, c, 100, 1099), (1, c, 1100, 1199)], "amplicon_id long, chrom string, start long, end long"))
    asked = kernels.path_constraints(spark.createDataFrame([(1, "e1,c1,e2,c2,e3")], "amplicon_id long, path string"), seq)
    assert {r.n for r in asked.collect()} == {1} and asked.count() == 5
    plain = kernels.decompose(edges).where("not iscyclic").count()
    assert kernels.decompose(edges, constraints=asked).where("not iscyclic").count() == 3 and plain == 0
    assert kernels.decompose(edges, "fewest", asked).where("not iscyclic").count() == 3
    assert kernels.walk_passes(edges, asked).where("not iscyclic").count() > 0


def test_euler_passes_each_edge_as_often():
    g = loop_graph()
    edges = Counter({0: 1, 1: 2, 2: 1, 3: 1, 4: 1, 5: 1})
    w = walks.euler(edges, g, False)
    assert w is not None and w.passes(3) == edges
    cycle = walks.euler(Counter({1: 1, 5: 1}), g, True)
    assert cycle is not None and cycle.cyclic and cycle.passes(3) == Counter({1: 1, 5: 1})
    assert walks.euler(Counter({0: 1}), g, True) is None


def test_first_fit_joins_the_first_cluster_near():
    a = np.array([0, 3000, 1500, 10_000])
    assert first_fit(a, a, 2000).tolist() == [0, 1, 0, 2]
    assert first_fit(np.array([], int), np.array([], int), 2000).tolist() == []


def test_calls():
    at, got = call([100, 100, 104], [500, 500, 505], [0, 0, 0], ("+", "-"), 100)
    assert at == (100, 500) and got == [0, 1, 2]
    at, _ = call([100, 103], [500, 501], [0, 0], ("+", "-"), 100)
    assert at == (102, 500)
    assert peel([0] * 4 + [900] * 3, [0] * 4 + [900] * 3, [0] * 7, ("+", "+"), 3, 100) == [(0, 0, [0, 1, 2, 3]), (900, 900, [4, 5, 6])]
    assert match_one(0, 0, (150, 0), ("+", "+"), 60, 100) and not match_one(0, 0, (150, 0), ("-", "+"), 60, 100)
