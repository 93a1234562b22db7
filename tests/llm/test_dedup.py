"""SimHash, embedding links and nearest neighbours against brute force."""

import os
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from helixmill.llm import embedding_dedup, nearest, simhash
from helixmill.llm._links import components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, near):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and near(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def texts():
    pick = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(pick.choices(words, k=pick.randint(1, 200))) for _ in range(40)]
    near = [b.replace(" ", "\n", 1) for b in base[:10]] + [b + " tail" for b in base[10:30]] + [b.upper() for b in base[:5]]
    return [*base, *near, None, "", " \t ", "É é", "one", "One two", "one two", "a\u00a0b c", "x" * 5000, "longer " * 20000, *([base[0]] * 30)]


def test_fingerprints_are_the_plain_ones():
    for t in texts():
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_simhash_groups(spark):
    rows = [(k, t, "x") for k, t in enumerate(texts())] + [(None, "one two", "x"), (3, "repeated id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    fps = {k: plain_fingerprint(t) for k, t, _ in rows[:-2]}
    want = groups(list(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 3)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id == want[next(k for k, t in enumerate(texts()) if t == "One two")]
        elif r.fingerprint == f"{fps[r.doc_id]:016x}":
            assert r.component_id == want[r.doc_id]
        else:
            assert r.doc_id == 3
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_simhash_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    pick = random.Random(9)
    fps = [pick.getrandbits(64) for _ in range(400)]
    fps += [f ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64)) for f in fps[:200]]
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r.node: r.root for r in components(simhash._links(df, 3)).collect()}
    want = groups(list(range(len(fps))), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 3)
    mine = groups(list(range(len(fps))), lambda a, b: found.get(signed[a], signed[a]) == found.get(signed[b], signed[b]))
    assert want == mine


def vectors(n=150, dim=8):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, dim))
    x = [(centres[k % 25] + rng.normal(size=dim) * 0.06).astype(np.float32).tolist() for k in range(n)]
    rows = [(k, v, int(k % 3)) for k, v in enumerate(x)]
    rows += [(n + k, x[0], 0) for k in range(40)]
    rows += [(500, None, 1), (501, [0.0] * dim, 1), (502, [float("nan")] * dim, 1), (503, [float("inf")] + x[0][1:], 0), (504, [None] + x[0][1:], 0), (505, x[0], None), (506, [], 0), (507, x[0][:4], 0), (None, x[0], 0), (508, [-0.0] * dim, 0)]
    return rows


def good(v):
    return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v)


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 512)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("copies", F.lit(1))
    got = {r.vec_id: r for r in embedding_dedup.links(df).collect() if r.vec_id is not None}
    use = {i: (np.array(v, dtype=float), lab) for i, v, lab in rows if i is not None and lab is not None and good(v)}

    def near(a, b):
        (x, p), (y, q) = use[a], use[b]
        return p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98

    comp = groups(list(use), near)
    assert len(got) == len([r for r in rows if r[0] is not None])
    for i, _, _ in rows:
        if i is None:
            continue
        links = sum(near(i, j) for j in use if j != i) if i in use else 0
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links, comp.get(i, i), comp.get(i, i) == i)
    assert embedding_dedup.links(df.limit(0)).collect() == []


def test_nearest_has_all_candidates_and_exact_scores(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(0))
    use = {i: np.array(v, dtype=float) for i, v, _ in rows if i is not None and good(v) and len(v) == 8}
    for lists, probes in ((256, 32), (4, 1)):
        monkeypatch.setattr(nearest, "LISTS", lists)
        monkeypatch.setattr(nearest, "LIST_ROWS", 20)
        monkeypatch.setattr(nearest, "PROBES", probes)
        got = nearest.search(df, F.col("vec_id") % 10 == 0).collect()
        hits = total = 0
        for q in [i for i in use if i % 10 == 0]:
            mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
            d = {i: np.sqrt(((use[q] - v) ** 2).sum()) for i, v in use.items() if i != q}
            best = sorted(d, key=lambda i: (d[i], i))[:10]
            assert [r.rank for r in mine] == list(range(1, 11))
            assert all(abs(r.score - d[r.vec_id]) < 1e-12 for r in mine)
            assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
            hits, total = hits + len({r.vec_id for r in mine} & set(best)), total + 10
        assert hits / total >= (0.95 if probes > 1 else 0.5)
    few = df.where("vec_id in (0, 3, 7)")
    assert sorted((r.query_id, r.rank) for r in nearest.search(few, F.col("vec_id") == 0).collect()) == [(0, 1), (0, 2)]
    assert nearest.search(df.limit(0), F.col("vec_id") == 0).collect() == []


def test_nearest_visits_as_many_lists_as_recall_needs(spark):
    pick = np.random.default_rng(7)
    x = pick.normal(size=(6000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert len(x) // nearest.LIST_ROWS > nearest.PROBES  # some lists may stay unvisited
    found = {}
    for r in nearest.search(df, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 50):
        d = ((x - x[q]).astype(np.float64) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & found[q])
    assert hits / 1200 >= 0.95


def test_index_is_fitted_off_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    sample = df.selectExpr("embedding AS v").coalesce(1)
    centres, cuts, books = nearest.Index.fit(sample, 400, 12)
    plain = nearest.Index(x, 12)
    assert np.array_equal(centres, plain.centres) and all(np.array_equal(a, b) for a, b in zip(cuts, plain.cuts))
    assert len(books) == len(plain.books) and all(np.array_equal(a, b) for a, b in zip(books, plain.books))

    def here(*_):
        raise AssertionError("the index is fitted on the driver")

    pid = os.getpid()
    real = nearest.Index.__init__
    monkeypatch.setattr(nearest.Index, "__init__", lambda self, *a: here() if os.getpid() == pid else real(self, *a))
    got = nearest.search(df, F.col("vec_id") % 50 == 0, k=3, probes=12, lists=12).collect()
    assert len(got) == 8 * 3
