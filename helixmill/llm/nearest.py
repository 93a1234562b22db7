"""Approximate nearest neighbours: inverted file with product-quantised residuals.

Coarse centroids and the codebooks of the residuals are fitted on a bounded sample (the rows of smallest digest, FIT_ROWS
and FIT_MOST at most where there are more lists), in a task: the driver gets only centroids and codebooks; every row is indexed. There are as many lists as the square root of the
number of entries, LISTS at least where that leaves LIST_ROWS entries a list; many are fitted in two levels. A query visits its nearest lists, ranks what is in them by asymmetric distance tables (query
against codes), and the best of these are ranked again by the exact distance of the original vectors.

How many lists are visited is measured at the table's own size: a sample of the queries is compared with every entry,
and as many of the nearest lists are taken as hold the share RECALL of its true neighbours, PROBES at least.

exact=True visits all lists and ranks them by the vectors themselves instead of their codes.

Exact copies share one entry, whose smallest ids are kept as far as any query can ask for them (k + 1), so copies don't
crowd out others. Lists are cut into blocks and queries into groups, so a hot list is spread over tasks. A query that
meets fewer than k rows in its lists visits all lists instead, so it gets all candidates if there are fewer.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without id or vectors of another length than most; ties go to the smaller id; rows that repeat an id are one row for
each distinct vector. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import digest_sample, durable, small_batches, tasks, usable

FIT_ROWS = 16_384
FIT_MOST = 262_144
LISTS = 256  # coarse centroids up to LISTS^2 entries; one for about LIST_ROWS entries at least
LIST_ROWS = 64
PROBES = 32  # lists visited at least
RECALL = 0.99  # share of the sampled queries' true neighbours that the visited lists must hold
SAMPLED = 256  # queries compared with every entry
PIECES = 16
CODES = 256
SHORTLIST = 200
BLOCK = 2048
QUERIES = 512  # queries that a block meets at once
TABLES = 128  # of these, as many as have their distance tables at a time
SALTS = 64


def _kmeans(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; deterministic."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(steps):
        near = _nearest(x, centres)
        for d in range(x.shape[1]):
            total, n = np.bincount(near, x[:, d], len(centres)), np.bincount(near, minlength=len(centres))
            centres[n > 0, d] = (total / np.maximum(n, 1))[n > 0]
    return centres


def _two_levels(x: np.ndarray, k: int) -> np.ndarray:
    """About k centres: those of coarse cells, each split by its share of the rows."""
    top = _kmeans(x, int(np.sqrt(k)))
    cell = _nearest(x, top)
    return np.concatenate([_kmeans(own, max(1, round(k * len(own) / len(x)))) for c in range(len(top)) if len(own := x[cell == c])])


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[k : k + 4096], centres).argmin(1) for k in range(0, len(x), 4096)])


class Index:
    """Coarse centroids and codebooks of the residuals' pieces."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = _kmeans(sample, lists) if lists <= LISTS else _two_levels(sample, lists)
        sample = sample[: 4 * FIT_ROWS]
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.cuts = [c for c in np.array_split(np.arange(sample.shape[1]), min(PIECES, sample.shape[1]))]
        self.books = [_kmeans(rest[:, c], CODES, 8) for c in self.cuts]

    @classmethod
    def fit(cls, sample: DataFrame, rows: int, lists: int) -> tuple:
        """(centres, cuts, books) of at most `rows` rows (v) in their order, fitted in one task; only these come to the driver."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x, n = None, 0
            for f in frames:
                if len(f):
                    some = _matrix(f["v"])
                    x = np.empty((rows, some.shape[1])) if x is None else x
                    x[n : n + len(some)] = some
                    n += len(some)
            if n:
                index = cls(x[:n], lists)
                parts = [index.centres, *index.books]
                yield pd.DataFrame({"at": range(len(parts)), "n": [len(p) for p in parts], "data": [np.ascontiguousarray(p, np.float64).tobytes() for p in parts]})

        found = sorted(sample.select("v").mapInPandas(run, "at int, n int, data binary").collect())
        centres, *books = [np.frombuffer(r.data, np.float64).reshape(r.n, -1) for r in found]
        return centres, np.array_split(np.arange(centres.shape[1]), len(books)), books

    @classmethod
    def of(cls, parts: tuple) -> Index:
        """From (centres, cuts, books): only arrays are broadcast."""
        self = cls.__new__(cls)
        self.centres, self.cuts, self.books = parts
        return self

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = _nearest(x, self.centres)
        rest = x - self.centres[lists]
        return lists, np.stack([_nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books)], axis=1).astype(np.uint8)

    def tables(self, x: np.ndarray, of: int) -> np.ndarray:
        """Squared distances (query, piece, code) of the queries' residuals in a list to the codebooks."""
        rest = x - self.centres[of]
        return np.stack([np.pad(_squares(rest[:, c], b), ((0, 0), (0, CODES - len(b)))) for c, b in zip(self.cuts, self.books)], axis=1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _smallest(rows: DataFrame, key: list[str], order: list[Column], n: int, salt: Column) -> DataFrame:
    """The first n rows of each key: first within salts, so no key meets in one task."""
    rows = rows.withColumn("salt", salt)
    for by in ([*key, "salt"], key):
        rows = rows.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("at") <= n)
    return rows.drop("salt", "at")


def _probes(entries: DataFrame, asks: np.ndarray, centres: Broadcast, k: int) -> int:
    """The least number of nearest lists that hold the share RECALL of the sampled queries' k nearest other entries."""
    own = {x.tobytes(): q for q, x in enumerate(asks)}

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, lists = np.full((len(asks), k), np.inf), np.full((len(asks), k), -1)
        for f in frames:
            if len(f):
                x = _matrix(f["v"]) + 0.0
                d = _squares(asks, x)
                for row, v in enumerate(x):
                    if (q := own.get(v.tobytes())) is not None:
                        d[q, row] = np.inf
                d = np.concatenate([best, d], axis=1)
                of = np.concatenate([lists, np.broadcast_to(_nearest(x, centres.value[0]), (len(asks), len(x)))], axis=1)
                top = np.argpartition(d, k - 1, axis=1)[:, :k]
                best, lists = np.take_along_axis(d, top, 1), np.take_along_axis(of, top, 1)
        q, at = np.nonzero(np.isfinite(best))
        yield pd.DataFrame({"q": q, "d": best[q, at], "list": lists[q, at]})

    found = entries.select("v").mapInPandas(nearest, "q long, d double, list long")
    first = F.row_number().over(Window.partitionBy("q").orderBy("d", "list"))
    true = found.withColumn("at", first).where(F.col("at") <= k).select("q", "list").toPandas()  # at most SAMPLED * k rows
    if true.empty:
        return 1
    place = np.argsort(np.argsort(_squares(asks, centres.value[0]), axis=1, kind="stable"), axis=1)
    needed = np.sort(place[true["q"].to_numpy(), true["list"].to_numpy()])
    return int(needed[int(np.ceil(RECALL * len(needed))) - 1]) + 1


def search(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, probes: int | None = None, shortlist: int = SHORTLIST, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which the condition holds, itself excepted.

    lists, probes: fixed numbers of lists and of those a query visits, instead of the ones chosen. shortlist: entries of a
    query that are ranked by exact distance.
    """
    shortlist = max(shortlist, k + 1)
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), queries.alias("asks"))
    rows = durable(rows.where(usable("v") & F.col("id").isNotNull()), "vectors")
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not usual:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("v") == usual[0].n)
    copies = _smallest(rows.select("id", "v").withColumn("h", F.xxhash64("v")), ["h", "v"], [F.col("id")], k + 1, F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    entries = durable(copies.groupBy("h", "v").agg(F.min("id").alias("entry"), F.sort_array(F.collect_list("id")).alias("ids")).select("entry", "ids", "v"), "entries")
    n_entries = entries.count()
    n_lists = lists or max(1, min(n_entries // LIST_ROWS, max(LISTS, math.isqrt(n_entries)), FIT_MOST // LIST_ROWS))
    fit_rows = max(FIT_ROWS, min(FIT_MOST, LIST_ROWS * n_lists))
    fitted = Index.fit(digest_sample(entries.select("entry", "v"), F.xxhash64("entry"), fit_rows, "entry"), fit_rows, n_lists)
    parts = spark.sparkContext.broadcast(fitted)  # as many vectors as lists, and CODES
    n_lists = len(fitted[0])
    del fitted

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index.of(parts.value)
        for f in frames:
            if len(f):
                x = _matrix(f["v"])
                lists, codes = (_nearest(x, index.centres), x) if exact else index.encode(x)
                yield pd.DataFrame({"list": lists.astype(np.int32), "entry": f["entry"], "codes": [c.tobytes() for c in codes]})

    coded = entries.select("entry", "v").mapInPandas(encode, "list int, entry long, codes binary")
    n_blocks = 1 + n_entries // (n_lists * BLOCK)
    slot = F.pmod(F.xxhash64("entry"), F.lit(n_blocks)).cast("int")
    blocks = coded.withColumn("block", slot).groupBy("list", "block").agg(F.sort_array(F.collect_list(F.struct("entry", "codes"))).alias("rows"))
    blocks = durable(blocks.select("list", "block", "rows.entry", "rows.codes"), "lists")  # blocks of about BLOCK rows
    asked = durable(rows.where("asks").select("id", "v").dropDuplicates(["id", "v"]), "queries")
    groups = 1 + asked.count() // QUERIES
    some = digest_sample(asked.select("id", "v"), F.xxhash64("id"), SAMPLED, "id", "v").select("v").distinct().collect()
    fixed, probes = exact or probes is not None, n_lists if exact else min(probes or PROBES, n_lists)
    if some and n_lists > probes and not fixed:
        probes = max(probes, _probes(entries, np.array([r.v for r in some], dtype=np.float64) + 0.0, parts, k))

    def visited(some: DataFrame, probes: int) -> DataFrame:
        def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres = parts.value[0]
            for f in frames:
                if len(f):
                    x = _matrix(f["v"])
                    d = _squares(x, centres)
                    near = np.argsort(d, axis=1, kind="stable")[:, :probes]
                    yield pd.DataFrame({"list": near.ravel().astype(np.int32), "id": np.repeat(f["id"].to_numpy(), near.shape[1]), "v": [v for v in f["v"] for _ in range(near.shape[1])]})

        visits = some.mapInPandas(visit, f"list int, id long, v {some.schema['v'].dataType.simpleString()}")
        group = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
        visits = visits.withColumn("group", group).groupBy("list", "group").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("asks"))
        # a query's visits aren't in the planner's estimate, so neither this nor the vectors below are broadcast by it
        work = visits.select("list", "group", "asks.id", "asks.v").join(blocks.hint("merge"), "list").repartition(tasks(spark), "list", "group", "block")

        def rank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = Index.of(parts.value)
            for f in frames:
                for r in f.itertuples(index=False):
                    asks, entry, packed = np.stack(r.v).astype(np.float64), np.asarray(r.entry), b"".join(r.codes)
                    codes = np.frombuffer(packed, np.float64 if exact else np.uint8).reshape(len(entry), -1)
                    for at in range(0, len(asks), TABLES):
                        x = asks[at : at + TABLES]
                        if exact:
                            near = _squares(x, codes)
                        else:
                            tables = index.tables(x, r.list)
                            near = sum(tables[:, p, :][:, codes[:, p]] for p in range(codes.shape[1]))
                        top = np.argsort(near, axis=1, kind="stable")[:, :shortlist]  # entries are in order: ties to the smaller
                        best = np.take_along_axis(near, top, 1)
                        yield pd.DataFrame({"id": np.asarray(r.id)[at : at + TABLES], "salt": (r.list + 7 * r.block) % SALTS, "entry": list(entry[top]), "near": list(best)})

        def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for some in f["parts"]:
                    entry, near = (np.concatenate([p[c] for p in some]) for c in ("entry", "near"))
                    top = np.lexsort((entry, near))[:shortlist]
                    out.append((entry[top], near[top]))
                if out:
                    yield pd.DataFrame({"id": f["id"], "entry": [e for e, _ in out], "near": [d for _, d in out]})

        row = "id long, entry array<long>, near array<double>"
        best = work.select("list", "block", "id", "v", "entry", "codes").mapInPandas(rank, row.replace("id long", "id long, salt long"))
        for by in (["id", "salt"], ["id"]):  # within salts first: a query's visits grow with its lists
            met = best.groupBy(*by).agg(F.collect_list(F.struct("entry", "near")).alias("parts"))
            best = met.select("id", "parts").mapInPandas(merge, row)
        return best.select("id", F.explode("entry").alias("entry"))

    def ranked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(asked.withColumnRenamed("v", "q"), "id").join(entries.hint("merge"), "entry")
        square = F.aggregate(F.zip_with("q", "v", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
        each = both.select("id", F.sqrt(square).alias("score"), F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("id"))
        return each.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)

    first = durable(ranked(visited(asked, probes)), "found")
    full = first.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = durable(asked.join(full, "id", "left_anti"), "short")
    if n_lists > probes and short.limit(1).count():
        first = first.join(short.select("id").distinct(), "id", "left_anti").union(ranked(visited(short, n_lists)).select(first.columns))
    return first.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
